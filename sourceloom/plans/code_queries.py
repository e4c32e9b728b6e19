"""Registered queries over facts and texts of code: parts call the suppliers of their lines, suppliers call a helper and their nation's library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom import sources
from sourceloom.functions import documentation_url, language_of, library_module, path_basename, path_dirname
from sourceloom.operators import clustering, resolution, source_text
from sourceloom.plans.durable import Workspace
from sourceloom.plans.queries_sql import TRADE
from sourceloom.plans.tables import table, text_id


def _file(kind: str, folder: str, key: str):
    return F.concat(F.lit(f"/ws/{kind}/"), F.regexp_replace(folder, "[^A-Za-z0-9]", "_"), F.lit("/"), F.col(key).cast("string"), F.lit(".py"))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Definitions, imports, calls and entry calls: parts and suppliers are functions, and every nation defines ``helper``."""
    part, supplier, nation, items = (table(spark, sf_dir, x) for x in ("part", "supplier", "nation", "lineitem"))
    row = lambda i, name, file: (F.lit("shop").alias("repo"), F.lit("python").alias("language"), i.alias("id"), name.alias("name"), file.alias("file"), F.lit(1).alias("line"))
    p_file, s_file, n_file = _file("parts", "p_brand", "p_partkey"), F.concat(F.lit("/ws/supp/"), F.col("s_suppkey").cast("string"), F.lit(".py")), F.concat(F.lit("/ws/nations/"), F.col("n_nationkey").cast("string"), F.lit(".py"))
    definitions = (
        part.select(*row(text_id("p", "p_partkey"), text_id("part_", "p_partkey"), p_file))
        .unionByName(supplier.select(*row(text_id("s", "s_suppkey"), text_id("supp_", "s_suppkey"), s_file)))
        .unionByName(nation.select(*row(text_id("n", "n_nationkey"), F.lit("helper"), n_file)))
    )
    call = lambda file, caller, kind, obj, name: (F.lit("shop").alias("repo"), F.lit("python").alias("language"), file.alias("file"), caller.alias("caller_id"), F.lit(kind).alias("kind"), obj.alias("obj"), name.alias("name"))
    none = F.lit(None).cast("string")
    bought = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    calls = (
        bought.select(*call(p_file, text_id("p", "p_partkey"), "bare", none, text_id("supp_", "l_suppkey")))
        .unionByName(supplier.where("s_acctbal < 0").select(*call(s_file, text_id("s", "s_suppkey"), "attr", F.lit("self"), F.lit("helper"))))
        .unionByName(supplier.select(*call(s_file, text_id("s", "s_suppkey"), "attr", F.lit("np"), F.concat(F.lit("f"), (F.col("s_nationkey") % 3).cast("string")))))
        .unionByName(supplier.select(*call(s_file, text_id("s", "s_suppkey"), "attr", F.lit("helper"), F.lit("shadowed"))))
        .unionByName(part.where("p_size > 40").select(*call(p_file, text_id("p", "p_partkey"), "bare", none, F.lit("load"))))
    )
    bound = lambda df, file, local, module, n: df.select(F.lit("shop").alias("repo"), F.lit("python").alias("language"), file.alias("file"), F.lit(local).alias("local"), module.alias("module"), F.lit(n).alias("ord"))
    imports = (
        bound(supplier, s_file, "np", F.lit("early"), 0).unionByName(bound(supplier, s_file, "np", F.concat(F.lit("lib_"), F.col("s_nationkey").cast("string")), 1))
        .unionByName(bound(supplier, s_file, "helper", F.lit("lib_x"), 2)).unionByName(bound(part, p_file, "load", F.concat(F.lit("io."), F.lower("p_type"), F.lit(".load")), 0))
    )
    entries = part.where("p_size = 1").select(F.lit("shop").alias("repo"), F.lit("python").alias("language"), p_file.alias("file"), text_id("part_", "p_partkey").alias("name"))
    return definitions, imports, calls, entries


def code_definitions(spark, sf_dir):
    definitions, *_ = facts(spark, sf_dir)
    twice = definitions.unionByName(definitions.withColumn("line", F.lit(7)).where("id like '%3'")).unionByName(definitions.where("id like 'n%'").withColumn("id", F.lit(None).cast("string")))
    return resolution.clean_definitions(twice).select("id", "name", "file", "line")


def code_names(spark, sf_dir):
    return resolution.name_index(facts(spark, sf_dir)[0]).select("name", F.array_join("ids", ",").alias("ids"))


def code_calls(spark, sf_dir):
    definitions, _, calls, _ = facts(spark, sf_dir)
    return resolution.resolve_calls(definitions, calls).drop("repo")


def name_degrees(spark, sf_dir):
    """Degrees in the call graph without its edges."""
    definitions, _, calls, _ = facts(spark, sf_dir)
    return resolution.factored_degrees(definitions, calls).drop("repo")


def facts_ingested(spark, sf_dir):
    """Definitions of parts and calls to suppliers as JSON texts, some damaged: how many of each kind are taken, and every record that is not, with its reason."""
    from sourceloom.sources.facts import ingest_facts

    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key = F.col("p_partkey")
    row = F.to_json(F.struct(F.lit("shop").alias("repo"), F.lit("python").alias("language"), F.when(key % 11 == 0, "").otherwise(text_id("p", "p_partkey")).alias("id"), F.when(key % 13 > 0, F.col("p_name")).alias("name"), (F.col("p_size") - 2).alias("line")))
    texts = part.select(F.when(key % 17 == 0, F.expr("substring(concat('{', p_name), 1, 9)")).otherwise(row).alias("text"))
    again = part.where("p_partkey % 5 = 1 and p_partkey % 11 > 0 and p_partkey % 13 > 0 and p_partkey % 17 > 0 and p_size > 1").select(F.concat(F.lit('{"repo":"shop","language":"python","id":"p'), key.cast("string"), F.lit('","name":"second","line":0}')).alias("text"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("bare", "attr", "new"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    calls = items.select(F.to_json(F.struct(F.lit("shop").alias("repo"), F.lit("python").alias("language"), text_id("o", "l_orderkey").alias("caller_id"), kind.alias("kind"), F.when(F.col("l_linenumber") > 3, "self").alias("obj"), text_id("s", "l_suppkey").alias("name"))).alias("text"))
    out = None
    for name, rows in (("definitions", texts.unionByName(again)), ("calls", calls)):
        taken, rejected = ingest_facts(rows, name)
        counts = taken.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), F.lit("taken").alias("reason"), F.lit("").alias("record"), "n")
        lost = rejected.groupBy("reason", F.col("record") if name == "definitions" else F.lit("").alias("record")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "reason", "record", "n")
        out = counts.unionByName(lost) if out is None else out.unionByName(counts).unionByName(lost)
    return out


def code_library_edges(spark, sf_dir):
    definitions, imports, calls, _ = facts(spark, sf_dir)
    return resolution.resolve_library_calls(definitions, imports, calls)[1].drop("repo")


def code_library_nodes(spark, sf_dir):
    definitions, imports, calls, _ = facts(spark, sf_dir)
    nodes = resolution.resolve_library_calls(definitions, imports, calls)[0]
    module = library_module(F.col("library_name"), F.col("name"))
    return nodes.select("id", "name", "library_name", module.alias("module"), documentation_url(F.col("language"), module).alias("url"))


def code_entry_points(spark, sf_dir):
    definitions, _, _, entries = facts(spark, sf_dir)
    nodes, edges = resolution.entry_points(definitions, entries)
    return edges.select("source", "target").unionByName(nodes.select(F.lit("node").alias("source"), F.col("id").alias("target")))


def code_graph(spark, sf_dir):
    nodes, edges = resolution.call_graph(*facts(spark, sf_dir))
    both = resolution.union_graphs((nodes, edges), (nodes.withColumn("repo", F.lit("twin")), edges.withColumn("repo", F.lit("twin"))))
    count = lambda df, what: df.groupBy("repo", "is_library").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
    return count(both[0], "nodes").unionByName(count(both[1], "edges"))


def library_packages(spark, sf_dir):
    definitions, imports, calls, _ = facts(spark, sf_dir)
    nodes, edges = resolution.resolve_library_calls(definitions, imports, calls)
    opened = nodes.where("library_name = 'lib_3'").select("repo", "library_name")
    shown = clustering.group_libraries(nodes, 0.5, opened)
    links = clustering.reroute_library_edges(edges, shown, definitions.select("repo", "id", F.col("file").alias("rendered")).where("id like 's%'"))
    return links.join(shown.select(F.col("id").alias("target"), "label", "size", "n").distinct(), "target").select("source", "target", "label", "size", "n")


def sources_text(spark: SparkSession, sf_dir: str, braces: bool = False) -> DataFrame:
    """(repo, file, text): a file an order, with a function for each line of it, of as many statements as its quantity's tens, and one for the order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 10).cast("int").alias("k")).repartition("l_orderkey")
    if braces:
        one = F.concat(F.lit("function f"), F.col("l_linenumber").cast("string"), F.lit("() {\n"), F.expr("repeat('  if (x) { y(); }\n', k)"), F.lit("}\n"))
        head, tail = F.lit("class A extends B implements C, D {\n"), F.lit("}")
    else:
        one = F.concat(F.lit("  def f"), F.col("l_linenumber").cast("string"), F.lit("(self):\r\n"), F.expr("repeat('    y()\r\n\r\n', k)"))
        head, tail = F.lit("class A:\r\n"), F.lit("z()\r\n")
    rows = items.groupBy("l_orderkey", "l_linenumber").agg(F.max("k").alias("k")).select("l_orderkey", "l_linenumber", one.alias("one"))
    text = F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "one"))), lambda x: x["one"]), ""), tail)
    return rows.groupBy("l_orderkey").agg(text.alias("text")).select(F.lit("shop").alias("repo"), text_id("o", "l_orderkey").alias("file"), "text")


def _found(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("text").rlike(pattern)).select("repo", F.concat_ws(":", "file", F.regexp_extract("text", pattern, 1)).alias("id"), "file", "line")


def source_lines(spark, sf_dir):
    return source_text.source_lines(sources_text(spark, sf_dir)).groupBy("file").agg(F.max("line").alias("n_lines"), F.sum(F.length("text")).alias("chars"))


def extents_python(spark, sf_dir):
    lines = source_text.source_lines(Workspace(spark).keep(sources_text(spark, sf_dir)))
    return source_text.extents_by_indentation(_found(lines, r"def (\w+)"), lines).select("id", "start", "end")


def extents_braces(spark, sf_dir):
    lines = source_text.source_lines(Workspace(spark).keep(sources_text(spark, sf_dir, True)))
    return source_text.extents_by_braces(_found(lines, r"function (\w+)"), lines).select("id", "start", "end")


def function_sources(spark, sf_dir):
    lines = source_text.source_lines(Workspace(spark).keep(sources_text(spark, sf_dir, True)))
    extents = source_text.extents_by_braces(_found(lines, r"function (\w+)"), lines)
    return source_text.function_source(extents, lines).select("id", F.length("source").alias("chars"), "error")


def class_headers(spark, sf_dir):
    found = source_text.scan_class_headers(sources_text(spark, sf_dir, True))
    keyed = found.withColumn("class_key", F.concat_ws("::", "file", "class_name")).unionByName(found.select("repo", "file", F.lit("B").alias("class_name"), F.lit(None).cast("string").alias("class_extends"), F.array().cast("array<string>").alias("class_implements"), F.concat_ws("::", "file", F.lit("B")).alias("class_key")))
    linked = resolution.inheritance_edges(keyed.withColumn("repo", F.col("file")))
    return linked.select("source", "target", "kind")


def js_imports(spark, sf_dir):
    """Every part imports its brand's module whole, by names and by require; the last binding of ``a`` and ``q`` counts, and a declaration has several declarators."""
    part = table(spark, sf_dir, "part")
    text = F.format_string("import def%s, { x as y, z } from '%s'\nimport * as ns from \"%s/ns\"\nconst a = require('old')\nconst { b, c: a } = require('%s')\nimport rel from './rel'\nconst q = require('zeta')\nvar q = require('beta')\nlet m1 = require('one'), k = 5, m2 = require('two').sub, { m3 = 1 } = require('three')\n", F.col("p_size").cast("string"), "p_brand", "p_brand", "p_type")
    return source_text.scan_js_imports(part.select(F.lit("shop").alias("repo"), text_id("p", "p_partkey").alias("file"), text.alias("text"))).drop("repo")


def doc_lookup(spark, sf_dir):
    """Declarations of brands: a part's comment of several lines, long for some, documents its function; a wanted function of an unknown name has none."""
    part = table(spark, sf_dir, "part")
    more = F.when(F.col("p_size") == 7, F.expr("repeat('word ', 1500)")).otherwise("short")
    one = F.concat(F.lit("/**\n * "), "p_name", F.lit(" "), "p_type", F.lit("\r\n *\n * "), more, F.lit("\n * @param x\n */\nexport function part_"), F.col("p_partkey").cast("string"), F.lit("(x: number): void;\n"))
    declared = part.select(F.col("p_brand").alias("package"), F.lit(1).alias("rank"), text_id("d", "p_partkey").alias("file"), one.alias("text"))
    empty = declared.withColumn("rank", F.lit(0)).withColumn("text", F.regexp_replace("text", r"(?s)/\*\*.*\*/", "/**\n * @param x\n */"))
    wanted = part.select(F.col("p_brand").alias("package"), text_id("part_", "p_partkey").alias("name")).unionByName(part.where("p_size < 5").select(F.col("p_brand").alias("package"), text_id("none_", "p_partkey").alias("name")))
    return resolution.doc_comments(wanted, declared.unionByName(empty))


def _layout_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout documents of users' events: a name for some, and damaged ones."""
    e = table(spark, sf_dir, "events")
    named = F.when(F.col("event_id") % 3 == 0, F.format_string('{"version":1,"name":"%s %s","savedAt":"t","nodePositions":{"n":{"x":%s,"y":1.5}}}', "event_type", F.col("user_id").cast("string"), F.col("value").cast("string")))
    other = F.when(F.col("event_id") % 3 == 1, F.format_string('{"version":1,"description":"Of %s"}', "event_type")).otherwise(F.concat(F.lit("{"), F.col("props")))
    return e.select(F.format_string("%08d.json", "event_id").alias("file"), F.coalesce(named, other).alias("text"))


def layouts_found(spark, sf_dir):
    found = sources.search_layouts(sources.parse_layouts(_layout_texts(spark, sf_dir)), "CLICK")
    return found.select("file", "name", "description", F.col("node_positions")["n"]["x"].alias("x"))


def layouts_written(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.format_string("%s/%s", "event_type", F.col("user_id").cast("string"))
    documents = sources.layout_documents(e.select(name.alias("name"), F.lit("t").alias("saved_at")).distinct(), e.select(name.alias("name"), text_id("e", "event_id").alias("id"), F.col("value").alias("x"), F.lit(0.5).alias("y")))
    back = sources.parse_layouts(documents)
    return back.select("file", "name", F.size("node_positions").alias("n"))


def path_parts(spark, sf_dir):
    """Files of parts by brand, with one of five extensions."""
    part = table(spark, sf_dir, "part")
    extension = F.element_at(F.array(*(F.lit(x) for x in (".py", ".TS", ".mjs", ".d.ts", ".txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    file = F.when(F.col("p_size") == 1, F.concat(text_id("p", "p_partkey"), extension)).otherwise(F.concat(F.lit("w\\"), F.col("p_brand"), F.lit("/"), text_id("p", "p_partkey"), extension))
    return part.select("p_partkey", path_dirname(file).alias("dirname"), path_basename(file).alias("basename"), language_of(file).alias("language"))


def kept_sources(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return sources.keep_sources(_source_paths(part).select("path"))


def _source_paths(part: DataFrame) -> DataFrame:
    folder = F.element_at(F.array(*(F.lit(x) for x in ("src", "out", "__pycache__", ".git", "node_modules", "outer"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    extension = F.element_at(F.array(*(F.lit(x) for x in (".py", ".ts", ".d.ts", ".cjs", ".txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.withColumn("path", F.concat_ws("/", "p_brand", folder, F.concat(text_id("p", "p_partkey"), extension)))


def corpus_scanned(spark, sf_dir):
    """A source tree of a file a part, some empty, is written and scanned: tasks list its folders."""
    parts = _source_paths(table(spark, sf_dir, "part"))
    text = F.when(F.col("p_size") < 5, "").otherwise(F.concat(F.lit("# é "), "p_name", F.lit("\n")))
    folder = f"{Workspace(spark).base}/tree"
    sources.write_documents(parts.select(F.col("path").alias("file"), text.alias("text")), folder)
    return sources.scan_corpus(spark, folder, "shop").select("path", "language", "text", "reason")


def graph_documents(spark, sf_dir):
    """A graph document a nation, of its suppliers and the calls between neighbours, one of them damaged and one without nodes, and what is read back."""
    s = table(spark, sf_dir, "supplier").where("s_nationkey > 1")
    node = F.struct(text_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.concat("s_name", F.lit(".py"))).otherwise("").alias("file"), F.lit(3).alias("line"), (F.col("s_acctbal") < 0).alias("isLibrary"))
    edge = F.struct(text_id("s", "s_suppkey").alias("source"), text_id("s", "s_nationkey").alias("target"), (F.col("s_acctbal") < 0).alias("isLibraryEdge"))
    whole = s.groupBy("s_nationkey").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    rows = whole.select(F.concat(text_id("n", "s_nationkey"), F.lit(".json")).alias("file"), F.to_json(F.struct("nodes", "edges")).alias("text"))
    damaged = table(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.concat(text_id("n", "n_nationkey"), F.lit(".json")).alias("file"), F.when(F.col("n_nationkey") == 0, "{broken").otherwise('{"edges":[]}').alias("text"))
    folder = f"{Workspace(spark).base}/graphs"
    sources.write_documents(rows.unionByName(damaged), folder)
    nodes, edges, _ = sources.read_graph_json(spark, folder, "shop")
    out = nodes.select("id", F.concat_ws("|", "name", "file").alias("what"), "is_library").unionByName(edges.select(F.col("source").alias("id"), F.col("target").alias("what"), "is_library"))
    return out.unionByName(sources.damaged_graphs(spark, folder).select(F.col("file").alias("id"), F.col("reason").alias("what"), F.lit(None).cast("boolean").alias("is_library")))


def layouts_saved(spark, sf_dir):
    """Layouts of the events' types and users, saved twice and opened again: names that give one file leave the later one."""
    e = table(spark, sf_dir, "events")
    mark = F.when(F.col("event_id") % 2 == 0, "/").otherwise(":")
    name = F.concat("event_type", mark, F.col("user_id").cast("string"))
    layouts = e.groupBy(name.alias("name")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("saved_at"), F.to_json(F.struct(F.max("user_id").alias("repel"))).alias("settings"))
    positions = e.select(name.alias("name"), text_id("e", "event_id").alias("id"), F.col("value").alias("x"), F.lit(0.5).alias("y"))
    folder = f"{Workspace(spark).base}/layouts"
    sources.write_layouts(layouts.where("name like 'c%'"), positions, folder)
    sources.write_layouts(layouts, positions, folder)
    return sources.read_layouts(spark, folder).select("file", "name", "saved_at", "settings", F.size("node_positions").alias("n"))


def stored_degrees(spark, sf_dir):
    """The trade graph in a store, and its degrees without an exchange."""
    from sourceloom.plans.queries import trade
    from sourceloom.sources.store import GraphStore

    work = Workspace(spark)
    store = GraphStore(spark, f"{work.base}/store", f"graph_{work.base.rpartition('-')[2]}", 8)
    store.save(*trade(spark, sf_dir))
    return store.degrees().select("id", "out_degree", "in_degree")


QUERIES = {f.__name__: f for f in (
    corpus_scanned, graph_documents, layouts_saved, stored_degrees, code_definitions, code_names, code_calls, name_degrees, facts_ingested, code_library_edges, code_library_nodes, code_entry_points, code_graph, library_packages, source_lines, extents_python, extents_braces,
    function_sources, class_headers, js_imports, doc_lookup, layouts_found, layouts_written, path_parts, kept_sources,
)}

_DEFS = r"""WITH defs AS (
  SELECT 'p' || p_partkey AS id, 'part_' || p_partkey AS name, '/ws/parts/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '/' || p_partkey || '.py' AS file FROM part
  UNION ALL SELECT 's' || s_suppkey, 'supp_' || s_suppkey, '/ws/supp/' || s_suppkey || '.py' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'helper', '/ws/nations/' || n_nationkey || '.py' FROM nation),
inner_calls AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || n_nationkey FROM supplier, nation WHERE s_acctbal < 0),
libs AS (SELECT 's' || s_suppkey AS source, 'lib_' || s_nationkey AS lib, 'f' || (s_nationkey % 3) AS fn FROM supplier
  UNION SELECT 'p' || p_partkey, 'io.' || lower(p_type) || '.load', 'load' FROM part WHERE p_size > 40),
lib_nodes AS (SELECT DISTINCT 'library::' || lib || '::' || fn AS id, fn, lib FROM libs),
lib_edges AS (SELECT DISTINCT source, 'library::' || lib || '::' || fn AS target, lib FROM libs)
"""
_ITEMS = """WITH f AS (SELECT l_orderkey AS o, l_linenumber AS n, MAX(floor(l_quantity / 10)::INTEGER) AS k FROM lineitem GROUP BY 1, 2),
"""

ORACLE_SQL = {
    "code_definitions": _DEFS + "SELECT id, name, file, CASE WHEN id LIKE '%3' THEN 7 ELSE 1 END AS line FROM defs",
    "code_names": _DEFS + "SELECT name, string_agg(id, ',' ORDER BY id) AS ids FROM defs GROUP BY name",
    "code_calls": _DEFS + "SELECT * FROM inner_calls",
    "code_library_edges": _DEFS + "SELECT source, target FROM lib_edges",
    "code_library_nodes": _DEFS + """, m AS (SELECT id, fn AS name, lib AS library_name, CASE WHEN lib LIKE '%.load' THEN left(lib, length(lib) - 5) ELSE lib END AS module FROM lib_nodes)
SELECT *, 'https://docs.python.org/3/library/' || split_part(module, '.', 1) AS url FROM m""",
    "code_entry_points": _DEFS + "SELECT '::MAIN::0' AS source, 'p' || p_partkey AS target FROM part WHERE p_size = 1 UNION ALL SELECT DISTINCT 'node', '::MAIN::0' FROM part WHERE p_size = 1",
    "code_graph": _DEFS + """, c AS (SELECT 'nodes' AS what, false AS is_library, (SELECT COUNT(*) FROM defs) + (SELECT COUNT(DISTINCT p_size) FROM part WHERE p_size = 1) AS n
  UNION ALL SELECT 'nodes', true, (SELECT COUNT(*) FROM lib_nodes) UNION ALL SELECT 'edges', true, (SELECT COUNT(*) FROM lib_edges)
  UNION ALL SELECT 'edges', false, (SELECT COUNT(*) FROM inner_calls) + (SELECT COUNT(*) FROM part WHERE p_size = 1))
SELECT repo, is_library, n, what FROM c, (VALUES ('shop'), ('twin')) v(repo)""",
    "library_packages": _DEFS + """, p AS (SELECT lib, COUNT(*) AS n FROM lib_nodes GROUP BY lib)
SELECT DISTINCT CASE WHEN source LIKE 's%' THEN d.file ELSE source END AS source, CASE WHEN e.lib = 'lib_3' THEN target ELSE 'libcluster::' || e.lib END AS target,
  CASE WHEN e.lib = 'lib_3' THEN split_part(target, '::', 3) ELSE e.lib || ' (' || n || ')' END AS label, CASE WHEN e.lib = 'lib_3' THEN 6.0 ELSE 8.0 END::DOUBLE AS size, CASE WHEN e.lib = 'lib_3' THEN 1 ELSE n END AS n
FROM lib_edges e JOIN p ON p.lib = e.lib JOIN defs d ON d.id = source""",
    "source_lines": _ITEMS + "t AS (SELECT o, SUM(1 + 2 * k) AS n, SUM(length('  def f' || n || '(self):') + 7 * k) AS c FROM f GROUP BY o) SELECT 'o' || o AS file, (n + 3)::INTEGER AS n_lines, (c + 11)::BIGINT AS chars FROM t",
    "extents_python": _ITEMS + """s AS (SELECT o, n, k, 2 + coalesce(SUM(1 + 2 * k) OVER (PARTITION BY o ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM f)
SELECT 'o' || o || ':f' || n AS id, a::INTEGER AS start, (a + 2 * k)::INTEGER AS "end" FROM s""",
    "extents_braces": _ITEMS + """s AS (SELECT o, n, k, 2 + coalesce(SUM(2 + k) OVER (PARTITION BY o ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM f)
SELECT 'o' || o || ':f' || n AS id, a::INTEGER AS start, (a + k + 1)::INTEGER AS "end" FROM s""",
    "function_sources": _ITEMS + "s AS (SELECT 1) SELECT 'o' || o || ':f' || n AS id, (length('function f' || n || '() {') + 18 * k + 2)::INTEGER AS chars, NULL::VARCHAR AS error FROM f",
    "class_headers": "SELECT DISTINCT 'o' || l_orderkey || '::A' AS source, 'o' || l_orderkey || '::B' AS target, 'extends' AS kind FROM lineitem",
    "js_imports": """SELECT 'p' || p_partkey AS file, x.local, x.module FROM part, LATERAL (SELECT 'def' || p_size AS local, p_brand AS module UNION ALL SELECT 'y', p_brand UNION ALL SELECT 'z', p_brand
  UNION ALL SELECT 'ns', p_brand || '/ns' UNION ALL SELECT 'b', p_type UNION ALL SELECT 'a', p_type
  UNION ALL SELECT 'q', 'beta' UNION ALL SELECT 'm1', 'one' UNION ALL SELECT 'm2', 'two' UNION ALL SELECT 'm3', 'three') x""",
    "doc_lookup": "SELECT p_brand AS package, 'part_' || p_partkey AS name, p_name || ' ' || p_type || chr(10) || CASE WHEN p_size = 7 THEN rtrim(repeat('word ', 1500)) ELSE 'short' END AS doc FROM part UNION ALL SELECT p_brand, 'none_' || p_partkey, '' FROM part WHERE p_size < 5",
    "layouts_found": """SELECT printf('%08d.json', event_id) AS file, CASE WHEN event_id % 3 = 0 THEN event_type || ' ' || user_id ELSE printf('%08d', event_id) END AS name,
  CASE WHEN event_id % 3 = 1 THEN 'Of ' || event_type ELSE '' END AS description, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events WHERE event_id % 3 < 2 AND event_type LIKE '%click%'""",
    "layouts_written": "SELECT event_type || '_' || user_id || '.json' AS file, event_type || '/' || user_id AS name, COUNT(*)::INTEGER AS n FROM events GROUP BY ALL",
    "path_parts": r"""WITH f AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN '' ELSE 'w\' || p_brand || '/' END AS d, 'p' || p_partkey || ['.py', '.TS', '.mjs', '.d.ts', '.txt'][p_partkey % 5 + 1] AS b FROM part)
SELECT p_partkey, CASE WHEN d = '' THEN '(root)' ELSE d[:-2] END AS dirname, b AS basename, ['python', 'typescript', 'javascript', 'typescript', NULL][p_partkey % 5 + 1] AS language FROM f""",
    "kept_sources": """SELECT p_brand || '/' || ['src', 'out', '__pycache__', '.git', 'node_modules', 'outer'][p_partkey % 6 + 1] || '/p' || p_partkey || ['.py', '.ts', '.d.ts', '.cjs', '.txt'][p_partkey % 5 + 1] AS path,
  ['python', 'typescript', NULL, 'javascript', NULL][p_partkey % 5 + 1] AS language FROM part WHERE p_partkey % 5 IN (0, 1, 3) AND (p_partkey % 6 IN (0, 5) OR p_partkey % 6 = 2 AND p_partkey % 5 > 0)""",
}
ORACLE_SQL["corpus_scanned"] = f"SELECT path, language, CASE WHEN p_size < 5 THEN '' ELSE '# é ' || p_name || chr(10) END AS text, NULL::VARCHAR AS reason FROM ({ORACLE_SQL['kept_sources'].replace(' AS path,', ' AS path, p_size, p_name,')})"
ORACLE_SQL["graph_documents"] = """WITH s AS (SELECT *, s_acctbal < 0 AS lib FROM supplier WHERE s_nationkey > 1)
SELECT 's' || s_suppkey AS id, s_name || CASE WHEN s_acctbal > 0 THEN '|' || s_name || '.py' ELSE '' END AS what, lib AS is_library FROM s UNION ALL SELECT 's' || s_suppkey, 's' || s_nationkey, lib FROM s
UNION ALL SELECT 'n0.json', 'does not parse', NULL UNION ALL SELECT 'n1.json', 'no nodes', NULL"""
ORACLE_SQL["layouts_saved"] = """WITH l AS (SELECT event_type || CASE WHEN event_id % 2 = 0 THEN '/' ELSE ':' END || user_id AS name, event_type || '_' || user_id || '.json' AS file, user_id, MAX(ts) AS seen, COUNT(value) AS n FROM events GROUP BY ALL)
SELECT file, name, strftime(seen, '%Y-%m-%d %H:%M:%S.%f') AS saved_at, '{"repel":' || user_id || '}' AS settings, n::INTEGER AS n FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY file ORDER BY seen DESC, name DESC) = 1"""
ORACLE_SQL["stored_degrees"] = TRADE + """SELECT n.id, (SELECT COUNT(*) FROM calls WHERE source = n.id) AS out_degree, (SELECT COUNT(*) FROM calls WHERE target = n.id) AS in_degree FROM nodes n"""
ORACLE_SQL["name_degrees"] = _DEFS + """SELECT id, (SELECT COUNT(*) FROM inner_calls WHERE target = id) AS in_degree, (SELECT COUNT(*) FROM inner_calls WHERE source = id) AS out_degree, (SELECT COUNT(*) FROM inner_calls WHERE target = id) + (SELECT COUNT(*) FROM inner_calls WHERE source = id) AS degree FROM defs"""
ORACLE_SQL["facts_ingested"] = r"""WITH r AS (SELECT p_partkey AS k, p_size - 2 AS line, '{"repo":"shop","language":"python","id":"' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'p' || p_partkey END || '"' || CASE WHEN p_partkey % 13 > 0 THEN ',"name":"' || p_name || '"' ELSE '' END || ',"line":' || (p_size - 2) || '}' AS text, p_name FROM part),
d AS (SELECT CASE WHEN k % 17 = 0 THEN substr('{' || p_name, 1, 9) ELSE text END AS record, CASE WHEN k % 17 = 0 THEN 'no record of this kind' WHEN k % 11 = 0 THEN 'no id' WHEN k % 13 = 0 THEN 'no name' WHEN line < 0 THEN 'line below 0' WHEN k % 5 = 1 AND line = 0 AND p_name < 'second' THEN 'repeated id' END AS reason FROM r
  UNION ALL SELECT '{"repo":"shop","language":"python","id":"p' || k || '","name":"second","line":0}', CASE WHEN line = 0 AND p_name < 'second' THEN NULL ELSE 'repeated id' END FROM r WHERE k % 5 = 1 AND k % 11 > 0 AND k % 13 > 0 AND k % 17 > 0 AND line >= 0),
c AS (SELECT CASE WHEN l_linenumber % 3 = 2 THEN 'neither bare nor attr' WHEN l_linenumber % 3 = 1 AND l_linenumber <= 3 THEN 'no object' END AS reason FROM lineitem)
SELECT 'definitions' AS kind, coalesce(reason, 'taken') AS reason, CASE WHEN reason IS NULL THEN '' ELSE record END AS record, COUNT(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'calls', coalesce(reason, 'taken'), '', COUNT(*) FROM c GROUP BY ALL"""
