"""Call graphs from fact tables, by joins on names.

``definitions``: (repo, language, id, name, file, line); ``imports``: (repo, language, file, local, module, ord); ``calls``: (repo, language, file,
caller_id, kind, obj, name) with kind ``bare`` for f() and ``attr`` for x.f(); ``entry_calls``: (repo, language, file, name). Languages resolve apart.
Calls are made distinct before they meet the definitions; a common name multiplies rows by design, and Spark may split its join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.measures import MAIN

SELF = ("self", "cls")
SIDE = 2048  # callers and definitions of a name that meet in one group
DEFINITION = ("repo", "language", "id", "name", "file", "line")


def clean_definitions(facts: DataFrame) -> DataFrame:
    """Facts of any extractor: rows without id or name go, an empty file counts as none, of an id that repeats the row of the largest line stays."""
    rows = facts.where("id is not null and name is not null and id <> '' and name <> ''").withColumn("file", F.nullif("file", F.lit("")))
    others = [c for c in rows.columns if c not in ("repo", "id")]
    best = rows.groupBy("repo", "id").agg(F.max_by(F.struct(*others), F.struct(F.coalesce("line", F.lit(0)), "name")).alias("row"))
    return best.select("repo", "id", "row.*").select(facts.columns)


def name_index(definitions: DataFrame) -> DataFrame:
    """(repo, language, name, ids): all definitions of a name, by id."""
    return definitions.groupBy("repo", "language", "name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolvable(calls: DataFrame, resolve_this: bool = False) -> DataFrame:
    """The calls that may mean a definition: f(), and x.f() where x is the object itself."""
    own = (F.col("language") == "python") & F.col("obj").isin(*SELF)
    if resolve_this:
        own = own | ((F.col("language") != "python") & (F.col("obj") == "this"))
    return calls.where((F.col("kind") == "bare") | ((F.col("kind") == "attr") & own))


def _once(rows: DataFrame) -> DataFrame:
    """Distinct rows, dealt out before they are compared: a task that reads calls holds none of them, and the others hold less the more shuffle partitions the session has, which are not coalesced here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns).distinct()


def resolve_calls(definitions: DataFrame, calls: DataFrame, resolve_this: bool = False) -> DataFrame:
    """(repo, source, target): each call to every definition of its name in the language."""
    wanted = _once(resolvable(calls, resolve_this).select("repo", "language", F.col("caller_id").alias("source"), "name"))
    targets = definitions.select("repo", "language", "name", F.col("id").alias("target"))
    return wanted.join(targets, ["repo", "language", "name"]).where("source <> target").select("repo", "source", "target").distinct()


def expand_names(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """(repo, source, target): the edges of ``resolve_calls`` from distinct ``wanted`` (repo, language, name, source), for names with very many callers and definitions.

    Callers and definitions of a name are dealt into groups of about ``SIDE``, and every two groups meet in a task of their own. The edges themselves are neither shuffled nor kept: an id with one
    name gets an edge once, and only edges to an id with several names, which may bring one twice, are made distinct.
    """
    key = ["repo", "language", "name"]
    targets = definitions.select(*key, F.col("id").alias("target")).distinct()
    several = targets.groupBy("repo", "target").agg((F.count(F.lit(1)) > 1).alias("several"))
    targets = targets.join(several, ["repo", "target"])
    groups = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SIDE).alias(name))
    sizes = groups(wanted, "callers").join(groups(targets, "called"), key)
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = wanted.join(sizes, key).select(*key, "source", dealt("source", "callers").alias("i"), every("called").alias("j"))
    right = targets.join(sizes, key).select(*key, "target", "several", every("callers").alias("i"), dealt("target", "called").alias("j"))
    met = lambda rows: left.join(rows, [*key, "i", "j"]).where("source <> target").select("repo", "source", "target")
    return met(right.where("not several")).unionByName(met(right.where("several")).distinct())


def factored_degrees(definitions: DataFrame, calls: DataFrame, resolve_this: bool = False) -> DataFrame:
    """(repo, id, in_degree, out_degree, degree) of every definition in the graph of ``resolve_calls``, without its edges.

    The edges are, name by name, all callers times all definitions, less what calls itself. So a definition is called by the callers of its name, and a caller calls as many as its names have
    definitions: counts of one side joined to rows of the other. A name with very many callers and definitions costs their sum, not their product.
    """
    key = ["repo", "language", "name"]
    wanted = _once(resolvable(calls, resolve_this).select(*key, F.col("caller_id").alias("id")))
    targets = definitions.select(*key, "id").distinct()
    own = wanted.join(targets, [*key, "id"], "left_semi").select("repo", "id", F.lit(-1).cast("long").alias("in_degree"), F.lit(-1).cast("long").alias("out_degree"))
    called = targets.join(wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("in_degree")), key).select("repo", "id", "in_degree", F.lit(0).cast("long").alias("out_degree"))
    calling = wanted.join(targets.groupBy(*key).agg(F.count(F.lit(1)).alias("out_degree")), key).select("repo", "id", F.lit(0).cast("long").alias("in_degree"), "out_degree")
    sums = own.unionByName(called).unionByName(calling).groupBy("repo", "id").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    rows = definitions.select("repo", "id").distinct().join(sums, ["repo", "id"], "left").fillna(0, ["in_degree", "out_degree"])
    return rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def bindings(imports: DataFrame) -> DataFrame:
    """(repo, language, file, local, module): the last binding of a name in its file."""
    return imports.groupBy("repo", "language", "file", "local").agg(F.max_by("module", F.struct("ord", "module")).alias("module"))


def resolve_library_calls(definitions: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library nodes (repo, id, name, file, line, language, is_library, library_name) and edges (repo, source, target).

    f() and x.f() are library calls where their file binds f or x by an import and no definition of the language has that name.
    """
    local = F.when(F.col("kind") == "bare", F.col("name")).otherwise(F.col("obj"))
    asked = calls.where("kind in ('bare', 'attr')").select("repo", "language", "file", F.col("caller_id").alias("source"), local.alias("local"), "name").distinct()
    known = definitions.select("repo", "language", F.col("name").alias("local")).distinct()
    found = asked.join(bindings(imports), ["repo", "language", "file", "local"]).join(known, ["repo", "language", "local"], "left_anti")
    rows = found.select("repo", "language", "source", "name", "module", F.concat_ws("::", F.lit("library"), "module", "name").alias("target"))
    nodes = rows.groupBy("repo", F.col("target").alias("id")).agg(F.min("name").alias("name"), F.min("language").alias("language"), F.min("module").alias("library_name"))
    nodes = nodes.select("repo", "id", "name", F.lit(None).cast("string").alias("file"), F.lit(0).alias("line"), "language", F.lit(True).alias("is_library"), "library_name")
    return nodes, rows.select("repo", "source", "target").distinct()


def entry_points(definitions: DataFrame, entry_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MAIN nodes (repo, id, name), for repos with an entry only, and edges (repo, source, target) from MAIN to every definition that an entry call names."""
    names = entry_calls.select("repo", "language", "name").distinct()
    edges = definitions.join(names, ["repo", "language", "name"], "left_semi").select("repo", F.lit(MAIN).alias("source"), F.col("id").alias("target")).distinct()
    return edges.select("repo", F.lit(MAIN).alias("id"), F.lit("MAIN").alias("name")).distinct(), edges


def call_graph(definitions: DataFrame, imports: DataFrame, calls: DataFrame, entry_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of definitions, MAIN and library functions, as a sink writes them."""
    libraries, library_edges = resolve_library_calls(definitions, imports, calls)
    mains, entry_edges = entry_points(definitions, entry_calls)
    own = definitions.select(*DEFINITION).withColumn("is_library", F.lit(False))
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (own, mains.withColumn("is_library", F.lit(False)), libraries))
    inner = resolve_calls(definitions, calls).unionByName(entry_edges).withColumn("is_library", F.lit(False))
    return nodes, inner.unionByName(library_edges.withColumn("is_library", F.lit(True)))


def union_graphs(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one, without resolution between them."""
    nodes, edges = zip(*graphs)
    both = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both(nodes), both(edges)


def inheritance_edges(classes: DataFrame) -> DataFrame:
    """(repo, source, target, kind) between class keys: a class and each class of the name that it extends or implements."""
    rows = classes.select("repo", "class_key", F.explode(F.concat(
        F.array(F.struct(F.col("class_extends").alias("name"), F.lit("extends").alias("kind"))),
        F.transform(F.coalesce("class_implements", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit("implements").alias("kind"))),
    )).alias("p")).where("p.name is not null")
    wanted = rows.select("repo", F.col("class_key").alias("source"), F.col("p.name").alias("class_name"), F.col("p.kind").alias("kind"))
    return wanted.join(classes.select("repo", "class_name", F.col("class_key").alias("target")), ["repo", "class_name"]).where("source <> target").select("repo", "source", "target", "kind").distinct()


def doc_comments(wanted: DataFrame, declarations: DataFrame) -> DataFrame:
    """(package, name, doc) for ``wanted`` (package, name): the first commented declaration of the function in a package's files, '' without one.

    ``declarations``: (package, rank, file, text); files are tried by rank, then name. A comment block belongs to a function whose name and ``(`` or ``<``
    follow within 300 characters; tag lines and empty lines are left out, and a block without other lines is passed over. Lines are joined by line ends. The pattern repeats
    single characters only, so a comment of any length needs no stack.
    """
    found = lambda k: F.regexp_extract_all("text", F.lit(r"(?s)(/\*\*.*?\*/)(?=(.{0,300}))"), F.lit(k))
    blocks = declarations.select("package", "rank", "file", F.posexplode(found(1)).alias("pos", "block"), found(2).alias("after"))
    lines = F.transform(F.split(F.regexp_replace("block", r"^/\*\*|\*/$", ""), r"\n"), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s*\*\s?", ""), r"^\s+|\s+$", ""))
    doc = F.array_join(F.filter(lines, lambda s: (s != "") & ~s.startswith("@")), "\n")
    rows = blocks.select("package", "rank", "file", "pos", doc.alias("doc"), F.try_element_at("after", F.col("pos") + 1).alias("after")).where("doc <> ''")
    names = rows.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("after", F.lit(r"([A-Za-z_$][\w$]*)\s*[(<]"), F.lit(1)))))
    best = names.groupBy("package", "name").agg(F.min_by("doc", F.struct("rank", "file", "pos")).alias("doc"))
    return wanted.join(best, ["package", "name"], "left").select("package", "name", F.coalesce("doc", F.lit("")).alias("doc"))
