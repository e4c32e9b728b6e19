"""Registered queries of detail levels, views, folders, changes, time and extents, over the trade graph and the other given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom import streaming
from sourceloom.functions import effective_status, path_dirname
from sourceloom.operators import changes, clustering, extents, forests, grouping, hierarchy, measures, views
from sourceloom.plans.durable import Workspace
from sourceloom.plans.tables import table, text_id

LEVEL = 0.4


def sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph for each order priority, of customers and the suppliers that they bought from; the scores are balances, the file is the nation."""
    orders, items, c, s = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer", "supplier"))
    bought = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = bought.select(F.col("o_orderpriority").alias("repo"), text_id("c", "o_custkey").alias("source"), text_id("s", "l_suppkey").alias("target")).distinct()
    edges = Workspace(spark).keep(edges)
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("id")).distinct()
    known = c.select(text_id("c", "c_custkey").alias("id"), text_id("n", "c_nationkey").alias("file"), F.col("c_acctbal").alias("score")).unionByName(
        s.select(text_id("s", "s_suppkey").alias("id"), text_id("n", "s_nationkey").alias("file"), F.col("s_acctbal").alias("score"))
    )
    nodes = Workspace(spark).keep(ends.join(known, "id").withColumn("name", F.col("id")))
    return nodes.drop("score"), edges, nodes.select("repo", "id", "score")


def forest_sizes(spark, sf_dir):
    nodes, edges, scores = sales(spark, sf_dir)
    return clustering.spanning_forest(nodes, edges, scores).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def detail_clusters(spark, sf_dir):
    nodes, edges, scores = sales(spark, sf_dir)
    return clustering.cluster_by_connectivity(nodes, edges, scores, LEVEL).groupBy("repo").agg(F.countDistinct("cluster_id").alias("n_clusters"))


def _ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph for each market segment: a customer's orders call the next one by date, and a hub a customer calls all of them, by edges that are heavier and close circles."""
    from pyspark.sql import Window

    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("repo"))
    o = table(spark, sf_dir, "orders").join(segments, "o_custkey").withColumn("id", text_id("o", "o_orderkey")).withColumn("hub", text_id("c", "o_custkey"))
    following = F.lead("id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = o.select("repo", F.col("id").alias("source"), following.alias("target")).where("target is not null").unionByName(o.select("repo", F.col("hub").alias("source"), F.col("id").alias("target")))
    hubs = o.select("repo", F.col("hub").alias("id"), F.lit(None).cast("string").alias("file"), (F.col("o_custkey") + 1e7).alias("score")).distinct()
    nodes = o.select("repo", "id", F.col("o_orderpriority").alias("file"), F.col("o_totalprice").cast("double").alias("score")).unionByName(hubs)
    nodes = Workspace(spark).keep(nodes)
    return nodes.select("repo", "id", "file"), edges, nodes.select("repo", "id", "score")


def detail_levels(spark, sf_dir):
    """The assignment at nine levels from one merge tree."""
    nodes, edges, scores = _ledgers(spark, sf_dir)
    edges = Workspace(spark).keep(edges)
    tree = forests.merge_tree(clustering.spanning_forest(nodes, edges, scores))
    return clustering.cluster_levels(nodes, tree, [k / 10 for k in range(1, 10)])


def detail_expanded(spark, sf_dir):
    """A view of the ledgers at level 0.4 with some clusters and one library package open: every order uses a library of its status, packaged by its priority."""
    nodes, edges, scores = _ledgers(spark, sf_dir)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    used = o.select(F.col("c_mktsegment").alias("repo"), text_id("o", "o_orderkey").alias("source"), F.concat_ws("::", F.lit("library"), "o_orderpriority", "o_orderstatus").alias("target"), F.col("o_orderpriority").alias("library_name"), F.col("o_orderstatus").alias("name"))
    shelf = used.select("repo", F.col("target").alias("id"), "name", F.lit(None).cast("string").alias("file"), F.lit("python").alias("language"), F.lit(True).alias("is_library"), "library_name").distinct()
    all_nodes = nodes.withColumn("name", F.upper("id")).withColumn("is_library", F.lit(False)).unionByName(shelf, allowMissingColumns=True)
    all_edges = edges.withColumn("is_library", F.lit(False)).unionByName(used.select("repo", "source", "target", F.lit(True).alias("is_library")))
    expanded = nodes.where("id like '%7'").select("repo", F.col("id").alias("cluster_id"))
    packages = shelf.where("library_name like '1%'").select("repo", "library_name")
    shown, links = clustering.detail_view(all_nodes, all_edges, LEVEL, expanded=expanded, packages=packages, scores=scores)
    rows = shown.select("repo", "id", "label", F.round("size", 6).alias("size"), "n", "is_library")
    none = F.lit(None).cast("double")
    return rows.unionByName(links.select("repo", F.col("source").alias("id"), F.col("target").alias("label"), none.alias("size"), F.lit(0).cast("long").alias("n"), "is_library"))


def graph_components(spark, sf_dir):
    """Customers and the parts of their first order's first line: a graph of many components."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k"))
    calls = items.join(first, F.col("l_orderkey") == F.col("k")).where("l_linenumber = 1")
    edges = calls.select(F.lit("shop").alias("repo"), text_id("c", "o_custkey").alias("source"), text_id("p", "l_partkey").alias("target"))
    nodes = table(spark, sf_dir, "customer").select(F.lit("shop").alias("repo"), text_id("c", "c_custkey").alias("id")).unionByName(table(spark, sf_dir, "part").select(F.lit("shop").alias("repo"), text_id("p", "p_partkey").alias("id")))
    return clustering.connected_components(nodes, edges).drop("repo")


def trade_components(spark, sf_dir):
    """All orders and lines: an order holds its lines' parts, and its customer and suppliers; regions stand alone."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    end = lambda mark, key: text_id(mark, key)
    shop = F.lit("shop").alias("repo")
    held = F.explode(F.array(end("p", "l_partkey"), end("s", "l_suppkey"))).alias("target")  # both edges of a line in one task
    edges = items.select(shop, end("o", "l_orderkey").alias("source"), held).unionByName(orders.select(shop, end("o", "o_orderkey").alias("source"), end("c", "o_custkey").alias("target")))
    tables = (("orders", "o", "o_orderkey"), ("part", "p", "p_partkey"), ("supplier", "s", "s_suppkey"), ("customer", "c", "c_custkey"), ("region", "r", "r_regionkey"))
    nodes = None
    for name, mark, key in tables:
        rows = table(spark, sf_dir, name).select(shop, end(mark, key).alias("id"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    return clustering.connected_components(nodes, edges).drop("repo")


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer's orders call the next one by date; MAIN calls the first ones: as deep as a customer has orders."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select(F.lit("shop").alias("repo"), text_id("o", "o_orderkey").alias("source"), F.lead(text_id("o", "o_orderkey")).over(order).alias("target"), F.row_number().over(order).alias("k"))
    rows = Workspace(spark).keep(rows)
    main = rows.where("k = 1").select("repo", F.lit(measures.MAIN).alias("source"), F.col("source").alias("target"))
    return rows.select("repo", F.col("source").alias("id")), rows.where("target is not null").select("repo", "source", "target").unionByName(main)


def chain_depth(spark, sf_dir):
    return measures.bfs_depth(*chains(spark, sf_dir), kept=True).select("id", "depth")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, id, file, language, name, class_name): a node a page; the file is its address without query, its class a host's section."""
    p = table(spark, sf_dir, "pages")
    file = F.regexp_extract("url", r"^[^?#]*", 0)
    language = F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit(""))
    section = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("C"), (F.col("page_id") % 5).cast("string")))
    return p.select(F.lit("web").alias("repo"), text_id("p", "page_id").alias("id"), file.alias("file"), language.alias("language"), text_id("page ", "page_id").alias("name"), section.alias("class_name"))


def page_languages(spark, sf_dir):
    return views.languages(_pages(spark, sf_dir))


def structural_clusters(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    out = [clustering.cluster_by_structure(pages, mode, LEVEL)[0].groupBy("repo").agg(F.countDistinct("cluster_id").alias("n"), F.count(F.lit(1)).alias("members")).withColumn("mode", F.lit(mode)) for mode in ("file", "class")]
    return out[0].unionByName(out[1])


def structural_assignment(spark, sf_dir):
    """The cluster and the label of every page at a level that takes one length of common path whole and a part of the next."""
    assignment, labels = clustering.cluster_by_structure(_pages(spark, sf_dir), "file", LEVEL)
    return assignment.join(labels, ["repo", "cluster_id"]).select("id", "cluster_id", "label")


def class_groups(spark, sf_dir):
    return grouping.structural_groups(_pages(spark, sf_dir), "class").select("id", "cluster_id")


def project_names(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    host = F.regexp_extract("file", r"^https?://([^/]*)", 1)
    return clustering.project_name(pages.withColumn("repo", host).unionByName(pages))


def cluster_view(spark, sf_dir):
    nodes, edges, scores = sales(spark, sf_dir)
    groups = grouping.structural_groups(nodes, "file").withColumn("cluster_id", F.when(F.col("id").startswith("s"), F.col("id")).otherwise(F.col("cluster_id")))
    return clustering.cluster_nodes(groups, nodes, edges, scores, LEVEL).select("repo", "id", "label", "n", F.round("size", 6).alias("size"), "is_cluster", "file")


def detail_view(spark, sf_dir):
    """The trade graph with regions as a library, at the level at which every node stands alone."""
    nodes, edges = _with_libraries(spark, sf_dir)
    shown, links = clustering.detail_view(nodes, edges, 1.0)
    return shown.select("id", "label", F.round("size", 6).alias("size"), "is_entry", "is_library").unionByName(links.select("source", "target", F.lit(None).cast("double"), F.lit(None).cast("boolean"), "is_library").toDF("id", "label", "size", "is_entry", "is_library"))


def _with_libraries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from sourceloom.plans.queries import trade

    nodes, edges = trade(spark, sf_dir)
    library = F.col("id").startswith("r")
    return nodes.withColumn("is_library", library).withColumn("library_name", F.when(library, F.lit("regions"))), edges.withColumn("is_library", F.col("target").startswith("r"))


def project_degrees(spark, sf_dir):
    return measures.degrees(*measures.project_subgraph(*_with_libraries(spark, sf_dir))).drop("repo")


def orphans(spark, sf_dir):
    nodes, edges = _with_libraries(spark, sf_dir)
    few = edges.where(F.col("source").rlike("^c[0-9]*7$") | F.col("source").startswith("n"))
    return nodes.join(measures.connected_nodes(nodes, few), ["repo", "id"], "left_anti").select("id")


def auto_levels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("id"))
    c = table(spark, sf_dir, "nation").select(F.lit("nations").alias("repo"), F.col("n_nationkey").cast("long").alias("id"))
    return measures.auto_level(o.unionByName(c)).withColumn("level", F.round("level", 9))


def ego_links(spark, sf_dir):
    nodes, edges = _with_libraries(spark, sf_dir)
    return views.ego_edges(edges.select("repo", "source", "target"), nodes.where("id in ('s1', 's2', 'n3')")).drop("repo")


def cluster_labels(spark, sf_dir):
    nodes, edges, scores = sales(spark, sf_dir)
    return clustering.cluster_names(grouping.structural_groups(nodes, "file"), nodes, scores, LEVEL)


def view_filters(spark, sf_dir):
    """How many nodes each filter lets pass, of pages and their hosts' library."""
    pages = _pages(spark, sf_dir).withColumn("line", F.when(F.col("id").endswith("4"), 0).otherwise(1)).withColumn("is_library", F.col("id").endswith("9")).withColumn("label", F.upper("name"))
    edges = pages.where("class_name is not null").select("repo", F.col("id").alias("source"), F.col("id").alias("target"))
    folder = F.regexp_extract("file", r"^https?://[^/]*", 0)
    first = pages.agg(F.min(folder)).first()[0]
    seen = pages.where("not id like '%1'").select("repo", "id")
    cases = {"search": {"query": "Page 1"}, "no_libraries": {"libraries": False}, "existing": {"existing_only": True}, "no_orphans": {"orphans": False}, "only": {"only_folder": first}, "hidden": {"hidden_folders": (first,)}, "time": {"seen": seen}}
    out = [views.visible_nodes(pages, edges, **options).select(F.lit(name).alias("filter"), "id") for name, options in cases.items()]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def folders_hidden(spark, sf_dir):
    """Pages outside a table of hidden folders, those of every seventh page, and inside a table of shown hosts."""
    pages = _pages(spark, sf_dir).withColumn("label", F.col("name"))
    sections = pages.where(F.expr("int(substring(id, 2)) % 7 = 0")).select("repo", path_dirname(F.col("file")).alias("folder")).distinct()
    hosts = pages.where("id not like '%5'").select("repo", F.regexp_extract("file", r"^https?://[^/]*", 0).alias("folder")).distinct()
    return views.visible_nodes(pages, pages, shown=hosts, hidden=sections).select("id", "file")


def visible_links(spark, sf_dir):
    nodes, edges = _with_libraries(spark, sf_dir)
    return measures.visible_edges(edges, nodes.where("not id like '%3'")).select("source", "target")


def file_rollup(spark, sf_dir):
    """Files of parts by brand, and scanned files of suppliers, some without nodes."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nodes = part.select(F.lit("shop").alias("repo"), text_id("p", "p_partkey").alias("id"), F.concat(F.col("p_brand"), F.lit(".js")).alias("file"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("language"), (F.col("p_size") == 50).alias("is_library"))
    files = supplier.select(F.lit("shop").alias("repo"), F.concat(text_id("s", "s_suppkey"), F.when(F.col("s_nationkey") > 5, ".py").otherwise(".md")).alias("file"))
    return hierarchy.files_rollup(nodes, files).drop("repo")


def class_rollup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.lit("shop").alias("repo"), text_id("p", "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("class_name"), F.col("p_name").alias("class_extends"))
    return hierarchy.classes_rollup(nodes).select("class_key", "class_extends", F.array_join("members", ",").alias("members"))


def folder_tree(spark, sf_dir):
    return hierarchy.folder_tree(_pages(spark, sf_dir)).drop("repo")


def folder_pages(spark, sf_dir):
    return hierarchy.folder_nodes(_pages(spark, sf_dir)).drop("repo")


def folder_siblings(spark, sf_dir):
    return hierarchy.sibling_folders(hierarchy.folder_tree(_pages(spark, sf_dir))).drop("repo")


def parsed_status(spark, sf_dir):
    """A status text a nation, of its customers: two letters by balance, and a rename's old path."""
    c = table(spark, sf_dir, "customer")
    code = F.element_at(F.array(*(F.lit(x) for x in ("M ", " M", "A ", " D", "??", "RM", "D ", "AM"))), (F.col("c_custkey") % 8 + 1).cast("int"))
    entry = F.concat(code, F.lit(" "), text_id("src\\c", "c_custkey"), F.when(code == "RM", F.concat(F.lit("\x00"), text_id("old/c", "c_custkey"))).otherwise(""))
    texts = c.select("c_nationkey", F.struct("c_custkey", entry.alias("e")).alias("x")).groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\x00").alias("text"))
    found = changes.parse_status(texts.select(text_id("n", "c_nationkey").alias("repo"), F.lit("/ws/").alias("root"), "text"))
    return found.withColumn("effective", effective_status(F.struct("unstaged", "staged")))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff text an order: a file a line number, with a hunk of its quantity's lines; one path holds a blank, so a tab follows it, and one line ends with a carriage return."""
    i = table(spark, sf_dir, "lineitem")
    old = F.when(F.col("l_returnflag") == "R", "5,0").otherwise("5")
    new = F.when(F.col("l_quantity") == 1, F.col("l_linenumber").cast("string")).otherwise(F.concat_ws(",", F.col("l_linenumber").cast("string"), F.floor(F.col("l_quantity") / 10).cast("string")))
    one = F.concat(F.lit("diff\n--- a/x\n+++ b/f"), F.when(F.col("l_linenumber") == 2, " ").otherwise(""), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 2, "\t").when(F.col("l_linenumber") == 3, "\r").otherwise(""), F.lit("\n@@ -"), old, F.lit(" +"), new, F.lit(" @@ def\n-x"))
    rows = i.select("l_orderkey", F.struct("l_linenumber", one.alias("e")).alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\n").alias("text"))
    return rows.select(text_id("o", "l_orderkey").alias("repo"), F.lit("/ws").alias("root"), F.lit(False).alias("staged"), F.concat(F.lit("@@ -1 +1 @@\n"), F.col("text")).alias("text"))


def parsed_diff(spark, sf_dir):
    return changes.parse_diff(_diffs(spark, sf_dir)).groupBy("repo", "file", "start", "end", "is_new").agg(F.count(F.lit(1)).alias("n"))


def parsed_blame(spark, sf_dir):
    """A blame text a customer: a line an order, the commit by its date's month; its time stands at the month's first line."""
    o = table(spark, sf_dir, "orders")
    sha = lambda x: F.sha1(F.date_format(x["o_orderdate"], "yyyy-MM"))
    time = lambda x: (F.datediff(F.trunc(x["o_orderdate"], "month"), F.lit("1970-01-01")).cast("long") * 86400).cast("string")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate"))).alias("orders")).withColumn("shas", F.transform("orders", sha))

    def entry(x, k):
        first = F.array_position("shas", sha(x)) == k + 1
        return F.concat(sha(x), F.lit(" 1 "), (k + 1).cast("string"), F.when(first, F.concat(F.lit(" 1\nauthor x\nauthor-time "), time(x), F.lit("\n"))).otherwise("\n"), F.lit("\tauthor-time 5"))

    texts = rows.select("o_custkey", F.array_join(F.transform("orders", entry), "\n").alias("text"))
    return changes.parse_blame(texts.select(F.lit("shop").alias("repo"), text_id("c", "o_custkey").alias("file"), "text")).drop("repo")


def introduced(spark, sf_dir):
    blame = parsed_blame(spark, sf_dir).withColumn("repo", F.lit("shop"))
    nodes = table(spark, sf_dir, "customer").select(F.lit("shop").alias("repo"), text_id("n", "c_custkey").alias("id"), text_id("c", "c_custkey").alias("file"), (F.col("c_custkey") % 12).cast("int").alias("line"))
    return changes.introduction_times(nodes, blame).drop("repo")


def attributed_changes(spark, sf_dir):
    """Orders are functions of their customer's file, lines are hunks, and the segment gives the file's status."""
    from sourceloom.plans.queries import change_tables

    nodes, hunks = change_tables(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    unstaged = F.when(F.col("c_mktsegment") == "BUILDING", "added").when(F.col("c_mktsegment") == "MACHINERY", "deleted").when(F.col("c_mktsegment") == "HOUSEHOLD", "modified")
    status = c.where("c_mktsegment <> 'AUTOMOBILE'").select(F.lit("shop").alias("repo"), text_id("c", "c_custkey").alias("file"), unstaged.alias("unstaged"), F.when(F.col("c_acctbal") > 0, "modified").alias("staged"))
    return changes.attribute_changes(nodes, status, hunks).drop("repo")


def _timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts by first order, their brands as libraries, and calls between parts of one supplier in the order of keys and to brands."""
    from pyspark.sql import Window

    from sourceloom.plans.queries import part_timeline

    part = table(spark, sf_dir, "part")
    order = part_timeline(spark, sf_dir).select(F.lit("shop").alias("repo"), text_id("p", "id").alias("id"), "idx")
    brands = part.select(F.lit("shop").alias("repo"), text_id("p", "p_partkey").alias("source"), F.col("p_brand").alias("target"))
    lead = F.lead(text_id("p", "l_partkey")).over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))
    calls = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().select(F.lit("shop").alias("repo"), text_id("p", "l_partkey").alias("source"), lead.alias("target")).where("target is not null")
    return order, brands, calls


def library_first_seen(spark, sf_dir):
    order, brands, _ = _timeline(spark, sf_dir)
    return changes.library_appearance(order, brands).drop("repo")


def snapshot_counts(spark, sf_dir):
    order, brands, calls = _timeline(spark, sf_dir)
    nodes = order.select("repo", "id", F.lit(False).alias("is_library")).unionByName(brands.select("repo", F.col("target").alias("id"), F.lit(True).alias("is_library")).distinct())
    there, links = changes.snapshot(nodes, calls.unionByName(brands), order, changes.library_appearance(order, brands), 150)
    return there.select("id", F.lit("node").alias("kind")).unionByName(links.select(F.concat_ws(">", "source", "target").alias("id"), F.lit("edge").alias("kind")))


def edge_growth(spark, sf_dir):
    order, _, calls = _timeline(spark, sf_dir)
    return changes.growth(order, calls).drop("repo")


def brand_centroids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ids = part.select(F.lit("shop").alias("repo"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster_id"))
    places = part.select(F.lit("shop").alias("repo"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 2, F.col("p_size").cast("double")).alias("x"), F.col("p_retailprice").alias("y"))
    return extents.centroids(ids, places).select("cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    file = F.concat_ws("/", F.lit("ws"), "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("f.py"))
    return extents.bounding_circles(part.select(F.lit("shop").alias("repo"), file.alias("file"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), "file")


def file_circles(spark, sf_dir):
    return _circles(spark, sf_dir).select("file", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "r")))


def folder_boxes(spark, sf_dir):
    return extents.folder_extents(_circles(spark, sf_dir)).select("folder", *(F.round(c, 5).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("repo", F.lit("web")).withColumn("id", text_id("u", "user_id"))


def feed_debounce(spark, sf_dir):
    return streaming.debounce(_events(spark, sf_dir), "user_id", "6 hours").select("user_id", _stamp("fire_at").alias("fire_at"), "n")


def feed_status(spark, sf_dir):
    return streaming.latest_status(_events(spark, sf_dir).withColumn("status", F.col("event_type"))).select("id", "status", _stamp("ts").alias("ts"))


def feed_first_seen(spark, sf_dir):
    return streaming.first_seen(_events(spark, sf_dir)).select("id", _stamp("ts").alias("ts"))


def feed_edges(spark, sf_dir):
    edges = _events(spark, sf_dir).withColumn("source", F.col("id")).withColumn("target", F.col("event_type"))
    return streaming.stream_edges(edges).select("source", "target", _stamp("ts").alias("ts"))


def feed_routes(spark, sf_dir):
    saved = _events(spark, sf_dir).withColumn("file", F.concat("event_type", F.element_at(F.array(*(F.lit(x) for x in (".py", ".md", ".tsx", ""))), (F.col("event_id") % 4 + 1).cast("int"))))
    return streaming.change_feed(saved).groupBy("file", "route").agg(F.count(F.lit(1)).alias("n"))


def feed_replaced(spark, sf_dir):
    """Facts of users' events; a day's users are saved anew, and the facts of their purchases alone come back."""
    e = _events(spark, sf_dir)
    facts = e.select("repo", F.col("id").alias("file"), F.col("event_type").alias("name")).distinct()
    changed = e.where("ts < timestamp'2024-01-02'").select("repo", F.col("id").alias("file"))
    fresh = facts.join(changed.distinct(), ["repo", "file"], "left_semi").where("name = 'purchase'")
    return streaming.replace_facts(facts, changed, fresh).drop("repo")


QUERIES = {f.__name__: f for f in (
    forest_sizes, detail_clusters, detail_levels, detail_expanded, graph_components, trade_components, chain_depth, page_languages, structural_clusters, structural_assignment, class_groups, project_names, cluster_view, detail_view, project_degrees, orphans, auto_levels,
    ego_links, cluster_labels, view_filters, folders_hidden, visible_links, file_rollup, class_rollup, folder_tree, folder_pages, folder_siblings, parsed_status, parsed_diff, parsed_blame, introduced, attributed_changes,
    library_first_seen, snapshot_counts, edge_growth, brand_centroids, file_circles, folder_boxes, feed_debounce, feed_status, feed_first_seen, feed_edges, feed_routes, feed_replaced,
)}
