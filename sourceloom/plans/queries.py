"""Registered queries of the graph operators: the given tables read as code graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators import changes, grouping, measures
from sourceloom.plans.tables import table, text_id


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers call the suppliers that they bought from, suppliers their nations, nations their regions; MAIN calls one segment's customers."""
    c, s, n, r = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation", "region"))
    node = lambda i, file, cls: (F.lit("trade").alias("repo"), i.alias("id"), i.alias("name"), file.alias("file"), cls.alias("class_name"), cls.alias("language"))
    none = F.lit(None).cast("string")
    nodes = (
        c.select(*node(text_id("c", "c_custkey"), text_id("n", "c_nationkey"), F.col("c_mktsegment")))
        .unionByName(s.select(*node(text_id("s", "s_suppkey"), text_id("n", "s_nationkey"), none)))
        .unionByName(n.select(*node(text_id("n", "n_nationkey"), text_id("n", "n_nationkey"), none)))
        .unionByName(r.select(*node(text_id("r", "r_regionkey"), none, none)))
    )
    edge = lambda a, b: (F.lit("trade").alias("repo"), a.alias("source"), b.alias("target"))
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = (
        bought.select(*edge(text_id("c", "o_custkey"), text_id("s", "l_suppkey"))).distinct()
        .unionByName(s.select(*edge(text_id("s", "s_suppkey"), text_id("n", "s_nationkey"))))
        .unionByName(n.select(*edge(text_id("n", "n_nationkey"), text_id("r", "n_regionkey"))))
        .unionByName(c.where("c_mktsegment = 'BUILDING'").select(*edge(F.lit(measures.MAIN), text_id("c", "c_custkey"))))
    )
    return nodes, edges


def graph_degrees(spark, sf_dir):
    return measures.degrees(*trade(spark, sf_dir)).drop("repo")


def graph_in_degrees(spark, sf_dir):
    return measures.in_degrees(*trade(spark, sf_dir)).drop("repo")


def graph_depth(spark, sf_dir):
    return measures.bfs_depth(*trade(spark, sf_dir)).select("id", "depth")


def graph_importance(spark, sf_dir):
    return measures.importance(*trade(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


def graph_quotient(spark, sf_dir):
    nodes, edges = trade(spark, sf_dir)
    groups = grouping.structural_groups(nodes, "file")
    opened = groups.where("cluster_id = 'n3'").select("repo", "cluster_id")
    return grouping.quotient_edges(edges, grouping.rendered_ids(groups, opened)).drop("repo")


def graph_languages(spark, sf_dir):
    nodes, _ = trade(spark, sf_dir)
    return grouping.language_breakdown(grouping.structural_groups(nodes, "file"), nodes).drop("repo").withColumn("fraction", F.round("fraction", 9))


def folder_counts(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.lit("web").alias("repo"), F.regexp_extract("url", r"^[^?#]*", 0).alias("file"))
    return grouping.folder_rollup(files).drop("repo")


def change_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as functions of their customer's file, by days, and lines as hunks of their quantity's length."""
    day = lambda c: F.datediff(F.col(c), F.lit("1995-01-01"))
    orders = table(spark, sf_dir, "orders").select(F.lit("shop").alias("repo"), F.col("o_orderkey").alias("id"), text_id("c", "o_custkey").alias("file"), day("o_orderdate").alias("line"))
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hunks = items.select(
        F.lit("shop").alias("repo"), text_id("c", "o_custkey").alias("file"), day("l_shipdate").alias("start"),
        (day("l_shipdate") + F.col("l_quantity").cast("int") - 1).alias("end"), (F.col("l_returnflag") == "R").alias("is_new"), (F.col("l_linestatus") == "F").alias("staged"),
    )
    return orders, hunks


def change_status(spark, sf_dir):
    orders, hunks = change_tables(spark, sf_dir)
    return changes.hunk_status(changes.node_ranges(orders), hunks).drop("repo")


def part_timeline(spark, sf_dir):
    orders, items, parts = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part"))
    first = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.min("o_orderdate").alias("ts"))
    rows = parts.join(first, F.col("p_partkey") == F.col("l_partkey"), "left")
    return changes.timeline_order(rows.select(F.lit("shop").alias("repo"), F.col("p_partkey").alias("id"), "ts")).drop("repo")


QUERIES = {f.__name__: f for f in (graph_importance, graph_degrees, graph_in_degrees, graph_depth, graph_quotient, graph_languages, folder_counts, change_status, part_timeline)}
