"""A stored graph: nodes by id, and calls by caller and by callee, bucketed and sorted alike, so that what joins or groups by those keys moves no stored row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators.measures import MAIN

BUCKETS = 64
TABLES = {"nodes": "id", "calls_out": "source", "calls_in": "target", "files": "file"}


class GraphStore:
    """The tables of one graph below a folder, known to the session's catalog by a name."""

    def __init__(self, spark: SparkSession, folder: str, name: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.name, self.buckets = spark, folder.rstrip("/"), name, buckets

    def save(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> None:
        """Replace what is stored. Library flags stay columns; scanned files without functions are kept in a table of their own. Each bucket is one file, written by one task."""
        rows = {"nodes": nodes, "calls_out": edges, "calls_in": edges, "files": files if files is not None else nodes.select("repo", "file").where("file is not null").distinct()}
        for table, key in TABLES.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
            dealt = rows[table].repartition(self.buckets, "repo", key)
            dealt.write.mode("overwrite").bucketBy(self.buckets, "repo", key).sortBy("repo", key).option("path", f"{self.folder}/{table}").saveAsTable(f"{self.name}_{table}")

    def open(self) -> GraphStore:
        """Tell the session's catalog of tables that another session has saved."""
        for table, key in TABLES.items():
            schema = self.spark.read.parquet(f"{self.folder}/{table}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
            self.spark.sql(f"CREATE TABLE {self.name}_{table} ({columns}) USING parquet CLUSTERED BY (repo, {key}) SORTED BY (repo, {key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{table}'")
        return self

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _calls(self, table: str) -> DataFrame:
        return self.table(table).where((F.col("source") != MAIN) & (F.col("target") != MAIN))

    def degrees(self) -> DataFrame:
        """(repo, id, out_degree, in_degree, degree), of all three stored tables without an exchange."""
        sides = [self._calls(t).groupBy("repo", F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(n)) for t, key, n in (("calls_out", "source", "out_degree"), ("calls_in", "target", "in_degree"))]
        rows = reduce(lambda a, b: a.join(b, ["repo", "id"], "left"), sides, self.table("nodes").select("repo", "id"))
        return rows.fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))

    def callees(self, front: DataFrame) -> DataFrame:
        """(repo, source, target) of the calls that ``front`` (repo, id) makes; only the front is moved to the buckets."""
        return self.table("calls_out").join(front.select("repo", F.col("id").alias("source")).distinct(), ["repo", "source"], "left_semi").select("repo", "source", "target")

    def quotient(self, rendered: DataFrame) -> DataFrame:
        """(repo, source, target, calls) between what nodes (repo, id, rendered) are shown as. The callers' side joins in its buckets; what it is shown as then moves to the callees."""
        to = lambda end: rendered.select("repo", F.col("id").alias(end), F.col("rendered").alias(f"{end}_r"))
        half = self._calls("calls_out").join(to("source"), ["repo", "source"]).groupBy("repo", "source_r", "target").agg(F.count(F.lit(1)).alias("calls"))
        rows = half.join(to("target"), ["repo", "target"]).where("source_r <> target_r").groupBy("repo", "source_r", "target_r").agg(F.sum("calls").alias("calls"))
        return rows.select("repo", F.col("source_r").alias("source"), F.col("target_r").alias("target"), "calls")
