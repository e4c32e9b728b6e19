"""A call graph that follows saved files: facts and edges as logs of signed rows, and delta joins that touch only the names that a batch changes.

The log of edges holds library edges whole and the others as their first half: a caller and the name that it calls. They meet the definitions when edges are read, since a name with many
callers and many definitions has as many edges as their product, and each new definition would write one for every caller.

Each log is a folder of Parquet tables, one a batch; a row's count is the sum of its ``n``. A batch takes the facts of its files off and puts their fresh ones on, resolves the names that
differ, and writes what changes of definitions, imports, calls and edges. The count of an edge or half is the number of ways in which calls support it, and it is there while that is above 0.
A batch that runs again overwrites its own tables and reads only the batches before it, so a stream may repeat one. ``fold`` sums a log's batches into one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators import resolution

FACTS = {
    "definitions": ("repo string, language string, id string, name string, file string", ("repo", "language", "id", "name", "file")),
    "imports": ("repo string, language string, file string, local string, module string, ord long", ("repo", "language", "file", "local", "module", "ord")),
    "calls": ("repo string, language string, file string, caller_id string, kind string, obj string, name string", ("repo", "language", "file", "caller_id", "kind", "obj", "name")),
}
EDGES = "repo string, language string, name string, source string, target string, is_library boolean"
NAME = ["repo", "language", "name"]


def _summed(rows: DataFrame) -> DataFrame:
    """Signed rows as one row each, without those that cancel."""
    return rows.groupBy(*(c for c in rows.columns if c != "n")).agg(F.sum("n").alias("n")).where("n <> 0")


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("n", F.col("n") * sign)


def _local() -> Column:
    return F.when(F.col("kind") == "bare", F.col("name")).otherwise(F.col("obj"))


def _library_rows(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, language, local, source, target, n): what calls would support if no definition had the name, by the last binding of their file."""
    asked = calls.where("kind in ('bare', 'attr')").select("repo", "language", "file", _local().alias("local"), "name", F.col("caller_id").alias("source"), "n")
    rows = asked.join(resolution.bindings(imports), ["repo", "language", "file", "local"])
    return rows.select("repo", "language", "local", "source", F.concat_ws("::", F.lit("library"), "module", "name").alias("target"), "n")


class IncrementalGraph:
    """The logs of one graph below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _store(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _tables(self, name: str, before: int | None) -> tuple[list[str], list[str]]:
        """The tables that a log is made of, and those that a folded one, named by its last batch and an ``f``, has replaced. A table without its mark of success does not count."""
        path, store = self._store(f"{self.folder}/{name}")
        found = [s.getPath() for s in store.listStatus(path)] if store.exists(path) else []
        done = [(int(p.getName().rstrip("f")), p.getName().endswith("f"), p.toString()) for p in found if store.exists(self._store(f"{p.toString()}/_SUCCESS")[0])]
        done = [x for x in sorted(done) if before is None or x[0] < before]
        base = max((k for k, folded, _ in done if folded), default=-1)
        used = [p for k, folded, p in done if k > base or (k == base and folded)]
        return used, [p for *_, p in done if p not in used]

    def log(self, name: str, before: int | None = None) -> DataFrame:
        """The signed rows of a log, of the batches before one if that is given."""
        schema = f"{EDGES if name == 'edges' else FACTS[name][0]}, n long"
        paths, _ = self._tables(name, before)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def facts(self, name: str, before: int | None = None) -> DataFrame:
        return _summed(self.log(name, before))

    def edges(self) -> DataFrame:
        """(repo, source, target, is_library) of the edges that are there."""
        there = _summed(self.log("edges")).where("n > 0")
        inner = resolution.expand_names(there.where("not is_library").select(*NAME, "source"), self.facts("definitions"))
        return inner.withColumn("is_library", F.lit(False)).unionByName(there.where("is_library").select("repo", "source", "target", "is_library"))

    def _put(self, name: str, number: int | str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def apply(self, number: int, changed: DataFrame, definitions: DataFrame, imports: DataFrame, calls: DataFrame) -> None:
        """One batch: ``changed`` (repo, file) are the saved files, and the others the facts that they hold now."""
        files = changed.select("repo", "file").distinct()
        held, delta, fresh = {}, {}, {}
        for name, rows in (("definitions", definitions), ("imports", imports), ("calls", calls)):
            columns = FACTS[name][1]
            old = _summed(self.log(name, number).join(files, ["repo", "file"], "left_semi").select(*columns, "n"))
            fresh[name] = rows.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            delta[name] = self._put(name, number, _summed(_signed(old, -1).unionByName(fresh[name])))
            held[name] = old
        self._put("edges", number, _summed(self._halves(delta).unionByName(self._libraries(number, files, delta, held, fresh))))

    def _halves(self, delta: dict[str, DataFrame]) -> DataFrame:
        """Callers and the names that they call, where calls change; definitions that change meet them when edges are read."""
        none = F.lit(None).cast("string")
        return resolution.resolvable(delta["calls"]).select(*NAME, F.col("caller_id").alias("source"), none.alias("target"), F.lit(False).alias("is_library"), "n")

    def _libraries(self, number: int, files: DataFrame, delta: dict[str, DataFrame], held: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> DataFrame:
        """What the saved files' own calls supported goes and what they support comes; elsewhere, the calls of names that get their first definition go and those of names that lost their last one come."""
        own = delta["definitions"].groupBy(*NAME).agg(F.sum("n").alias("d"))
        asked = held["calls"].unionByName(fresh["calls"]).select("repo", "language", _local().alias("name")).unionByName(own.select(*NAME)).distinct()
        count = self.log("definitions", number).join(asked, NAME, "left_semi").groupBy(*NAME).agg(F.sum("n").alias("was"))
        known = asked.join(count, NAME, "left").join(own, NAME, "left").select(*NAME, F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("now"))
        known = known.withColumnRenamed("name", "local")
        free = lambda rows, when: rows.join(known.where(F.col(when) > 0), ["repo", "language", "local"], "left_anti")
        gone = _signed(free(_library_rows(held["calls"], held["imports"]), "was"), -1)
        come = free(_library_rows(fresh["calls"], fresh["imports"]), "now")
        turned = known.where("(was > 0) <> (now > 0)").select("repo", "language", "local", F.when(F.col("was") > 0, 1).otherwise(-1).alias("sign"))
        others = _summed(self.log("calls", number).withColumn("local", _local()).join(turned, ["repo", "language", "local"], "left_semi").drop("local").join(files, ["repo", "file"], "left_anti"))
        theirs = _summed(self.log("imports", number).join(others.select("repo", "file").distinct(), ["repo", "file"], "left_semi"))
        elsewhere = _library_rows(others, theirs).join(turned, ["repo", "language", "local"]).withColumn("n", F.col("n") * F.col("sign"))
        none = F.lit(None).cast("string")
        columns = ("repo", none.alias("language"), none.alias("name"), "source", "target", F.lit(True).alias("is_library"), "n")
        return gone.select(*columns).unionByName(come.select(*columns)).unionByName(elsewhere.select(*columns))

    def fold(self, number: int) -> None:
        """The batches below ``number`` of each log become one table, so that reading does not follow the number of batches. What breaks off leaves the log as it was."""
        for name in (*FACTS, "edges"):
            used, _ = self._tables(name, number)
            if len(used) > 1:
                order = NAME if name in ("definitions", "calls") else ["repo"]
                self._put(name, f"{used[-1].rstrip('f').rpartition('/')[2]}f", _summed(self.log(name, number)).sort(*order))
                for old in self._tables(name, number)[1]:
                    path, store = self._store(old)
                    store.delete(path, True)

    def on_batch(self, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], fold: int = 64) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch`` over saved files (repo, file, text, ts): the last version of each counts; ``extract`` gives its definitions, imports and calls."""

        def apply(batch: DataFrame, number: int) -> None:
            last = batch.groupBy("repo", "file").agg(F.max_by("text", "ts").alias("text")).persist()
            self.apply(number, last, *extract(last))
            last.unpersist()
            if number % fold == fold - 1:
                self.fold(number)

        return apply
