"""Registered queries that run streams with ``availableNow``: the events come in parts, and each part is a run that resumes from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace
from sourceloom.plans.tables import table, text_id
from sourceloom.streaming import status
from sourceloom.streaming.incremental import IncrementalGraph

SAVES, UPDATES = 2, 3  # parts of the two feeds


def _in_parts(rows: DataFrame, parts: int, work: Workspace, run: Callable[[DataFrame], object]) -> None:
    """Write the rows by their column ``part``, from 0, and run the stream over what has come after each."""
    for part in range(parts):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{work.base}/in")
        run(rows.sparkSession.readStream.schema(rows.drop("part").schema).parquet(f"{work.base}/in"))


def _extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of texts of lines: ``def f``, ``call f``, ``call x.f`` and ``import m as x``, all of the file's one function."""
    lines = files.select("repo", "file", F.posexplode(F.split("text", "\n")).alias("ord", "line")).select("repo", F.lit("python").alias("language"), "file", F.col("ord").cast("long").alias("ord"), "line")
    rest = F.substring_index("line", " ", -1)
    definitions = lines.where("line like 'def %'").select("repo", "language", F.col("file").alias("id"), rest.alias("name"), "file")
    imports = lines.where("line like 'import %'").select("repo", "language", "file", rest.alias("local"), F.regexp_extract("line", r"^import (\S+)", 1).alias("module"), "ord")
    dot = F.instr(rest, ".") > 0
    calls = lines.where("line like 'call %'").select("repo", "language", "file", F.col("file").alias("caller_id"), F.when(dot, "attr").otherwise("bare").alias("kind"), F.when(dot, F.substring_index(rest, ".", 1)).alias("obj"), F.substring_index(rest, ".", -1).alias("name"))
    return definitions, imports, calls


def feed_resolved(spark, sf_dir):
    """Each event is a save of its user's file; the edges of the call graph follow the saves."""
    e = table(spark, sf_dir, "events")
    number = lambda k: (F.col("event_id") % k).cast("string")
    name = F.when(F.col("user_id") % 40 == 0, F.concat(F.lit("tool_"), number(3))).otherwise(F.concat("event_type", F.lit("_"), (F.col("user_id") % 40).cast("string")))
    text = F.concat(F.lit("def "), name, F.lit("\ncall "), "event_type", F.lit("_"), number(40), F.lit("\nimport lib_"), number(7), F.lit(" as lib\ncall lib.f"), number(5), F.lit("\nimport tools as tool_"), number(3), F.lit("\ncall tool_"), number(3))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = e.agg(F.coalesce(F.min(micros), F.lit(0)).alias("low"), F.coalesce(F.max(micros), F.lit(1)).alias("high")).first()
    part = F.least(F.floor((micros - span.low) * SAVES / max(1, span.high - span.low)), F.lit(SAVES - 1))
    saves = e.select(F.lit("web").alias("repo"), text_id("u", "user_id").alias("file"), text.alias("text"), F.struct(micros.alias("at"), "event_id").alias("ts"), part.alias("part"))
    work = Workspace(spark)
    graph = IncrementalGraph(spark, f"{work.base}/graph")
    apply = graph.on_batch(_extract)
    _in_parts(saves, SAVES, work, lambda stream: stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{work.base}/cp").trigger(availableNow=True).start().awaitTermination())
    return graph.edges().drop("repo")


def feed_file_status(spark, sf_dir):
    """A user's events of one day are one update of the user's file, its ids are their types; the parts of the feed mix the days, so updates come late and in pieces."""
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.array(*(F.lit(x) for x in ("added", "modified", "deleted"))), (F.col("event_id") % 3 + 1).cast("int"))
    updates = e.select(F.lit("web").alias("repo"), text_id("u", "user_id").alias("file"), F.col("event_type").alias("id"), state.alias("status"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % UPDATES).alias("part"))
    work = Workspace(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, status.ROCKSDB)

    def run(stream: DataFrame) -> None:
        made = status.stream_file_statuses(stream, late="3650 days")
        made.writeStream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{work.base}/out/n={number}")).outputMode("update").option("checkpointLocation", f"{work.base}/cp").trigger(availableNow=True).start().awaitTermination()

    try:
        _in_parts(updates, UPDATES, work, run)
    finally:
        spark.conf.set(name, before)
    emitted = spark.read.schema(f"{status.STATUS}, n long").parquet(f"{work.base}/out")
    return status.statuses_of(emitted).select("file", "id", "status", F.date_format("ts", "yyyy-MM-dd").alias("day"))


QUERIES = {f.__name__: f for f in (feed_resolved, feed_file_status)}

ORACLE_SQL = {
    "feed_resolved": """WITH last AS (SELECT user_id AS u, arg_max(event_id, (ts, event_id)) AS e, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id),
defs AS (SELECT 'u' || u AS id, CASE WHEN u % 40 = 0 THEN 'tool_' || (e % 3) ELSE t || '_' || (u % 40) END AS name FROM last),
calls AS (SELECT 'u' || u AS source, t || '_' || (e % 40) AS name FROM last UNION SELECT 'u' || u, 'tool_' || (e % 3) FROM last)
SELECT DISTINCT source, id AS target, false AS is_library FROM calls JOIN defs USING (name) WHERE source <> id
UNION ALL SELECT 'u' || u, 'library::lib_' || (e % 7) || '::f' || (e % 5), true FROM last
UNION ALL SELECT 'u' || u, 'library::tools::tool_' || (e % 3), true FROM last WHERE 'tool_' || (e % 3) NOT IN (SELECT name FROM defs)""",
    "feed_file_status": """WITH d AS (SELECT user_id, event_type, ['added', 'modified', 'deleted'][event_id % 3 + 1] AS status, date_trunc('day', ts)::DATE AS day FROM events),
last AS (SELECT user_id, MAX(day) AS day FROM d GROUP BY user_id)
SELECT 'u' || user_id AS file, event_type AS id, MAX(status) AS status, strftime(day, '%Y-%m-%d') AS day FROM d JOIN last USING (user_id, day) GROUP BY user_id, event_type, day""",
}
