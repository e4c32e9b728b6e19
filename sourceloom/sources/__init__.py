"""Sources and sinks: code corpora, fact tables, graph documents and saved layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.sources.files import EXTENSIONS, SKIPPED, SKIPPED_PYTHON, CorpusSource, DocumentFiles, publish, read_documents

GRAPH = (
    "nodes array<struct<id:string,name:string,file:string,line:int,language:string,isLibrary:boolean,libraryName:string,className:string,classExtends:string,classImplements:array<string>>>,"
    "edges array<struct<source:string,target:string,isLibraryEdge:boolean>>, files array<string>"
)
LAYOUT = "version int, name string, description string, savedAt string, nodePositions map<string,struct<x:double,y:double>>, _corrupt_record string"


def keep_sources(paths: DataFrame, path: str = "path") -> DataFrame:
    """The rows of a table of relative paths that a scan takes, with ``language``."""
    language = F.coalesce(*(F.when(F.col(path).rlike(p), name) for name, p in EXTENSIONS))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = F.exists(folders, lambda s: s.startswith(".") | s.isin(*SKIPPED) | ((language == "python") & s.isin(*SKIPPED_PYTHON)))
    return paths.withColumn("language", language).where(F.col("language").isNotNull() & ~out)


def scan_corpus(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(repo, path, language, text, reason) of the source files below a folder, empty ones included, as ``CorpusSource`` reads them: tasks list folders and read files."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("source_corpus").option("repo", repo).load(root)


def write_documents(documents: DataFrame, folder: str, mode: str = "append") -> None:
    """(file, text) as files below a folder; they appear once all are written, moved to their places by tasks."""
    spark, job = documents.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DocumentFiles)
    dealt = documents.select("file", "text").repartition(spark.sparkContext.defaultParallelism)  # a file costs more than its bytes tell
    dealt.write.format("document_files").option("job", job).mode(mode).save(folder)
    publish(spark, folder, job)


def read_graph_json(spark: SparkSession, path: str, repo: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and files of graph documents; a missing list is empty, and a document that does not parse is an empty graph."""
    docs = spark.read.schema(GRAPH).option("multiLine", True).json(path).withColumn("repo", F.lit(repo))
    nodes = docs.select("repo", F.explode("nodes").alias("n")).select(
        "repo", "n.id", "n.name", F.nullif("n.file", F.lit("")).alias("file"), "n.line", "n.language", F.coalesce("n.isLibrary", F.lit(False)).alias("is_library"), F.col("n.libraryName").alias("library_name"),
        F.col("n.className").alias("class_name"), F.col("n.classExtends").alias("class_extends"), F.col("n.classImplements").alias("class_implements"),
    )
    edges = docs.select("repo", F.explode("edges").alias("e")).select("repo", "e.source", "e.target", F.coalesce("e.isLibraryEdge", F.lit(False)).alias("is_library"))
    return nodes, edges, docs.select("repo", F.explode("files").alias("file"))


def damaged_graphs(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the graph documents that ``read_graph_json`` takes as empty graphs: those that do not parse, and those that hold no list of nodes."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"{GRAPH}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    broken = F.col("d").isNull() | F.col("d._corrupt_record").isNotNull()
    return texts.withColumn("reason", F.when(broken, "does not parse").when(F.col("d.nodes").isNull(), "no nodes")).where("reason is not null").select("file", "reason")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, by repository."""
    nodes.write.mode("overwrite").partitionBy("repo").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("repo").parquet(f"{path}/edges")


def parse_layouts(texts: DataFrame) -> DataFrame:
    """(file, name, description, saved_at, node_positions, settings) from (file, text); broken documents go, a missing name is the file's, and settings stay JSON text."""
    rows = texts.select("file", F.from_json("text", LAYOUT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"), F.get_json_object("text", "$.settings").alias("settings")).where("d is not null and d._corrupt_record is null")
    name = F.coalesce("d.name", F.regexp_replace("file", r"\.json$", ""))
    return rows.select("file", name.alias("name"), F.coalesce("d.description", F.lit("")).alias("description"), F.coalesce("d.savedAt", F.lit("")).alias("saved_at"), F.col("d.nodePositions").alias("node_positions"), "settings")


def read_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """The saved layouts of a folder, by file name."""
    return parse_layouts(read_documents(spark, folder, ".json")).orderBy("file")


def layout_file(name: Column) -> Column:
    """The file name of a layout: letters, digits, ``_``, ``-`` and blanks stay."""
    return F.concat(F.regexp_replace(name, r"[^a-zA-Z0-9_\- ]", "_"), F.lit(".json"))


def layout_documents(layouts: DataFrame, positions: DataFrame) -> DataFrame:
    """(file, text) of layouts (name, saved_at, and if there are any description and settings, JSON text) and their positions (name, id, x, y).

    Of layouts whose names give one file the one saved last stays, of those the one of the larger name. A position without both numbers is left out.
    """
    places = positions.where("x is not null and y is not null").groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("x", "y"))))).alias("nodePositions"))
    given = lambda c, other: F.col(c) if c in layouts.columns else other
    rows = layouts.select("name", "saved_at", given("description", F.lit("")).alias("description"), given("settings", F.lit(None).cast("string")).alias("settings"), layout_file(F.col("name")).alias("file"))
    last = rows.groupBy("file").agg(F.max_by(F.struct("name", "saved_at", "description", "settings"), F.struct("saved_at", "name")).alias("l")).select("file", "l.*")
    known = last.join(places, "name", "left")
    doc = F.struct(
        F.lit(1).alias("version"), "name", F.coalesce("description", F.lit("")).alias("description"), F.col("saved_at").alias("savedAt"), F.try_parse_json(F.col("settings")).alias("settings"),
        F.coalesce("nodePositions", F.create_map().cast("map<string,struct<x:double,y:double>>")).alias("nodePositions"),
    )
    return known.select("file", F.to_json(doc).alias("text"))


def write_layouts(layouts: DataFrame, positions: DataFrame, folder: str) -> None:
    """One JSON document a layout, over the one of the same file name."""
    write_documents(layout_documents(layouts, positions), folder)


def search_layouts(layouts: DataFrame, query: str) -> DataFrame:
    """Layouts whose name or description holds the query, in any case, by file name."""
    hit = lambda c: F.lower(c).contains(query.lower())
    return layouts.where(hit("name") | hit("description")).orderBy("file")
