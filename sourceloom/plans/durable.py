"""Cutting lineage so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a folder of this machine only where the master runs on it and the session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sourceloom-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, for tables that several jobs read."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """Parquet tables of one job in the shared folder. What a returned plan still reads stays; the job drops the rest as it goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.number = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, written once and read from there on."""
        path = f"{self.base}/{self.number}"
        self.number += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drops_with(self, view: DataFrame, table: DataFrame) -> DataFrame:
        """``view``, which reads ``table`` and may be given to ``drop`` in its place."""
        self.paths[id(view)] = (view, self.paths[id(table)][1])
        return view

    def free(self) -> None:
        """Ask the driver for a collection, so that Spark removes the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][1])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
