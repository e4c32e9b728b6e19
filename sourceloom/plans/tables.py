"""The given tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(mark: str, key: str) -> Column:
    return F.concat(F.lit(mark), F.col(key).cast("string"))
