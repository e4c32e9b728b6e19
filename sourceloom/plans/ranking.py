"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.plans.durable import cut


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: the place from 0 within the keys ``by``, in ``order`` (which should leave no ties).

    Rows are sorted by ranges, so one huge key spreads over tasks; each row stores its place in its task, and a window sees one row for each task and key only.
    """
    placed = rows.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    placed = cut(placed)
    runs = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n") - F.col("_first")
    shifts = runs.select(*by, "_part", before.alias("_shift"))
    joined = placed.join(shifts.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_part").alias("_p"), "_shift"), [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by)])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
