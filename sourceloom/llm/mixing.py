"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is its target number of rows over its rows. Each document inverts the Poisson
distribution of that mean at a uniform number hashed from the seed and its id, is repeated that often, and every copy goes to the place that another
hash gives it: one shuffle deals the copies out, and each partition is sorted by the hash. Counts depend on the seed, the id and the rate alone, so a re-run gives the
same rows. A rate over ``TABLE`` is the sum of equal smaller ones, each inverted at its own hashed number, which is the same distribution; so the table of
a source has a few hundred entries at most, and the work of a document follows its copies.

Defined cases: a null source is a source of its own; a null id hashes as the text ``null``; repeated rows get equal counts and each its own copies;
texts are carried and never read; an empty table gives an empty result; all other columns pass through, whatever their names, and a column named
``copy`` is overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace

SEED = 17
TABLE = 64.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below 2**-52, for rates up to ``TABLE``."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def step(s: Column, k: Column) -> Column:
        log = F.when(k == 0, -rate).otherwise(s["log"] + F.log(rate) - F.log(k.cast("double")))
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(s["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), top), start, step, lambda s: s["steps"])).otherwise(F.array(F.lit(2.0)))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, source: str = "source") -> DataFrame:
    """(source, rate): ``weights`` (source, weight) are the target shares, equal ones by default; ``rows`` the target size, as many as now by default.

    The rows of each source are counted once, into the shared folder; two sums of them reach the driver.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    sizes = Workspace(docs.sparkSession).keep(sizes)
    total = sizes.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    target, weight = float(total.n or 0 if rows is None else rows), float(total.weight or 0)
    return sizes.select("source", (F.lit(target) * F.col("weight") / (F.lit(weight) * F.col("n")) if weight else F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` and ``copy`` (from 0): each row as often as its count says, in shuffled order.

    The rates, a row a source, are written to the shared folder, so Spark knows their size and broadcasts them only where they are small; beyond that it joins by
    source and splits the rows of a large one.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / TABLE).cast("int"))
    steps = Workspace(docs.sparkSession).keep(rates.select("source", parts.alias("parts"), poisson_steps(F.col("rate") / parts).alias("steps")))
    kept = [c for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"))
    rows = rows.select("row", F.col("row").getField(id_col).alias("id"), F.col("row").getField(source).alias("own"))
    found = rows.join(steps, F.col("own").eqNullSafe(F.col("source")))
    draw = lambda u: F.size(F.filter("steps", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("parts") - 1), F.lit(0), lambda n, i: n + draw(uniform(F.lit(seed), "id", i)))
    count = draw(uniform(F.lit(seed), "id")) + F.when(F.col("parts") > 1, more).otherwise(0)
    copies = found.select("row", "id", count.alias("n")).where("n > 0").select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    place = copies.select("row", "copy", F.xxhash64(F.lit(seed + 1), "id", "copy").alias("place"))
    return place.repartition("place").sortWithinPartitions("place").select("row.*", "copy")
