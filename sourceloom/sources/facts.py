"""Fact tables of any extractor, with a quarantine: every record is either taken or kept with the rule that it breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SCHEMAS = {
    "definitions": "repo string, language string, id string, name string, file string, line int",
    "imports": "repo string, language string, file string, local string, module string, ord long",
    "calls": "repo string, language string, file string, caller_id string, kind string, obj string, name string",
}


def _missing(name: str) -> str:
    return f"{name} is null or {name} = ''"


#: For each kind of facts its rules in order: what is said of a record, and when, as SQL.
RULES = {
    "definitions": {"no repo": _missing("repo"), "no language": _missing("language"), "no id": _missing("id"), "no name": _missing("name"), "line below 0": "line < 0"},
    "imports": {"no repo": _missing("repo"), "no language": _missing("language"), "no file": _missing("file"), "no local name": _missing("local"), "no module": _missing("module")},
    "calls": {
        "no repo": _missing("repo"), "no language": _missing("language"), "no caller": _missing("caller_id"), "no name": _missing("name"),
        "neither bare nor attr": "kind is null or kind not in ('bare', 'attr')", "no object": f"kind = 'attr' and ({_missing('obj')})",
    },
}


def judged_facts(texts: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """The records of a table of JSON texts, typed, with ``record`` (the text) and ``reason``: the first rule that each breaks, null where it is taken.

    A text that is no JSON object, or has a value of another type, breaks the first rule of all. Of definitions that repeat an id in their repository the one of the largest
    line stays, of those the one of the larger name, then text; the others are repeats. Equal texts are equal records, and all but one are repeats as well.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = texts.select(F.col(text).alias("record"), F.from_json(text, f"{SCHEMAS[kind]}, _corrupt_record string", options).alias("d"))
    broken = F.col("d").isNull() | F.col("d._corrupt_record").isNotNull()
    names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    rows = rows.select("record", broken.alias("broken"), *(F.col(f"d.{n}").alias(n) for n in names))
    reason = F.when(F.col("broken"), "no record of this kind")
    for said, when in RULES[kind].items():
        reason = reason.when(F.expr(when), said)
    rows = rows.withColumn("reason", reason).drop("broken")
    if kind != "definitions":
        return rows
    # Repeats: one row for each id and text with its count, so a text that comes very often is one row before ids meet.
    good, bad = rows.where("reason is null"), rows.where("reason is not null")
    counted = good.groupBy("record", *names).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("repo", "id").agg(F.max_by("record", F.struct(F.coalesce("line", F.lit(0)), "name", "record")).alias("best"))
    placed = counted.join(best, ["repo", "id"])
    kept = placed.where("record = best").withColumn("reason", F.lit(None).cast("string"))
    spare = placed.withColumn("n", F.when(F.col("record") == F.col("best"), F.col("n") - 1).otherwise(F.col("n"))).where("n > 0").withColumn("reason", F.lit("repeated id"))
    spare = spare.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    columns = ["record", *names, "reason"]
    return bad.select(columns).unionByName(kept.select(columns)).unionByName(spare.select(columns))


def ingest_facts(texts: DataFrame, kind: str, observation: Observation | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The facts that are taken, and (reason, record) of all others. An observation on the first counts what passed it: ``taken``, and ``files`` with any fact.

    Both read the texts; keep those in a table where reading them again is dear.
    """
    rows = judged_facts(texts, kind, text)
    taken = rows.where("reason is null").drop("reason", "record")
    if observation is not None:
        taken = taken.observe(observation, F.count(F.lit(1)).alias("taken"), F.approx_count_distinct("file").alias("files"))
    return taken, rows.where("reason is not null").select("reason", "record")
