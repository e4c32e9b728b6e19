"""Empty tables, nulls, repeated rows, long texts and clashing column names, for every operator on documents."""

import pytest

from sourceloom.llm import decontamination, license_scan, mixing, pii, quality, secret_scan, toxicity
from sourceloom.llm.jaccard_join import near_duplicates

SCHEMA = "doc_id long, text string, source string, row string, copy string, id string, spans string, bucket string, n long, score string"
TEXTS = [None, "", " \n\t ", "mit license password: abcdef1 a@b.cd 10.0.0.1", "MIT License password: abcdef1 a@b.cd 10.0.0.1", "x" * 300_000, "word " * 100_000, "é" * 50 + " token=ééé", "gh_ " * 1000]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "a", "b", "c", "d", "e", 1, "f") for i, t in rows], SCHEMA)


def labels_of(spark):
    return spark.createDataFrame([(k, 0, k % 2) for k in range(6)] + [(None, 0, 1), (3, 0, None), (3, 1, 1)], "doc_id long, quality int, toxic int")


def items_of(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (None, "nine"), (2, None)], "item_id long, text string")


OPERATORS = {
    "secrets": lambda spark, docs: secret_scan.spans_digest(docs),
    "licences": lambda spark, docs: license_scan.license_digest(docs),
    "join": lambda spark, docs: near_duplicates(docs),
    "personal data": lambda spark, docs: pii.personal_data_digest(docs),
    "quality": lambda spark, docs: quality.judge(docs, quality.plan_cascade(docs)),
    "toxicity": lambda spark, docs: toxicity.toxicity(docs, labels_of(spark)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_a_document_whatever_it_holds(spark, name):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[3]), (None, None)]
    got = OPERATORS[name](spark, docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    same = [tuple(r)[1:] for r in got if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert OPERATORS[name](spark, docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["decontamination", "redaction", "mixing", "kept"])
def test_filters_keep_all_columns(spark, name):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[3]), (20, "intro one two three four five six seven eight outro")]
    apply = {
        "decontamination": lambda d: decontamination.drop_contaminated(d, items_of(spark)),
        "redaction": secret_scan.redact_secrets,
        "mixing": lambda d: mixing.mix(d, mixing.source_rates(d)).select(d.columns),
        "kept": lambda d: quality.keep_good(d, quality.RULES),
    }[name]
    docs = docs_of(spark, rows)
    out = apply(docs)
    assert out.columns == docs.columns
    n = out.count()
    assert {"decontamination": n == len(rows) - 1, "redaction": n == len(rows), "mixing": n > 0, "kept": n == 0}[name]
    assert apply(docs_of(spark, [])).count() == 0




def test_bytes_that_are_no_utf8(spark):
    raw = b"ok \xff\xfe token: abcdef1 mail a@b.cd " + b"\xc3 word" * 60
    docs = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"plain token: abcdef1"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw AS string) AS text")
    known = spark.createDataFrame([(1, raw.decode("utf-8", "replace")), (2, "plain token: abcdef1")], "doc_id long, text string")
    for name, op in OPERATORS.items():
        rows = lambda d: sorted(map(tuple, op(spark, d).collect()))  # noqa: B023, E731
        assert rows(docs) == rows(known), name
    apply = (secret_scan.redact_secrets, lambda d: quality.keep_good(d, quality.RULES), lambda d: decontamination.drop_contaminated(d, items_of(spark)))
    for f in apply:
        assert f(docs).count() == f(known).count()
    masked = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert "abcdef1" not in masked[1] and masked[1].startswith("ok \ufffd\ufffd")
