"""The corpus pipeline against its stages' plain versions, and rows that are easily lost."""

import corpus_pipeline

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz"


def good(k, n=80):
    return " ".join(f"{a}{b}{k}" for a in WORDS.split() for b in WORDS.split())[: 6 * n]


def test_stages_keep_clean_rows_and_drop_the_rest(spark, tmp_path):
    item = "one question about some matter that has twenty words or so in it and then the answer comes last here now"
    rows = [(1, good("a")), (2, good("a")), (3, good("a") + " tail"), (4, good("b")), (None, good("c")), (None, good("d")), (5, "too short"), (6, None), (7, good("e") + " " + item + " " + good("f")), (8, good("g") + " password: hunter2222")]
    docs = spark.createDataFrame([(i, t, "en", "web" if k % 3 else None, len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
    want = {(1, good("a")), (4, good("b")), (None, good("c")), (None, good("d")), (8, good("g") + " <secret>")}
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert {x[0] for x in got} == {x[0] for x in want} and len(got) == len(want)
    assert {t for i, t in got if i != 8} == {t for i, t in want if i != 8}
    assert all("hunter2222" not in t for _, t in got)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == [*docs.columns, "copy"]
    assert {r.text for r in result.collect()} <= {t for _, t in got}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
