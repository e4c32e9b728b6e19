"""Streams that follow saved files, against plain runs over all that came so far."""

import random

from pyspark.sql import functions as F

from sourceloom.operators import resolution
from sourceloom.streaming import status
from sourceloom.streaming.incremental import IncrementalGraph


def extract(files):
    """Facts of texts of words: ``d:f`` defines f, ``i:x=m`` binds x, ``c:f`` calls f() and ``a:x.f`` calls x.f(), all by the file's function."""
    words = files.select("repo", "file", F.posexplode(F.split("text", " ")).alias("ord", "w")).withColumn("language", F.lit("python"))
    kind, rest = F.substring("w", 1, 1), F.expr("substring(w, 3)")
    caller = F.concat("file", F.lit("::f"))
    definitions = words.where(kind == "d").select("repo", "language", F.concat_ws("::", "file", rest).alias("id"), rest.alias("name"), "file")
    imports = words.where(kind == "i").select("repo", "language", "file", F.substring_index(rest, "=", 1).alias("local"), F.substring_index(rest, "=", -1).alias("module"), F.col("ord").cast("long"))
    bare = words.where(kind == "c").select("repo", "language", "file", caller.alias("caller_id"), F.lit("bare").alias("kind"), F.lit(None).cast("string").alias("obj"), rest.alias("name"))
    attr = words.where(kind == "a").select("repo", "language", "file", caller.alias("caller_id"), F.lit("attr").alias("kind"), F.substring_index(rest, ".", 1).alias("obj"), F.substring_index(rest, ".", -1).alias("name"))
    return definitions, imports, bare.unionByName(attr)


def test_incremental_resolution_equals_full_resolution_after_each_batch(spark, tmp_path):
    r = random.Random(5)
    word = lambda: r.choice([f"d:n{r.randrange(6)}", f"i:n{r.randrange(6)}=m{r.randrange(3)}", f"i:x{r.randrange(2)}=lib", f"c:n{r.randrange(6)}", f"a:self.n{r.randrange(6)}", f"a:x{r.randrange(2)}.g", f"a:n{r.randrange(6)}.h"])
    schema = "repo string, file string, text string, ts long"
    now, most, graph = {}, 0, IncrementalGraph(spark, str(tmp_path / "graph"))
    for number in range(10):
        rows = [("r" if r.random() < 0.8 else "q", f"file{r.randrange(9)}", " ".join(word() for _ in range(r.choice([0, 6, 9, 12]))), ts) for ts in range(r.choice([1, 2, 6]))]
        for repo, file, text, _ in rows:
            now[repo, file] = text
        batch = spark.createDataFrame(rows, schema)
        apply = graph.on_batch(extract, fold=4)
        if number == 6:
            graph.apply(number, batch, *extract(spark.createDataFrame([("r", "file1", "d:wrong c:n1", 0)], schema)))  # a batch that broke off and runs again
        apply(batch, number)
        definitions, imports, calls = extract(spark.createDataFrame([(*k, v) for k, v in now.items()], "repo string, file string, text string"))
        want = {(x.repo, x.source, x.target, False) for x in resolution.resolve_calls(definitions, calls).collect()}
        want |= {(x.repo, x.source, x.target, True) for x in resolution.resolve_library_calls(definitions, imports, calls)[1].collect()}
        got, most = [tuple(x) for x in graph.edges().collect()], max(most, len(want))
        assert len(got) == len(set(got)) and set(got) == want, number
    assert all(x.n > 0 for x in graph.facts("calls").collect())
    assert most > 12


def test_a_small_batch_moves_few_rows(spark, tmp_path):
    graph = IncrementalGraph(spark, str(tmp_path / "graph"))
    files = spark.range(3000).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("file"), F.concat(F.lit("d:n"), "id", F.lit(" c:n"), (F.col("id") + 1) % 3000, F.lit(" c:common")).alias("text"), F.lit(0).alias("ts"))
    graph.on_batch(extract)(files, 0)
    saved = spark.createDataFrame([("r", "f7", "d:n7 c:n9 c:common", 1)], "repo string, file string, text string, ts int")
    graph.on_batch(extract)(saved, 1)
    sizes = {name: graph.log(name).count() - graph.log(name, 1).count() for name in ("definitions", "imports", "calls", "edges")}
    assert sizes == {"definitions": 0, "imports": 0, "calls": 2, "edges": 2}
    assert graph.edges().where("source = 'f7::f'").first().target == "f9::n9"


def test_a_name_of_many_callers_and_definitions_keeps_no_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resolution, "SIDE", 16)
    graph = IncrementalGraph(spark, str(tmp_path / "graph"))
    text = F.concat(F.lit("d:n"), F.col("id") % 2, F.lit(" c:n"), F.col("id") % 3)
    files = spark.range(300).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("file"), text.alias("text"), F.lit(0).alias("ts"))
    graph.on_batch(extract)(files, 0)
    assert graph.log("edges").count() == 300
    definitions, _, calls = extract(files)
    want = sorted(map(tuple, resolution.resolve_calls(definitions, calls).collect()))
    assert len(want) == 200 * 150 and sorted((x.repo, x.source, x.target) for x in graph.edges().collect()) == want
    twice = definitions.unionByName(definitions.withColumn("name", F.lit("n2")))
    wanted = calls.select("repo", "language", "name", F.col("caller_id").alias("source")).unionByName(calls.select("repo", "language", F.lit("n1").alias("name"), F.col("caller_id").alias("source"))).distinct()
    plain = wanted.join(twice, ["repo", "language", "name"]).where("source <> id").select("repo", "source", "id").distinct()
    assert sorted(map(tuple, resolution.expand_names(wanted, twice).collect())) == sorted(map(tuple, plain.collect()))


def test_status_updates_out_of_order_equal_a_batch_run(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for n in range(60):
        file, at = f"f{r.randrange(8)}", f"2024-01-01 {r.randrange(24):02}:{r.randrange(60):02}:00"
        ids = [f"i{k}" for k in range(5) if r.random() < 0.5]
        rows += [("r", file, i, r.choice(["added", "modified", "deleted"]), at) for i in ids] or [("r", file, None, None, at)]
    r.shuffle(rows)
    updates = spark.createDataFrame(rows, "repo string, file string, id string, status string, at string").select("repo", "file", "id", "status", F.to_timestamp("at").alias("ts"))
    for k in range(4):
        updates.where(F.pmod(F.xxhash64("file", "id", "ts"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.ROCKSDB)
    try:
        stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = status.stream_file_statuses(stream, late="3 days")
        made.writeStream.foreachBatch(lambda df, n: df.write.parquet(str(tmp_path / "out" / f"n={n}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    emitted = spark.read.parquet(str(tmp_path / "out"))
    assert emitted.select("n").distinct().count() > 1
    plain = lambda df: sorted(map(tuple, df.select("file", "id", "status", "ts").collect()))
    assert plain(status.statuses_of(emitted)) == plain(status.file_statuses(updates))
    assert emitted.where("status is null").count() > 0


def test_a_file_without_updates_is_cleared_by_its_timer(spark, tmp_path):
    schema = "repo string, file string, id string, status string, at string"
    parts = [[("r", "f", "a", "added", "2024-01-01")], [("r", "g", "b", "added", "2024-02-01")], [("r", "g", "c", "added", "2024-02-02")], [("r", "f", "d", "added", "2024-03-01"), ("r", "g", "c", "added", "2024-03-01")]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.ROCKSDB)
    try:
        for rows in parts:
            spark.createDataFrame(rows, schema).select("repo", "file", "id", "status", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("repo string, file string, id string, status string, ts timestamp").parquet(str(tmp_path / "in"))
            made = status.stream_file_statuses(stream, late="1 day", keep_ms=20 * 86_400_000)
            made.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={n}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(x.file, x.id, x.status, str(x.ts)[:10]) for x in spark.read.schema(f"{status.STATUS}, n long").parquet(str(tmp_path / "out")).collect()}
    # g loses b and keeps c; f was cleared before its second update, so nothing is taken from a then.
    assert got == {("f", "a", "added", "2024-01-01"), ("g", "b", "added", "2024-02-01"), ("g", "b", None, "2024-02-02"), ("g", "c", "added", "2024-02-02"), ("g", "c", "added", "2024-03-01"), ("f", "d", "added", "2024-03-01")}
