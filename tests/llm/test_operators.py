"""Small fixtures against brute force, and the defined cases of each operator."""

import itertools
import re

import numpy as np
import pytest

from sourceloom.llm import chat_repair, decontamination, fixity, license_scan, mixing, toxicity

DOC = "doc_id long, text string, source string, extra int"
NOTICE = "Released under the MIT License."


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 3 == 0 else "s", 1) for i, t in enumerate(texts)], DOC)


def test_license_places_equal_brute_force(spark):
    texts = [None, "", "Licensed under the Apache License, Version 2.0. " * 3, "CC-BY cc by Cc", NOTICE, "été mit license", "x " * 9000 + NOTICE]
    got = {r.doc_id: r for r in license_scan.license_digest(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_license_template_without_phrase(spark):
    text = " ".join(dict(license_scan.TEMPLATES)["mit"].split()[:33])
    r = license_scan.license_digest(docs_of(spark, [text])).first()
    assert (r.base_labels, r.labels) == ("", "mit")


def test_automaton_knows_every_substring():
    sequences = [[1, 2, 1, 3, 1, 2], [2, 1, 2, 2]]
    a = license_scan.SuffixAutomaton(sequences)
    for query in itertools.product([1, 2, 3], repeat=4):
        best = max((n for n in range(5) for s in sequences for k in range(len(s)) if tuple(s[k : k + n]) == query[4 - n :]), default=0)
        ends = [m for m in a.maximal(list(query), 1) if m[0] == 4]
        assert (ends[0][1] if ends else 0) == best


def test_decontamination_finds_planted_items(spark):
    items = [(k, " ".join(f"t{k}x{j}" for j in range(30))) for k in range(20)] + [(99, ""), (98, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = " ".join(f"t{k % 20}x{k % 30}" for k in range(0, 900, 7))
    texts = [None, "", clean, "word " * 300 + items[4][1].upper() + " word" * 200, "a b " + items[7][1][:60]]
    docs = docs_of(spark, texts)
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()] == [(3, 4)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()) == [0, 1, 2, 4]
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_fixity_finds_changed_missing_extra(spark):
    rows = [(k, f"u{k}", f"page {k}") for k in range(300)] + [(None, None, None), (5, "u5", "page 5")]
    other = [r for r in rows if r[0] != 17]
    other = [(k, u, "damaged" if k == 203 else h) for k, u, h in other] + [(900, "u", "h")]
    schema = "page_id long, url string, html string"
    got = fixity.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()
    assert sorted((r.page_id, r.state) for r in got) == [(17, "missing"), (203, "changed"), (900, "extra")]
    assert fixity.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema)).count() == 0
    assert fixity.audit(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_mixing_reaches_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, null, if(id % 6 = 1, 'a', 'b')) AS source", "'x' AS copy")
    mixed = mixing.mix(docs, mixing.source_rates(docs))
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {None, "a", "b"} and all(abs(n - 2000) < 250 for n in counts.values())
    assert mixing.mix(docs.limit(0), mixing.source_rates(docs.limit(0))).count() == 0


def brute_cost(roles):
    best = {chat_repair._START: 0.0}
    for r in roles:
        best = {q: min(best[s] + chat_repair.STEP[r][s, q] for s in best) for q in range(3)}
    return min(best.values())


@pytest.mark.parametrize("parts", [1, 5])
def test_chat_repair_is_legal_and_cheapest(spark, parts):
    convs = {1: "uaua", 2: "aua", 3: "uuaas", 4: "s?u", 5: "ua" * 300 + "s" + "aau" * 200, None: "au"}
    names = {"u": "user", "a": "assistant", "s": "system", "?": None}
    rows = [(c, t, names[x], f"m{t}") for c, text in convs.items() for t, x in enumerate(text)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for conv, text in convs.items():
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(text)))
        assert sum(r.cost for r in mine) == brute_cost([chat_repair._role(names[x]) for x in text])
        shown = re.findall(r"<\|(system|user|assistant)\|>", "".join(r.rendered for r in mine))
        assert re.fullmatch("s?(ua)*u?", "".join(x[0] for x in shown))


def test_toxicity_held_out(spark):
    bad = lambda i: i % 4 == 0
    texts = [" ".join(f"w{(i * 7 + j * j) % 150}" for j in range(40)) + (" idiot scum loser idiot" if bad(i) else "") for i in range(600)] + ["", None]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 - bad(i), int(bad(i))) for i in range(600)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id < 600]
    assert got and sum(r.predicted == bad(r.doc_id) for r in got) >= 0.95 * len(got)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_models_hold_every_training_row(spark):
    from sourceloom.llm.text import words_block

    texts = [f"common words {i % 9} here " + (f"slur{i // 40} idiot slur{i // 40} " if i % 4 == 0 else "fine ") for i in range(800)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    trained, _ = toxicity.train(docs_of(spark, texts), labels, limit=20)
    pairs = toxicity._codes(words_block([f"idiot slur{k}" for k in range(20)]))[3][1::2]
    assert set(pairs.tolist()) <= set(trained.broadcast(range(2, 3), toxicity.MAX_ENTRIES).models.keys[toxicity.PAIR].tolist())


def test_toxicity_lower_orders_count_contexts(spark):
    from sourceloom.llm.text import letters_only, word_hashes, words_block

    texts = [f"plain {i} text of {i} words" + (f" madam zorro then a{i} idiot" if i % 4 == 0 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    models = toxicity.train_models(docs_of(spark, texts), labels).broadcast(range(2, 3), toxicity.MAX_ENTRIES).models
    weight = {}
    for word in ("zorro", "idiot"):  # equally frequent, the first in one context only
        h, _ = word_hashes(words_block([word]), between=letters_only())
        stem, _ = word_hashes(words_block([word]), between=letters_only(), longest=toxicity.STEM_BYTES)
        (of_word, _), (of_stem, _) = (models.look(kind, keys, np.array([2])) for kind, keys in ((toxicity.WORD, h), (toxicity.STEM, stem)))
        weight[word] = of_stem[0, 1] if np.isnan(of_word[0, 1]) else of_word[0, 1]
    assert weight["zorro"] < 0.5 * weight["idiot"]


@pytest.mark.parametrize("size", [15, 30, 59])
def test_decontamination_survives_any_single_edit(spark, size):
    item = [f"t{j}" for j in range(size)]
    bench = spark.createDataFrame([(7, " ".join(item))] + [(k, " ".join(f"o{k}x{j}" for j in range(40))) for k in range(8, 30)], "item_id long, text string")
    around = [f"word{k % 50}" for k in range(300)]
    edits = [item[:k] + e + item[k + 1 :] for k in range(size) for e in (["other"], [], [item[k], "more"])]
    docs = docs_of(spark, [" ".join(around + e + around) for e in edits] + [" ".join(around + item[: size // 2] + around)])
    got = {r.doc_id for r in decontamination.contaminated(docs, bench).collect()}
    assert got == set(range(len(edits)))


def test_decontamination_takes_items_of_any_length_and_number(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD", 5)
    long = [f"long{j}" for j in range(20000)]
    bench = spark.createDataFrame([(1, " ".join(long))] + [(k, " ".join(f"o{k}x{j}" for j in range(30))) for k in range(2, 30)], "item_id long, text string")
    texts = [" ".join(["some", "words"] * 40), " ".join(long), " ".join(long[7000:9000]), " ".join(f"o4x{j}" for j in range(30))]
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, texts), bench).collect())
    assert got == [(1, 1), (3, 4)]  # a tenth of an item holds no answer
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs_of(spark, texts), bench).collect()) == [0, 2]


def test_quality_keeps_three_byte_scripts(spark):
    from sourceloom.llm import quality

    georgian = " ".join("".join(chr(0x10D0 + (k * 7 + j * (k % 5 + 1)) % 33) for j in range(5 + k % 6)) for k in range(80))
    docs = docs_of(spark, [georgian, " ".join("x" * 25 + str(k) for k in range(80))])
    assert [r.kept for r in quality.judge(docs, quality.RULES).orderBy("doc_id").collect()] == [True, False]
    assert [r.doc_id for r in quality.keep_good(docs, quality.RULES).collect()] == [0]
