"""The join against a brute-force version over all pairs."""

import random
import re

from sourceloom.llm.jaccard_join import keep_one, near_duplicates

SCHEMA = "doc_id long, text string, id string, n long"


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(400)}"
    rows, common = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([4, 5, 8, 60, 120]))]
        for _ in range(r.choice([1, 2, 9])):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = word()
            if r.random() < 0.4:
                text = common + text
            rows.append(" ".join(text))
    base = [word() for _ in range(90)]
    for _ in range(40):  # a chain of near copies, each made from the one before
        base[r.randrange(90)] = word()
        rows.append(" ".join(base))
    rows += [rows[0], rows[0].upper(), None, "", " \n\t", "one", "One", "one two", "x " * 5000]
    order = list(range(len(rows)))
    r.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}v{j}" for j in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("c") + " end"), (1, text("c")), (2, text("d")), (2, text("d")), (2, text("d")),
            (3, text("e")), (3, text("f")), (4, text("f") + " end"), (5, text("e")), (None, None), (None, ""), (6, text("g")), (None, text("g"))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    want = [(None, text("a")), (None, text("b")), (1, text("c")), (2, text("d")), (3, text("e")), (3, text("f")), (None, None), (None, ""), (6, text("g"))]
    assert got == sorted(want, key=str)
