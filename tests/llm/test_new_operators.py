"""Fill-in-middle, whitening and exact dedup against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import exact_dedup, fill_middle, whitening
from sourceloom.llm.text import words_block

PIECES = ["abc", "Zé", " ", "\n", "漢字", "😀", "x1y", "<", "S>", "<S", "  ", "\x00", "é"]


def texts_of(seed, n):
    r = random.Random(seed)
    own = ["".join(r.choice(PIECES) for _ in range(r.randrange(0, 30))) for _ in range(n)]
    return [None, "", "a", "<P> in it", "b" * 200_000 + " é", *own]


def test_ranks_of_the_wavelet_matrix():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        for levels in (1, 2, 3):
            symbols = r.integers(0, 1 << levels, n).astype(np.uint8)
            matrix = fill_middle.WaveletMatrix(symbols, levels)
            for s in range(1 << levels):
                assert matrix.rank(s, np.arange(n + 1)).tolist() == np.r_[0, np.cumsum(symbols == s)].tolist()


def plain_transform(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_plain_version_and_is_undone(spark):
    rows = [(k if k != 7 else None, t, "x", "y") for k, t in enumerate(texts_of(1, 300))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, key string")
    made = fill_middle.transform(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, made.collect()), key=key) == sorted((plain_transform(i, t) for i, t, *_ in rows), key=key)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = made.select(fill_middle.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_cuts_of_a_block_without_bytes():
    n, cuts, chars = fill_middle.cut_places(words_block(["", ""]), np.array([[5, 6], [7, 8]]))
    assert n.tolist() == [0, 0] and not cuts.any() and not chars.any()


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("heavy", [1, 4, 1024])
def test_copies_equal_plain_groups(spark, heavy):
    r = random.Random(heavy)
    pool = ["", " ", "a  b", "a b", "a\tb", "A b", "c" * 50_000, "é ", "x\x0b\x0cy"]
    rows = [(k, r.choice(pool + ["hot one"] * 12) if r.random() < 0.7 else f"only {k}", "z", 1) for k in range(600)] + [(3, "twice", "p", 2), (3, "twice", "q", 3), (None, "nobody", "z", 1), (None, None, "z", 1), (700, "nobody", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, row int").repartition(5)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.copy_groups(docs, heavy=heavy).collect()
    sha = lambda t: hashlib.sha256(normal(t).encode()).digest()
    order = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(((x.doc_id, x.keep_id, x.group_size, bytes(x.digest)) for x in got), key=order) == sorted(((i, least[normal(t)], len(groups[normal(t)]), sha(t)) for i, t, *_ in rows), key=order)
    kept = [x for x in got if x.kept]
    assert len(kept) == len(groups) == len({bytes(x.digest) for x in kept}) and all(x.doc_id == x.keep_id for x in kept)
    stay = exact_dedup.drop_copies(docs, heavy=heavy)
    assert stay.columns == docs.columns
    assert sorted((normal(x.text), order([x.doc_id])) for x in stay.collect()) == sorted((t, order([i])) for t, i in least.items())
    assert exact_dedup.copy_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_summaries_miss_no_frequent_digest(spark):
    r = random.Random(9)
    keys = [r.choice([1, 1, 2, 3, *range(4, 500)]) for _ in range(20_000)] + [7] * 3000
    rows = spark.createDataFrame([(str(k).encode(),) for k in keys], "digest binary").repartition(4)
    for counters in (8, 32, 2000):
        sums = {int(bytes(x.digest)): x.n for x in exact_dedup.misra_gries(rows, counters).groupBy("digest").agg(F.sum("n").alias("n")).collect()}
        for k in set(keys):
            true = keys.count(k)
            assert true - 2 * len(keys) / (counters + 1) <= sums.get(k, 0) <= true


def plain_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(0)
    y = x - sums // n - (sums % n) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), y @ axes / np.sqrt(values), values / np.square(y).sum() * n


@pytest.mark.parametrize(("n", "d", "shape"), [(300, 7, "flat"), (700, 150, "falling"), (900, 130, "pairs")])
def test_whitening_equals_dense_eigenvectors(spark, n, d, shape):
    r = np.random.default_rng(d)
    scale = {"flat": np.full(d, 1.0), "falling": 1.1 ** -np.arange(d), "pairs": 1.0 + (np.arange(d) // 2 < 12) * (12.0 - np.arange(d) // 2)}[shape]
    data = np.float32(r.standard_normal((n, d)) * scale * 5 + 3)
    rows = [(i, v) for i, v in enumerate(data.tolist())] + [(-1, None), (-2, [None] + [1.0] * (d - 1)), (-3, [math.nan] * d), (-4, [math.inf] * d), (-5, [1.0] * (d + 1)), (-6, []), (0, data[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = whitening.whitened_components(frame)
    rows_ = got.collect()
    k = min(32, d)
    count, deviation, whitened, explained = plain_whitening([*data, data[0]], k)
    assert len(rows_) == (n + 1) * k and {x.n for x in rows_} == {count}
    assert max(x.identity_error for x in rows_) < 1e-9
    table = np.zeros((k, n))
    for x in rows_:
        table[x.component - 1, x.vec_id] = x.whitened
        assert x.deviation == deviation[x.vec_id] and abs(x.explained / explained[x.component - 1] - 1) < 1e-10
    for c in range(k):
        assert min(np.abs(table[c] - s * whitened[:n, c]).max() for s in (1, -1)) < 1e-6, c


def test_whitening_without_variance_or_rank(spark):
    make = lambda rows: whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = make(rows)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    line = make([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)]).collect()
    assert {x.component for x in line} == {1} and abs(line[0].explained - 1) < 1e-12
    large = make([(k, [1e11 * k, 1.0]) for k in range(3)]).collect()
    assert any(x.deviation is None for x in large)


def test_eigenpairs_to_double_precision():
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.standard_normal((400, 400)))
    values = np.r_[np.linspace(10, 9.99, 20), 1 / np.arange(1, 381)]
    a = (q * values) @ q.T
    calls = []
    got, vectors = whitening.jacobi_davidson(lambda b: calls.append(b.shape) or a @ b, 400, 32)
    assert np.abs(got - values[:32]).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
    assert all(width <= 32 + whitening.GUARD for _, width in calls)
