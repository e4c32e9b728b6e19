"""Secret and personal-data spans, and quality counts, against the plain patterns of their contracts."""

import hashlib
import random
import re
from collections import Counter

from sourceloom.llm import pii, quality, secret_scan

DOC = "doc_id long, text string, id string, spans string"

SECRETS = {
    "assign": (re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def digits(text):
    return re.sub(r"[^0-9]", "", text)


def checksum(text):
    n = [int(c) for c in digits(text)][::-1]
    return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0


PERSONAL = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m[0])) <= 19 and checksum(m[0])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m[0])) <= 15),
}


def expected(text, rules):
    found = []
    for k, (kind, (pattern, accept)) in enumerate(rules.items()):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if accept(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def random_texts(pieces, n=250, seed=5):
    r = random.Random(seed)
    made = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 25))) for _ in range(n)]
    return [None, "", " \n", *made, made[0], "é " * 30_000 + made[1]]


def check(spark, digest, rules, texts):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC).repartition(3)
    got = {r.doc_id: r for r in digest(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = expected(text, rules)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert not Counter(want) - Counter(filter(None, got[i].spans.split(",")))
        for kind in rules:
            assert got[i][f"n_{kind}"] == sum(x.startswith(kind + ":") for x in want)
    assert digest(docs.limit(0)).count() == 0
    assert len({got[i].spans for i, t in enumerate(texts) if t == texts[3]}) == 1


def test_secrets_equal_patterns(spark):
    pieces = ["password", "Passwd", "SECRET", "toKen", "api_key", "apikey", "toKen", "ſecret", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef",
              "é", "\n", "x", "abc_def", "-----BEGIN PRIVATE KEY-----", "ghp_", "a1B2" * 10, "𝄞"]
    check(spark, secret_scan.spans_digest, SECRETS, random_texts(pieces))


def test_personal_data_equals_patterns(spark):
    pieces = ["a.b", "@", "@x.org", "mail-1.com", ".", "..", "1", "25", "255", "256", "0", "00001", "192.168.0.1", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+", "+1 (202) 555-0143", "(", ")",
              "é", "\n", "x", "_%", "𝄞", "79927398713", "555"]
    check(spark, pii.personal_data_digest, PERSONAL, random_texts(pieces))


def test_redaction_leaves_no_secret(spark):
    texts = random_texts(["password=", "abcdef123", " ", "é", "AKIA" + "A1" * 10, "x", "\n"], 60)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC)
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    for i, text in enumerate(texts):
        assert not expected(got[i], SECRETS)
        if not expected(text, SECRETS):
            assert got[i] == text


def test_quality_counts_equal_brute_force(spark):
    texts = random_texts(["a ", "b ", "c ", "é ", "# ", "\n", "\t", "one two three ", "!!", "X"], 120)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC).repartition(3)
    rows = quality.judge(docs, quality.plan_cascade(docs, fraction=1.0)).collect()
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    for r in rows:
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.base_failed and r.kept) and (r.rejected_by is None) == r.kept == (r.doc_id in kept)
    assert quality.judge(docs.limit(0), quality.plan_cascade(docs.limit(0))).count() == 0
