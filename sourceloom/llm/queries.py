"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import chat_repair, decontamination, exact_dedup, fill_middle, fixity, jaccard_join, license_scan, mixing, pii, quality, secret_scan, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.spans_digest(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica: some payloads differ by their last character, some records are lost, chosen by the id's MD5."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    broken = F.when(mark == "00", F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("\x00"))).otherwise(F.col("html"))
    return pages.where(mark != "01").withColumn("html", broken)


def op6_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, damaged(pages))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.plan_cascade(docs)).drop("rejected_by")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform_digest(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_personal_data": op5_personal_data,
    "op6_fixity_audit": op6_fixity_audit,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_chat_repair": op10_chat_repair,
    "op11_fill_middle": op11_fill_middle,
    "op12_whitening": op12_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}

_WORDS = r"""words AS (SELECT doc_id, t, w, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i FROM (
  SELECT doc_id, coalesce(text, '') AS t, UNNEST(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents))"""

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, UNNEST(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
cc(doc_id, comp) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM w UNION (SELECT u.doc_id, MIN(v.comp) FROM recurring.cc u JOIN ways ON ways.x = u.doc_id JOIN cc v ON v.doc_id = ways.y WHERE v.comp < u.comp GROUP BY u.doc_id))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, comp AS component_id FROM cc LEFT JOIN sizes USING (doc_id)""",
    "op6_fixity_audit": r"""WITH marked AS (SELECT page_id, strlen(html) AS bytes, substr(md5(page_id::VARCHAR), 1, 2) AS mark FROM pages),
placed AS (SELECT page_id, page_id // 1024 AS archive, mark, bytes, (SUM(bytes) OVER (PARTITION BY page_id // 1024 ORDER BY page_id))::BIGINT AS "end" FROM marked)
SELECT page_id, archive, ("end" - bytes)::BIGINT AS start, "end", CASE mark WHEN '00' THEN 'changed' ELSE 'missing' END AS state
FROM placed WHERE mark IN ('00', '01')""",
    "op7_mixing": r"""WITH RECURSIVE sizes AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT COUNT(*) FROM documents)::DOUBLE / ((SELECT COUNT(*) FROM sizes)::DOUBLE * n) AS rate FROM sizes),
steps AS (SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS cdf FROM rates
  UNION ALL SELECT source, rate, k + 1, lg + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(lg + ln(rate) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
draws AS (SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counts AS (SELECT d.doc_id, COUNT(s.k) AS n FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.cdf <= d.u GROUP BY d.doc_id)
SELECT doc_id, text, lang, source, n_chars, UNNEST(range(n))::INTEGER AS copy FROM counts JOIN documents USING (doc_id)""",
    "op8_quality_rules": "WITH " + _WORDS + r""",
windows AS (SELECT doc_id, i, w || ' ' || LEAD(w) OVER p || ' ' || LEAD(w, 2) OVER p AS g FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
  length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS upper_n, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS letters,
  len(regexp_extract_all(coalesce(text, ''), '!!')) AS bangs, len(regexp_extract_all(coalesce(text, ''), chr(10))) + 1 AS all_lines FROM documents),
base AS (SELECT c.*, coalesce(n_dup_lines, 0) AS dups, coalesce(n_repeat_words, 0) AS reps,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS failed
  FROM counts c LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
  reps::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT (failed OR 10 * n_symbols > n_words OR 10 * upper_n > 3 * letters OR 10 * bangs > n_words OR 2 * dups > all_lines
       OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)) AS kept
FROM base""",
    "op11_fill_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, t, n, form, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op13_exact_dedup": r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, MIN(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, doc_id = MIN(doc_id) OVER g AS kept, h AS text_sha256 FROM d WINDOW g AS (PARTITION BY h)""",
}
