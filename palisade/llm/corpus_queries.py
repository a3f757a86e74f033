"""Registered queries over whole corpora: decontamination, filter audit, importance resampling; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontamination, filter_audit, importance
from palisade.llm.common import table


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
        percent=10, least_words=20, order=1, buckets=10_000, seed=2024,
    )
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op11_decontamination, op12_filter_audit, op13_importance_resampling)}

_WORDS = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
items AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
starts AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM places),
hits AS (SELECT r.doc_id, r.i, r.n, w.item FROM runs r JOIN windows w ON w.run = r.run AND w.n = r.n),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
c(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.name || b.name || c1.name || d.name || e.name AS filter_order, [a.bit, b.bit, c1.bit, d.bit, e.bit] AS bits
  FROM c a, c b, c c1, c d, c e WHERE a.bit + b.bit + c1.bit + d.bit + e.bit = 31
    AND a.bit <> b.bit AND a.bit <> c1.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c1.bit
    AND b.bit <> d.bit AND b.bit <> e.bit AND c1.bit <> d.bit AND c1.bit <> e.bit AND d.bit <> e.bit),
s AS (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o),
s2 AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM s),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s2 GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

# crc32 over a word's bytes, by the usual table of 256 remainders, built here from the polynomial.
_IMPORTANCE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda x, y:
        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
words AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
bytes AS (SELECT word, hex(encode(word)) AS h FROM words),
buckets AS (
  SELECT word, xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda j: CAST(concat('0x', substr(h, CAST(2 * j + 1 AS INT), 2)) AS BIGINT))),
           lambda x, y: xor(x >> 8, t[CAST(xor(x & 255, y) AS INT) + 1]))) % 10000 AS bucket
  FROM bytes, k),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN buckets USING (word) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM bw) AS all_t),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE)
           / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket, a),
weights AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN buckets USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(concat('0x', substr(sha256(concat('2024:', CAST(d.doc_id AS VARCHAR))), 1, 8)) AS BIGINT) AS h
  FROM d LEFT JOIN weights ON weights.doc_id = d.doc_id),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM y LEFT JOIN r ON r.doc_id = y.doc_id
"""

ORACLES = {
    "op11_decontamination": _DECONTAMINATION, "op12_filter_audit": _AUDIT, "op13_importance_resampling": _IMPORTANCE,
}
