"""Registered queries of the text operators, with SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licenses, minhash, packing, pages, pii, quality, runs, tiling, toxicity, trie, viterbi
from .common import read


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymize(read(spark, folder, "documents")).select("doc_id", "n_entities", "text")


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"), shingle_words=3, percent=85)


def op3_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), keep_ids=False).drop("k")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    samples = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, samples).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(read(spark, folder, "pages"))


def op6_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents")).drop("source", "host_rate")


def op7_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.recognise(read(spark, folder, "documents"))


def op8_benchmark_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return viterbi.count_tokens(read(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(trie.with_family_head(read(spark, folder, "conversations")))


def op12_inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(read(spark, folder, "embeddings"), lambda id: id % 20 == 0, k=20)


def looped(docs: DataFrame) -> DataFrame:
    """Texts in which, for one doc_id in ten by its crc32, the words from a on repeat the p words from a on.

    Such a text comes with its words joined by single spaces; all others, and those without id or word, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    w = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("w")
    a = (g % n).cast("int")
    rest = n - a
    p = (F.floor(rest / (3 + g % 8)) + 1).cast("int")
    times = F.ceil(rest / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), rest)
    looped = F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " ")
    return w.withColumn("text", F.when(n > 0, looped).otherwise(F.col("text"))).drop("w")


def run_digests(found: DataFrame) -> DataFrame:
    """The run of greatest exact length / period (ties: smallest start, then period), and digests of all runs and of the kept words."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    none = F.element_at("runs", 1)
    best = F.aggregate(F.col("runs"), none, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_grammar_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(runs.periodic_runs(looped(read(spark, folder, "documents"))))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_pii_surrogates, op2_minhash_near_dedup, op3_harmonic_packing, op4_language_id, op5_main_text, op6_host_quality,
    op7_license_sentences, op8_benchmark_tiling, op9_token_counts, op10_toxicity,
    op11_prefix_trie, op12_inverted_multi_index, op13_grammar_runs, pipeline)}

_WORDS = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP_SQL = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM split),
gram AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met WHERE 100 * shared >= 85 * (na + nb - shared)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(d, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.d, edge.y FROM reach JOIN edge ON edge.x = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.r AS component_id, s.doc_id = m.r AS kept
FROM sets s JOIN (SELECT d, min(r) AS r FROM reach GROUP BY d) m ON m.d = s.doc_id"""

QUALITY_SQL = rf"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
run AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM split, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM run) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM split),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, {_WORDS}) GROUP BY doc_id),
base AS (SELECT s.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN dup d ON d.doc_id = s.doc_id LEFT JOIN repeated r ON r.doc_id = s.doc_id),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM failed WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT sum(f) / CAST(sum(n) AS DOUBLE) AS m, var_pop(f / CAST(n AS DOUBLE)) AS v FROM host),
weight AS (SELECT m, v, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) END AS s FROM prior),
rate AS (SELECT source, CASE WHEN v > 0 THEN (f + m * s) / (n + s) ELSE m END AS host_rate FROM host, weight)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_rate, 0) <= 0.5 AS kept FROM failed LEFT JOIN rate USING (source)"""

# crc32 has no function in this SQL: one row for each bit of the decimal id.
TRIE_SQL = """
WITH RECURSIVE id AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
bits(c, s, k, v) AS (SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM id UNION ALL
  SELECT c, s, k + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (
    SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x FROM bits WHERE k < 8 * length(s))),
head AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM bits WHERE k = 8 * length(s)),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations),
mixed AS (SELECT head.c, 0 AS part, i, r, t FROM head JOIN turns ON turns.c = head.c - head.c % 5 WHERE i <= h
  UNION ALL SELECT head.c, 1, i, r, t FROM head JOIN turns ON turns.c = head.c WHERE i > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, md5(length(r) || ':' || r || ':' || t) AS k, strlen(t) AS b FROM mixed),
member AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS p, b FROM placed UNION ALL SELECT c, 0, '', 0 FROM id),
last AS (SELECT c, max(d) AS d FROM member GROUP BY c),
node AS (SELECT p, m.d, min(m.c) AS conv_id, count(*) AS n, any_value(b) AS b, string_agg(CAST(l.c AS VARCHAR), ',' ORDER BY l.c) AS ends
  FROM member m LEFT JOIN last l ON l.c = m.c AND l.d = m.d GROUP BY p, m.d),
kids AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own AS (SELECT node.p, d, (n_kids IS NULL)::BIGINT AS leaf, (node.n - 1) * b AS saved FROM node LEFT JOIN (SELECT p, n AS n_kids FROM kids) k ON k.p = node.p),
below AS (SELECT left(p, 32 * a) AS p, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM node x JOIN below ON below.p = x.p LEFT JOIN kids ON kids.p = x.p LEFT JOIN node up ON up.d = x.d - 1 AND up.p = left(x.p, 32 * (x.d - 1))"""

SQL = {
    "op2_minhash_near_dedup": NEAR_DEDUP_SQL,
    "op6_host_quality": QUALITY_SQL,
    "op7_license_sentences": licenses.duckdb_sql(),
    "op11_prefix_trie": TRIE_SQL,
}
