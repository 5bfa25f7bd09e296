"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm import langid, minhash, packing, pii, tiling
from riskloom.llm.common import read
from riskloom.session import fresh_path, remove, run_folder, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language (null or without a letter); lang becomes the predicted one where none was given."""
    samples = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    schema = docs.select(*COLUMNS).schema
    found = langid.labelled(docs.select(*COLUMNS), samples)
    kept = found.filter(F.col("lang_pred") != langid.UND).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five-word shingles, similarity 0.8). Texts without a word go with none;
    of rows repeated with one doc_id and text, one stays."""
    found = minhash.near_duplicates(docs, shingle_words=5, percent=80)
    flags = found.groupBy("doc_id").agg(F.max("kept").alias("any_kept"), F.count("*").alias("n")).filter("doc_id IS NOT NULL AND (NOT any_kept OR n > 1)")
    flags = settle(flags, "flags")
    left = docs.select(*COLUMNS).join(flags.filter("NOT any_kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    again = flags.filter("any_kept").select("doc_id")
    if again.isEmpty():
        return left
    rows = left.join(again, "doc_id", "left_semi").withColumn(
        "r", F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("text", "lang", "source", "n_chars"))).filter("r = 1")
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(rows.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half or more of a benchmark item; the text alone decides, so ids may be null or repeat."""
    rows = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    held = tiling.contaminated(rows.select(F.col("text_key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return rows.join(held.select(F.col("doc_id").alias("text_key")).distinct(), "text_key", "left_anti").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in the place of personal data; n_chars follows the text."""
    out = pii.pseudonymize(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens."""
    return packing.pack(docs, keep_ids=False).drop("k")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

# Language models, tokenizers and keyed surrogates are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    What a stage has settled goes with it, and a stage's result once the next one is written; the last one stays.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with run_folder(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
