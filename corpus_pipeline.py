"""Corpus pipeline: quality, near duplicates, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before it kept, and returns a DataFrame; ``run`` writes each result as Parquet
under the shared scratch folder and reads it back, so a lost executor costs a
stage at most.  All stages but the last return the columns of ``documents``.

Defined cases: a null or empty text is scored, kept or rejected like any other;
it is nobody's near duplicate, holds no leak and no personal data, and has no
tokens.  Rows repeated in full count as one document from the second stage on.
Null ids are carried.  Further columns of ``documents`` are carried through the
filtering stages.  Empty tables give an empty result.
"""

from __future__ import annotations

import gc

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.llm import byte_bpe, decontamination, jaccard_join, pii, quality
from solstice.llm import words as W
from solstice.llm.graph import stored

#: Least quality score of a document that stays.
MIN_QUALITY = 0.5
#: Near duplicates: word shingles and percent of similarity.
SHINGLE, PERCENT = 5, 80
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Rows of an Arrow batch: texts are long, and Spark's default of 10,000 rows would fill a worker's memory.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Also lets go of the plans and arrays of the stage before, which is stored by now."""
    gc.collect()
    W.give_back()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores ``MIN_QUALITY`` or more; it learns from the labels outside the held-out third."""
    _small_batches(spark)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out), label_col="quality")
    return quality.score_rows(docs, model, score_col="_quality").filter(F.col("_quality") >= MIN_QUALITY).drop("_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by their 5-word shingles: the one with the smallest id."""
    _small_batches(spark)
    groups = jaccard_join.jaccard_components(docs, n=SHINGLE, percent=PERCENT)
    stay = groups.filter("is_first").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.hash("text"))
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed["_text_key"] == stay["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _small_batches(spark)
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find(docs, pii.train(docs), spans_col="_spans", base_col="_base_spans")
    clean = pii.redact(found, spans_col="_spans").drop("_spans", "_base_spans")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return clean.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every document, and whether decoding gives the text back."""
    _small_batches(spark)
    ranks = public_tokenizers.path(RANKS)
    base = docs.select("doc_id", "lang", "source", "text")
    back = byte_bpe.decode(byte_bpe.encode(base, ranks, public_tokenizers.PATTERN), ranks)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_pii),
    ("byte_bpe", tokenize),
]

#: Learned scores, similarity search and tokens are no SQL; the tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
