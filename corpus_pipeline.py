"""A training corpus from the documents: quality classifier, quality rules, near-duplicate groups, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents. Rows with a null text are rejected by the quality rules, rows with a null doc_id are in no group and stay; of
repeated rows the near-duplicate stage keeps one, and rows that share a doc_id but not a text are judged each by its text.
Further columns of any name come along; an empty table gives no pieces.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustframe.llm import jaccard, packing, pii, quality, quality_rules, queries
from trustframe.session import materialize

#: Shingles of the near-duplicate stage, and the least similarity of a link in per cent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Ids that are broadcast to drop rows: 8 MB of them, some 30 MB as a hash table.
BROADCAST_IDS = 1_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more."""
    name = next(n for n in ("score", *(f"score_{i}" for i in range(len(docs.columns) + 1))) if n not in {c.lower() for c in docs.columns})
    scored = quality.score(docs, queries.quality_model(spark, sf_dir), name)
    return scored.filter(F.col(name) >= queries.KEEP_SCORE).select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble their language."""
    return quality_rules.judge(docs).filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id stays, of repeated rows one. Rows are told apart by doc_id and
    text: an id with several texts loses those whose group has a smaller row, and no other; rows without an id stay."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).filter("doc_id IS NOT NULL")
    twice = materialize(hashed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).filter("n > 1"), "repeated-ids")
    if twice.isEmpty():
        gone = _losers(jaccard.groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT))
        return _without(docs, gone)
    # the first text of an id (by its hash) goes by the id, each other one by a negative key of its own
    marked = docs.join(twice.select(F.col("doc_id").alias("__id"), F.col("first").alias("__first")), F.col("doc_id") == F.col("__id"), "left")
    key = F.when(F.col("__id").isNull() | (F.xxhash64("text") == F.col("__first")), F.col("doc_id").cast("long")).otherwise(
        F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = marked.select(key.alias("doc_id"), F.col("doc_id").alias("_own"), row.alias("_row"), "text")
    keyed = materialize(keyed, "keyed-documents")
    once = keyed.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(keyed.filter("doc_id IS NULL"))
    once = materialize(once, "different-documents")
    found = jaccard.groups(once.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    owners = found.join(once.filter("doc_id IS NOT NULL").select("doc_id", "_own"), "doc_id")
    best = owners.groupBy("component_id").agg(F.min(F.struct("_own", "doc_id")).alias("s"))
    gone = materialize(owners.join(best, "component_id").filter(F.col("doc_id") != F.col("s.doc_id")).select("doc_id").distinct(), "near-duplicates")
    return _without(once, gone).select("_row.*")


def _losers(grouped: DataFrame) -> DataFrame:
    return materialize(grouped.filter("doc_id != component_id").select("doc_id").distinct(), "near-duplicates")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id is not in `gone`; up to BROADCAST_IDS ids travel to the rows, more meet them by a shuffle."""
    few = gone.count() <= BROADCAST_IDS
    kept = F.broadcast(gone) if few else gone
    return docs.join(kept, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind; n_chars, where there is one, follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = packing.pack(docs, queries.TOKENIZER, queries.WINDOW)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules_stage), ("n-gram Jaccard join", near_duplicates),
          ("personal data", personal_data), ("packing", pack)]

#: The trained classifier, the merges and the spans have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
    return docs
