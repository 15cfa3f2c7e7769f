"""A stored search index that is never rebuilt on read.

Below one folder: `postings` (token, block_id, tf, length, source_id, kind), each file in token order, `blocks` (what a hit shows) in
the order of their ids, and `totals` (blocks and words of the corpus, one row). A search reads the token ranges of its words, ranks
by what the postings themselves hold, and fetches the texts of the best hits by their ids; the corpus is not read and
nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed_values as V
from ..functions.text import index_tokens, location, once, snippet
from ..session import store
from .search import _searched, query_tokens

#: Hits whose texts are fetched by a list of ids; more are joined.
FETCH = 1_000
#: Bytes of a dictionary of a column; the ids of a file's blocks fit.
DICTIONARY = 8 << 20
SHOWN = ["block_id", "source_id", "kind", "part", "page", "section", "text"]


def build_index(blocks: DataFrame, path: str) -> None:
    """Write the index of `blocks`. The words of a block are counted where it lies and each task sorts those of its blocks into its own
    files: postings are never shuffled, and the word that is everywhere is spread over all files. A block id that comes twice has
    its postings twice; a search adds them up."""
    shown = blocks.select(*SHOWN).repartitionByRange("block_id").sortWithinPartitions("block_id")
    store(shown, f"{path}/blocks", mode="overwrite")
    postings = blocks.select("block_id", "source_id", "kind", F.inline(_counted(index_tokens(_searched(blocks)))))
    postings = postings.select("token", "block_id", "source_id", "kind", "length", "tf").sortWithinPartitions("token", "block_id")
    store(postings, f"{path}/postings", mode="overwrite", **{"parquet.dictionary.page.size": str(DICTIONARY)})
    # the stored postings hold every word, so texts are not cut into words again
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    held = blocks.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings").select(none.alias("blocks"), F.col("tf").cast("long").alias("words"))
    totals = held.unionByName(blocks.select(one.alias("blocks"), none.alias("words"))).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("blocks", "words")])
    store(totals.coalesce(1), f"{path}/totals", mode="overwrite")


def _counted(words: Column) -> Column:
    """The different words of an array with their number: array<struct<length, token, tf>>; `length` is that of the array."""
    def firsts(w: Column) -> Column:
        return F.filter(F.transform(w, lambda t, i: F.when((i == 0) | (F.get(w, i - 1) != t), i)), lambda i: i.isNotNull())

    def counts(w: Column, at: Column) -> Column:
        return F.transform(at, lambda i, j: F.struct(F.size(w).alias("length"), F.get(w, i).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(w)) - i).alias("tf")))

    return once(F.sort_array(words), lambda w: once(firsts(w), lambda at: counts(w, at)))


def _ranges(tokens: list[str]) -> Column:
    wanted = F.lit(False)
    for t in tokens:
        wanted = wanted | F.col("token").startswith(t)
    return wanted


def ranked(spark: SparkSession, path: str, tokens: list[str], kind: str | None = None, document: str | None = None) -> DataFrame:
    """(block_id, score) of the blocks that hold every word as a word or a prefix, by BM25; a prefix counts as one term.

    How many blocks hold a word is counted on its postings, before the filters by kind and document.
    """
    totals = spark.read.parquet(f"{path}/totals").first()                       # one row
    n, mean = totals["blocks"], totals["words"] / max(1, totals["blocks"])
    postings = spark.read.parquet(f"{path}/postings").filter(_ranges(tokens))
    counts = [F.coalesce(F.sum(F.when(F.col("token").startswith(t), F.col("tf"))), F.lit(0)).alias(f"f{i}") for i, t in enumerate(tokens)]
    hits = postings.groupBy("block_id", "source_id", "kind").agg(F.first("length").alias("length"), *counts)
    held = hits.agg(F.array(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(tokens))]).alias("df")).scalar()
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("length") / F.lit(mean))
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(tokens)):
        f, df = F.col(f"f{i}"), held[i]
        idf = F.ln((F.lit(n) - df + 0.5) / (df + 0.5))
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (V.BM25_K1 + 1) / (f + norm)
        every = every & (f > 0)
    if kind:
        every = every & (F.col("kind") == kind)
    if document:
        every = every & (F.col("source_id") == document)
    return hits.filter(every).select("block_id", score.alias("score"))


def search_index(spark: SparkSession, path: str, text: str, limit: int = 20, kind: str | None = None, document: str | None = None) -> DataFrame:
    """Ranked hits (rank, block_id, source_id, kind, location, snippet, score), best first, ties to the smaller block id."""
    tokens = query_tokens(spark.range(1), text)
    best = ranked(spark, path, tokens, kind, document).orderBy(F.desc("score"), "block_id").limit(limit)
    blocks = spark.read.parquet(f"{path}/blocks")
    if limit <= FETCH:
        found = [tuple(r) for r in best.collect()]                              # at most FETCH rows
        best = spark.createDataFrame([(i, *r) for i, r in enumerate(found, 1)], "rank int, block_id string, score double")
        blocks = blocks.filter(F.col("block_id").isin([r[0] for r in found]))   # row groups of other ids are skipped
    else:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "block_id"))       # of `limit` rows
        best = best.select(place.alias("rank"), "block_id", "score")
    top = blocks.join(best, "block_id").orderBy("rank")
    return top.select("rank", "block_id", "source_id", "kind", location(F.col("part"), F.col("page"), F.col("section"), F.col("kind")).alias("location"),
                      snippet(F.col("text"), F.array(*[F.lit(t) for t in tokens])).alias("snippet"), "score")
