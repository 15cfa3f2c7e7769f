"""Full-text search over blocks: postings, ranked search with prefixes, and bounded reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..functions.text import arabic_stem, index_text, index_tokens, location, search_form, snippet, strip_accents
from ..session import materialize, spread


def _searched(blocks: DataFrame) -> Column:
    return F.concat_ws(" ", F.when(F.col("section") != "", F.col("section")), F.col("text"))


def postings(blocks: DataFrame) -> DataFrame:
    """(token, block_id, tf). Counting combines before the shuffle; a token found everywhere is spread by block."""
    tokens = spread(blocks).select("block_id", F.explode(index_tokens(_searched(blocks))).alias("token"))
    return tokens.groupBy("token", "block_id").agg(F.count(F.lit(1)).alias("tf"))


def block_lengths(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", F.size(index_tokens(_searched(blocks))).alias("length"))


def document_frequencies(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("token").agg(F.count(F.lit(1)).alias("blocks"))


def write_index(blocks: DataFrame, path: str) -> None:
    """Postings in token order, so a prefix filter skips files and row groups by their token range.

    The block id takes part in the ranges: the postings of a word that is everywhere are spread over many files.
    """
    ranged = postings(blocks).repartitionByRange("token", "block_id").sortWithinPartitions("token", "block_id")
    ranged.write.mode("overwrite").parquet(f"{path}/postings")
    block_lengths(blocks).write.mode("overwrite").parquet(f"{path}/lengths")


def query_tokens(blocks: DataFrame, text: str) -> list[str]:
    """Stemmed words of the query in index form (evaluated once: a constant)."""
    words = F.transform(F.split(search_form(F.lit(text)), " "), lambda w: arabic_stem(w))
    parts = F.filter(F.flatten(F.transform(words, lambda w: F.split(strip_accents(w), r"[^\p{L}\p{N}\p{Co}]+"))), lambda w: w != "")
    tokens = blocks.sparkSession.range(1).select(F.array_distinct(parts).alias("t")).first().t
    if not tokens:
        raise ValueError("empty search text")
    return tokens


def _matches(blocks: DataFrame, tokens: list[str]) -> DataFrame:
    """(block_id, length, f): block length and how often each query word occurs as a word or prefix, by one scan.

    Only these numbers are kept; the texts are tokenised once and never shuffled.
    """
    words = spread(blocks).select("block_id", index_tokens(_searched(blocks)).alias("w"))
    def occurrences(prefix: str) -> Column:
        return F.size(F.filter("w", lambda x: x.startswith(prefix)))

    counts = [occurrences(t) for t in tokens]
    return materialize(words.select("block_id", F.size("w").alias("length"), F.array(*counts).alias("f")), "matches")


def _indexed_matches(posting_rows: DataFrame, lengths: DataFrame, tokens: list[str]) -> DataFrame:
    """The same from a stored index: a prefix filter on sorted postings reads only the row groups of the query words."""
    wanted = F.lit(False)
    for t in tokens:
        wanted = wanted | F.col("token").startswith(t)
    counts = [F.coalesce(F.sum(F.when(F.col("token").startswith(t), F.col("tf"))), F.lit(0)).cast("int") for t in tokens]
    hits = posting_rows.filter(wanted).groupBy("block_id").agg(F.array(*counts).alias("f"))
    return lengths.join(hits, "block_id", "left").select("block_id", "length", F.coalesce("f", F.array(*[F.lit(0)] * len(tokens))).alias("f"))


def search(blocks: DataFrame, text: str, limit: int = 20, kind: str | None = None, document: str | None = None,
           posting_rows: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Ranked hits (block_id, source_id, kind, location, snippet, score).

    Every query word must match as a word or as a prefix; rank is BM25 with a prefix counted as one term. The number of
    blocks, their mean length and the block frequency of each word come from one aggregate, used as scalars.
    """
    tokens = query_tokens(blocks, text)
    if posting_rows is None or lengths is None:
        matches = _matches(blocks, tokens)
    else:
        matches = _indexed_matches(posting_rows, lengths, tokens)
    found = [F.col("f")[i] > 0 for i in range(len(tokens))]
    stats = matches.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"),
                                 F.array(*[F.count_if(c) for c in found]).alias("df")).alias("s")).scalar()
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("length") / stats["mean"])
    score, every = F.lit(0.0), F.lit(True)
    for i, c in enumerate(found):
        idf = F.ln((stats["n"] - stats["df"][i] + 0.5) / (stats["df"][i] + 0.5))
        f = F.col("f")[i]
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (V.BM25_K1 + 1) / (f + norm)
        every = every & c
    scored = matches.filter(every).select("block_id", score.alias("score"))
    if kind or document:
        wanted = blocks.filter((F.col("kind") == kind) if kind else F.lit(True)).filter((F.col("source_id") == document) if document else F.lit(True))
        scored = scored.join(wanted.select("block_id"), "block_id", "left_semi")
    best = scored.orderBy(F.desc("score"), "block_id").limit(limit)             # ranked before any text is read
    top = blocks.join(best, "block_id").orderBy(F.desc("score"), "block_id")
    return top.select("block_id", "source_id", "kind", location(F.col("part"), F.col("page"), F.col("section"), F.col("kind")).alias("location"),
                      snippet(F.col("text"), F.array(*[F.lit(t) for t in tokens])).alias("snippet"), "score")


def scan_search(blocks: DataFrame, text: str) -> DataFrame:
    """Without an index: blocks whose index text contains every query word (a map-only scan)."""
    blocks = spread(blocks)
    haystack = index_text(_searched(blocks))
    condition = F.lit(True)
    for t in query_tokens(blocks, text):
        condition = condition & F.contains(strip_accents(haystack), F.lit(t))
    return blocks.filter(condition)


def read(blocks: DataFrame, document: str | None = None, part: str | None = None, page: int | None = None, section: str | None = None,
         block: int | None = None, around: int = 3, max_chars: int = 8000) -> DataFrame:
    """Blocks in order per document up to `max_chars` characters; the first block always shows.

    The running length is kept per document, which is bounded by the document.
    """
    rows = blocks
    if document is not None:
        rows = rows.filter(F.col("source_id") == document)
    if block is not None:
        rows = rows.filter(F.col("ord").between(block - around, block + around))
    if part is not None:
        rows = rows.filter(F.coalesce("part", F.lit("")) == part)
    if page is not None:
        rows = rows.filter(F.col("page") == page)
    if section:
        low = section.lower()
        rows = rows.filter(F.contains(F.lower("section"), F.lit(low)) | ((F.col("kind") == "heading") & F.contains(F.lower("text"), F.lit(low))))
    order = Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.length("text")).over(order)).withColumn("at", F.count(F.lit(1)).over(order))
    shown = rows.filter((F.col("upto") <= max_chars) | (F.col("at") == 1))
    return shown.select("source_id", "block_id", "ord", "kind",
                        location(F.col("part"), F.col("page"), F.col("section"), F.col("kind")).alias("location"), "text")


def around_hits(blocks: DataFrame, hits: DataFrame, around: int = 2) -> DataFrame:
    """Neighbours of many hits at once: (hit_id, block_id, ord, text). Hits (block_id) are looked up by document."""
    spots = hits.join(blocks.select("block_id", "source_id", "ord"), "block_id").select(
        F.col("block_id").alias("hit_id"), "source_id", F.explode(F.sequence(F.col("ord") - around, F.col("ord") + around)).alias("ord"))
    return spots.join(blocks.select("source_id", "ord", "block_id", "text"), ["source_id", "ord"]).select("hit_id", "block_id", "ord", "text")
