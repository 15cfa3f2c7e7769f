"""Jump consistent hashing: stable keys to shards without a ring table.

A key seeds a linear congruential generator whose draws are the shard counts at which the key jumps to the newest shard;
its shard among n is the last jump below n. So with one more shard a key either stays or moves into the new one, which
takes an even part of every other. The key is 64 bits of the MD5 of the key's text, the same on every engine.

A null key is the text `\\N`: all of them share a shard. Repeated keys share a shard, whatever else their rows hold. Null
texts have no bytes. An empty table gives no rows, and very long texts are only measured. Columns that come along sit in
the struct `doc`, so no name can clash.

Slots number the rows of a shard from 0 without a gap, in the order of an MD5 of the rows' (key, CRC, size): a function of the
data, not of its splits. Equal rows are counted before they are shuffled and dealt out again after, shards are cut into
blocks by that MD5, and blocks get their offsets from a prefix sum of their counts, so no task holds a shard or a hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hexadecimal digits of the row order that name a block: 4,096 blocks a shard.
BLOCK_DIGITS = 3
#: Equal rows that one row is dealt out into at once.
DEAL = 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among `shards`. The generator's multiplier and increment."""
    keys = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        keys[todo] = keys[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = 2147483648.0 / ((keys[todo] >> np.uint64(33)).astype(np.float64) + 1.0)
        after = ((shard[todo] + 1).astype(np.float64) * draw).astype(np.int64)
        todo, after = todo[after < shards], after[after < shards]
        shard[todo] = after
    return shard


def key_bits(key: Column) -> Column:
    """64 bits of the MD5 of the key's text, as a signed long."""
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    high, low = F.substring(F.md5(text), 1, 8), F.substring(F.md5(text), 9, 8)
    return F.shiftleft(F.conv(high, 16, 10).cast("long"), 32).bitwiseOR(F.conv(low, 16, 10).cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key among `shards`, from 0."""
    if shards < 1:
        raise ValueError("there is one shard at least")

    @F.pandas_udf("int")
    def among(bits: pd.Series) -> pd.Series:
        return pd.Series(jump(bits.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return among(key_bits(key))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns in `keep`, else all) and shard of every row; nothing is shuffled."""
    doc = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    return docs.select(doc.alias("doc"), shard_of(F.col(f"`{key}`"), shards).alias("shard"))


def moved(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """key, old and new shard of the rows that change their shard when `before` shards become `after`."""
    both = docs.select(F.col(f"`{key}`").alias("key"), shard_of(F.col(f"`{key}`"), before).alias("old_shard"), shard_of(F.col(f"`{key}`"), after).alias("new_shard"))
    return both.filter("old_shard != new_shard")


def write_shards(docs: DataFrame, folder: str, shards: int, key: str = "doc_id", files: int = 8) -> None:
    """The rows of `docs` below `folder` in one sub-folder per shard, of up to `files` files each, dealt by row so that a
    hot key does not make a hot task."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("a column is named shard already")
    dealt = docs.withColumn("shard", shard_of(F.col(f"`{key}`"), shards))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    dealt.repartition(shards * files, "shard", spread).write.partitionBy("shard").parquet(folder)


def slots(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size (UTF-8 bytes of the text, and 8), text_crc32, shard, slot and grown_shard (with one more shard)."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("\\N")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    dealt = counted.select("*", shard_of(F.col("key"), shards).alias("shard"), shard_of(F.col("key"), shards + 1).alias("grown_shard"), order.alias("order"))
    dealt = dealt.withColumn("block", F.substring("order", 1, BLOCK_DIGITS))
    blocks = dealt.groupBy("shard", "block").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("order", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(offsets, ["shard", "block"])
    hands = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(DEAL).cast("long"))).alias("hand"))
    many = hands.filter(F.col("copies") > DEAL).repartition("key", "hand")

    def out(frame: DataFrame) -> DataFrame:
        first = F.col("base") + F.col("ahead") + F.col("hand")
        last = first + F.least(F.lit(DEAL).cast("long"), F.col("copies") - F.col("hand")) - 1
        return frame.select("key", "size", "text_crc32", "shard", F.explode(F.sequence(first, last)).alias("slot"), "grown_shard")
    return out(hands.filter(F.col("copies") <= DEAL)).unionByName(out(many))
