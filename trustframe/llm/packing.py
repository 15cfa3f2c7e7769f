"""Concatenate and cut: token streams of all documents end to end, cut into fixed windows.

Pass one tokenises each document once and writes its ids with the number of tokens before it in its partition. Pass two
turns the partitions' totals into global offsets by a prefix sum (one row per partition), and cuts each document at the
multiples of the window. Every window but the last is full. Null texts count as empty; every document ends with
`end_id`, so an empty one is that id alone. Repeated rows are packed as often as they occur. An empty table packs into
no rows.
"""

from __future__ import annotations

import functools
import json
import os
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import TEXT_ROWS, materialize
from .bpe import Encoder
from .words import text_slices

# Fixed value: the split pattern of byte-level BPE vocabularies.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: texts that are held as ids at a time; a longer text is held whole.
SLICE_CHARS = 1_000_000


class _Tokenizer:
    """Little-endian 32-bit ids of whole texts.

    If the file is a plain byte-level BPE whose ids follow the order of its merges (checked here), its merges run in
    tiktoken's core, which gives the ids of the `tokenizers` library in a quarter of the time. Else, and for texts that
    spell a special token, the library itself encodes.
    """

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.file = tokenizer_file
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.core = _merge_core(spec)

    @functools.cached_property
    def library(self):
        """The library's tokenizer, loaded when a text needs it: it holds the vocabulary a second time."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> bytes:
        if self.core is None or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.core.encode(text)).tobytes()


def _merge_core(spec: dict) -> Encoder | None:
    """An encoder with the same vocabulary, or None if the file's rules are not plain byte-level BPE."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout"))
    if not plain:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(char_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][m] for m in merges]
    if len(ranks) != 256 + len(merges) or order != sorted(order) or (order and order[0] < 256):
        return None
    return Encoder(ranks, BYTE_LEVEL_PATTERN)


@functools.cache
def _tokenizer(tokenizer_file: str) -> _Tokenizer:
    return _Tokenizer(tokenizer_file)


def token_bytes(text: str | None, tokenizer_file: str, end_id: int | None = None) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit integers, then `end_id`."""
    end = b"" if end_id is None else struct.pack("<I", end_id)
    return _tokenizer(tokenizer_file).ids(text or "") + end


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """doc_id, part, before (tokens before the document in its partition), n, ids (binary), written to the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        part, before = TaskContext.get().partitionId(), 0
        for rows in text_slices(batches, SLICE_CHARS):
            raw = [token_bytes(t, tokenizer_file, end_id) for t in rows.column("text").to_pylist()]
            counts = [len(x) // 4 for x in raw]
            starts = []
            for n in counts:
                starts.append(before)
                before += n
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([part] * len(raw), pa.int32()),
                                              pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(raw, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, part int, before long, n long, ids binary"), "pack-tokens", TEXT_ROWS)


def pack(docs: DataFrame, tokenizer_file: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary of the piece).

    The offsets come from partition totals: their frame has one row per partition of the tokenised input, is written
    first, and is broadcast only if Spark finds it below its limit; else the join shuffles.
    """
    tokens = tokenise(docs, tokenizer_file, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base")), "pack-offsets")
    at = F.col("base") + F.col("before")

    def piece(k):
        low = F.greatest(k * window - F.col("at"), F.lit(0).cast("long"))
        high = F.least((k + 1) * window - F.col("at"), F.col("n"))
        return F.struct(k.alias("sequence_id"), low.alias("start"), (high - low).alias("length"), F.greatest(F.col("at") - k * window, F.lit(0).cast("long")).alias("offset"),
                        F.substring(F.col("ids"), (low * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"))

    rows = tokens.join(offsets, "part").withColumn("at", at)
    first, last = F.expr(f"`at` div {window}"), F.expr(f"(`at` + n - 1) div {window}")
    cut = rows.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")
