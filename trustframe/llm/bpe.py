"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are encoded in pieces cut before white space that follows other text. No match of the split pattern crosses
such a place and no lookahead reaches past it, so the ids are those of the whole text. Null texts count as empty: no ids,
and decoding gives no bytes. Ids decode to raw bytes, which need not be valid UTF-8 for a part of the ids.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .words import arrow_rows

# Fixed value: the characters that the split pattern's \s means (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RARE_WHITE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_PAIRS = ("  ", " \n", "\n ", "\n\n")
SAFE_CUT = re.compile(f"[^{WHITE}](?=[{WHITE}])")
LONG_WHITE = re.compile(f"[{WHITE}]{{20000,}}")
PIECE_CHARS = 100_000


class Encoder:
    """The ids of whole texts by a vocabulary of ranks and a split pattern.

    Texts in which no two white-space characters adjoin are split by the pattern without its lookahead alternative: that
    one differs only in runs of white space, and without it the matcher needs no backtracking.
    """

    LOOKAHEAD = r"\s+(?!\S)|"

    def __init__(self, ranks: dict[bytes, int], pattern: str, piece_chars: int = PIECE_CHARS):
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = self.full
        if pattern.endswith(self.LOOKAHEAD + r"\s+"):
            self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(self.LOOKAHEAD, ""), mergeable_ranks=ranks, special_tokens={})
        self.piece_chars = piece_chars

    def short(self, text: str) -> list[int]:
        single = not any(x in text for x in WHITE_PAIRS) and not any(x in text for x in RARE_WHITE)
        return (self.plain if single else self.full).encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        """Very long runs of white space, on which the library's matcher fails, are one match each but for the last
        character, which goes with the next word."""
        if not text:
            return []
        if len(text) <= min(self.piece_chars, 20_000):
            return self.short(text)
        ids: list[int] = []
        start = 0
        for run in LONG_WHITE.finditer(text):
            for piece in safe_pieces(text[start:run.start()], self.piece_chars):
                ids += self.short(piece)
            start = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.full._encode_single_piece(text[run.start():start])
        for piece in safe_pieces(text[start:], self.piece_chars):
            ids += self.short(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.full.decode_bytes(ids)


@functools.cache
def encoder(rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> Encoder:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return Encoder(ranks, pattern, piece_chars)


def safe_pieces(text: str, most: int = PIECE_CHARS):
    """Pieces of about `most` characters whose matches are those of the whole text."""
    start = 0
    while len(text) - start > most:
        cut = SAFE_CUT.search(text, start + most)
        if not cut:
            break
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def encode(docs: DataFrame, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text; one row out for each row in, other columns are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(part):
        enc = encoder(rank_file, pattern, piece_chars)
        ids = [np.array(enc.encode(t), np.int32) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "ids": ids}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(arrow_rows(run, schema), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Adds the raw bytes that the column `ids` stands for. Null ids give no bytes."""
    kept = [c for c in encoded.columns if c != out]

    def run(batches):
        enc = encoder(rank_file, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                at = batch.schema.get_field_index("ids")
                raw = [enc.decode(ids.values.tolist()) if ids.is_valid else b"" for ids in batch.column(at)]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=kept + [out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(kept).schema)
    return encoded.mapInArrow(run, f"{schema}, `{out}` binary")
