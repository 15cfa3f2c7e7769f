"""Sparse text features and bounded training samples for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import arrow_rows, hashes, words

HASHED = 1 << 16
# Fixed value: bytes that are no part of a word: ASCII other than letters and digits.
PLAIN_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_ids(text: str | None, dims: int = HASHED) -> np.ndarray:
    """Sorted distinct hashed ids of the words, without punctuation and in lower case (A-Z)."""
    if not text:
        return np.empty(0, np.int32)
    tokens = text.encode("utf-8", "surrogatepass").lower().translate(PLAIN_WORDS).split()
    return np.unique((hashes(tokens) & np.uint64(dims - 1)).astype(np.int32))


def stem_ids(text: str | None, dims: int) -> np.ndarray:
    """As word_ids, with the words' beginnings of 4 and of 6 bytes as further features, for inflected forms."""
    if not text:
        return np.empty(0, np.int32)
    tokens = set(text.encode("utf-8", "surrogatepass").lower().translate(PLAIN_WORDS).split())
    tokens |= {b"4 " + t[:4] for t in tokens if len(t) > 4} | {b"6 " + t[:6] for t in tokens if len(t) > 6}
    return np.unique((hashes(list(tokens)) & np.uint64(dims - 1)).astype(np.int32))


def _bin(x: float, edges: tuple) -> int:
    return int(np.searchsorted(edges, x, side="right"))


SHARE = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85)
LOGS = tuple(float(x) for x in range(1, 22))
LENGTHS = (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 15.0)
N_BINS = 24
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
PUNCTUATION = b"!\"'()+,-./:;=?@[]^_`{}~"


def structure_ids(text: str | None, n_chars: int | None) -> list[int]:
    """One id per statistic of the text's structure and of its metadata (`n_chars`), each the statistic's bin."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size, tokens = max(1, len(raw)), words(text)
    n = max(1, len(tokens))
    h = hashes(tokens)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    runs = h[1:] == h[:-1]
    triples = h[2:] == h[:-2] if len(h) > 2 else runs[:0]
    stats = [
        _bin(np.log2(n), LOGS), _bin(np.log2(size), LOGS), _bin(float(runs.sum()) / n, SHARE), _bin(float(triples.sum()) / n, SHARE),
        _bin(len(np.unique(h)) / n, SHARE), _bin(share(SYMBOLS), SHARE), _bin(share(UPPER), SHARE), _bin(share(DIGITS), SHARE),
        _bin(share(PUNCTUATION), SHARE), _bin(share(b"!"), SHARE), _bin(sum(map(len, tokens)) / n, LENGTHS),
        _bin(1 - len(set(lines)) / max(1, len(lines)), SHARE), _bin(tokens.count(b"|") / n, SHARE), _bin(float(runs.any()), (0.5,)),
        N_BINS - 1 if n_chars is None else _bin(np.log2(max(1, n_chars)), LOGS), _bin(share(b"|"), SHARE),
    ]
    return [i * N_BINS + min(b, N_BINS - 1) for i, b in enumerate(stats)]


N_STRUCTURE = 16 * N_BINS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """Texts of at most `most_rows` labelled documents, the same ones on every run: those with the smallest hash of their id.

    The labels are cut to the bound before the texts are read, so the broadcast side has `most_rows` rows at most. Rows
    with a null id or label are no training rows; of several labels of one id the largest counts, and of several texts of
    one id each is used.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", "text", *[c for c in ("n_chars",) if c in docs.columns])         # other columns may be called label
    return texts.join(F.broadcast(few), "doc_id")


def featurise(rows: DataFrame, columns: list[str], features, value_type: str = "array<int>") -> DataFrame:
    """The given columns of rows with `ids`, the feature ids of (text, n_chars)."""
    with_size = [*columns, "text"] + (["n_chars"] if "n_chars" in rows.columns else [])
    source = rows.select(*with_size)
    schema = {f.name: f.dataType.simpleString() for f in source.select(*columns).schema}
    arrow = pa.schema([*pa_fields(source, columns), ("ids", pa.list_(pa.int32()))])

    def run(part):
        sizes = part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else [None] * part.num_rows
        ids = [features(t, n) for t, n in zip(part.column("text").to_pylist(), sizes)]
        return {c: part.column(c) for c in columns} | {"ids": ids}
    return source.mapInArrow(arrow_rows(run, arrow), ", ".join(f"`{c}` {t}" for c, t in schema.items()) + f", ids {value_type}")


def pa_fields(df: DataFrame, columns: list[str]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    return list(to_arrow_schema(df.select(*columns).schema))
