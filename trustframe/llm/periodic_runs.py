"""Periodic runs of words: descending-LCP Kruskal over suffix classes.

A run is a stretch of words with smallest period q, `times` periods and `least` words long or more, that no neighbouring
word extends keeping that period. Suffixes of one text that share a prefix form classes; classes are united in the order
of falling LCP, and each keeps its positions ordered. Two positions p < q that become neighbours when classes unite at
LCP l have l words in common and no nearer such position between them: where q - p <= l they seed the run of period
q - p that ends at q + l, and it starts at p if the words before p and q differ.

Words are maximal runs of characters other than space and U+0009-U+000D. A null or empty text has no words and no runs,
and collapses to an empty text. Rows are independent: repeated rows and ids give repeated results, an empty table gives
none, columns named in `keep` come back in the struct `doc`, so no name can clash. A very long text is handled whole, in
memory in proportion to its words; shorter ones share batches of bounded size.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .words import text_slices

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and the words of all texts one after the other (binary)."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    pieces = pc.split_pattern_regex(raw, r"[\x20\x09-\x0D]+")
    flat, parents = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    real = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(parents.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return np.concatenate(([0], np.cumsum(counts))), flat.filter(real)


def _group_starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: the index of the first equal key."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def repeated_suffixes(ids: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the texts in suffix order, and for each the group of its first `2^floor(log2(least))` words.

    Only suffixes that share that many words with another one of the same text are returned. Prefix doubling: after a
    round of width h the rank of a suffix orders its first 2 h words, and only unsettled ranks take part in the next.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    key = text * np.int64(int(ids.max(initial=0)) + 1) + ids
    active = np.argsort(key, kind="stable")
    starts = _group_starts(key[active])
    rank = np.empty(n, np.int64)
    rank[active] = starts
    shared, group, width = None, None, 1
    while True:
        sizes = np.bincount(starts, minlength=len(starts))[starts] if len(starts) else starts
        active = active[sizes > 1]
        if shared is None and 2 * width > least:
            shared, group = active, rank[active]
        if not len(active):
            break
        ahead = active + width
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        pair = rank[active] * np.int64(n + 2) + second
        order = np.argsort(pair, kind="stable")
        active, pair = active[order], pair[order]
        starts = _group_starts(pair)
        first = _group_starts(pair // (n + 2))
        rank[active] = pair // (n + 2) + starts - first
        width *= 2
    if shared is None:
        return active, active
    order = np.argsort(rank[shared], kind="stable")
    return shared[order], group[order]


def neighbour_lcps(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, group: np.ndarray, known: int) -> list[tuple[int, int, int]]:
    """(lcp, earlier in suffix order, later) of neighbours in one group, whose first `known` words agree.

    Positions are visited in text order, so each comparison starts where the one before ended, less one word.
    """
    later = np.flatnonzero(group[1:] == group[:-1]) + 1
    pairs = np.stack([order[later], order[later - 1]], axis=1)
    pairs = pairs[np.argsort(pairs[:, 0])]
    word, out, before, shared = array("q", ids.tobytes()), [], -2, 0
    stop = ends[pairs.max(axis=1)] if len(pairs) else pairs[:, 0]
    for (p, q), end in zip(pairs.tolist(), stop.tolist()):
        shared = max(shared - 1 if p == before + 1 else 0, known)
        most = end - max(p, q)
        while shared < most and word[p + shared] == word[q + shared]:
            shared += 1
        out.append((shared, q, p))
        before = p
    return out


def kruskal_runs(ids: np.ndarray, offsets: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(position, length, period) of every run, positions counted over all texts.

    A run of period q is seeded at an LCP of its length less q, thus at `enough` or more; lower ones unite nothing of use.
    """
    enough = min(max(least, times * q) - q for q in range(1, least + 1))
    order, group = repeated_suffixes(ids, offsets, enough)
    if not len(order):
        return []
    firsts, ends = offsets[:-1], np.repeat(offsets[1:], np.diff(offsets))
    edges = [e for e in neighbour_lcps(ids, ends, order, group, 1 << (enough.bit_length() - 1)) if e[0] >= enough]
    edges.sort(key=lambda e: -e[0])
    text_start = {*firsts.tolist()}
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    runs = []

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def seed(p: int, q: int, lcp: int) -> None:
        period = q - p
        if period + lcp >= max(least, times * period) and (p in text_start or ids[p - 1] != ids[q - 1]):
            runs.append((p, period + lcp, period))

    for lcp, a, b in edges:
        a, b = find(a), find(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for x in small:
            insort(large, x)
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (k == 0 or large[at - 1] != small[k - 1]):
                seed(large[at - 1], x, lcp)
            if at + 1 < len(large) and (k + 1 == len(small) or large[at + 1] != small[k + 1]):
                seed(x, large[at + 1], lcp)
        parent[b] = a
        members[a] = large
    return runs


def find(docs: DataFrame, keep: list[str] | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """Per row of `docs` (a column `text`): doc (struct of the columns in `keep`, all but text unless given), n_words,
    runs (by start, then period; starts are word numbers) and collapsed (the words that no run repeats, joined by a blank:
    of each run only the first period stays)."""
    if least < 1 or times < 2:
        raise ValueError("a run has a word and two periods at least")
    kept = [c for c in docs.columns if c != "text"] if keep is None else keep
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(doc.alias("doc"), F.col("text").cast("string").alias("text"))
    result = StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, collapsed string")
    result = StructType([rows.schema["doc"], *result.fields])
    schema = to_arrow_schema(result)
    run_type = schema.field("runs").type

    def run(batches):
        for part in text_slices(batches):
            offsets, words = word_lists(part.column("text"))
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.array(kruskal_runs(ids, offsets, least, times), np.int64).reshape(-1, 3)
            found = found[np.lexsort((found[:, 2], found[:, 0]))]
            text = np.searchsorted(offsets, found[:, 0], side="right") - 1
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            stays = np.cumsum(change)[:-1] == 0
            before = np.concatenate(([0], np.cumsum(stays)))[offsets]
            lists = pa.LargeListArray.from_arrays(pa.array(before, pa.int64()), words.filter(pa.array(stays)))
            collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(schema.field("collapsed").type)
            structs = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 0] - offsets[text], found[:, 1], found[:, 2])], fields=list(run_type.value_type))
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=part.num_rows)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs).cast(run_type)
            yield pa.RecordBatch.from_arrays([part.column("doc").cast(schema.field("doc").type), pa.array(np.diff(offsets), pa.int64()), listed, collapsed], schema=schema)

    return rows.mapInArrow(run, result)
