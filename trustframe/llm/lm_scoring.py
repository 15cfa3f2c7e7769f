"""Language-model scores with stupid backoff, as joins with n-gram count tables.

S(w | context) = count(context w) / count(context) if the n-gram occurs at least `min_count` times in the corpus, else
`alpha` times the score with a shorter context; single words score count / N. A document's score is the sum of log S over
its words (lower-case A-Z, split at white space). Counts are those of all documents.

Documents are dealt into units of bounded text, written once. `exploded` names each n-gram once per unit, with its number of
occurrences there; these rows are dealt by the n-gram's hash. `counts` sums them to the count table, which is joined to the
rows where they lie: one shuffle serves both. Counts of n-grams that other units name too go back to each unit, where they
meet the texts and are summed per document. A frequent n-gram is one row per unit, so no key grows with its occurrences;
all joins sort and spill.

Null and empty texts have no words and score 0, as do very long ones without words; a text longer than a unit is a unit of
its own. Repeated rows count and are scored as often as they occur. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .words import hashes, ngrams, text_slices, words

UNIT_CHARS = 12_000_000


def _unit_grams(texts: list[str | None], order: int):
    """Word counts per text and, per order, the n-gram at each position."""
    each = [hashes(words(t)) for t in texts]
    sizes = np.array([len(h) for h in each])
    return sizes, [np.concatenate([ngrams(h, n) for h in each] or [np.empty(0, np.uint64)]) for n in range(1, order + 1)]


def units(docs: DataFrame, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """unit, place, doc_id, text, n_words of each row, written once so that units stay the same."""
    schema = pa.schema([("unit", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        unit, place, size = TaskContext.get().partitionId() << 32, 0, 0
        for part in text_slices(batches):
            if size and size + part.nbytes > unit_chars:
                unit, place, size = unit + 1, 0, 0
            size += part.nbytes
            texts = part.column("text").cast(pa.string())
            n_words = pa.array([len(words(t, False)) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, unit)), pa.array(np.arange(place, place + part.num_rows, dtype=np.int32)),
                                              part.column("doc_id"), texts, n_words], schema=schema)
            place += part.num_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "unit long, place int, doc_id long, text string, n_words long"), "lm-units")


def exploded(tagged: DataFrame, order: int) -> DataFrame:
    """unit, gram, times: the distinct n-grams of up to `order` words of each unit. A unit that is read in two tasks may name
    an n-gram twice."""
    schema = pa.schema([("unit", pa.int64()), ("gram", pa.int64()), ("times", pa.int32())])

    def named(unit: int, texts: list):
        for found in _unit_grams(texts, order)[1]:
            distinct, times = np.unique(found, return_counts=True)
            for a in range(0, len(distinct), 100_000):
                part = distinct[a:a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), unit)), pa.array(part), pa.array(times[a:a + 100_000].astype(np.int32))], schema=schema)

    def run(batches):
        unit, texts = None, []
        for batch in batches:
            own = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own) != 0) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and texts and own[a] != unit:
                    yield from named(unit, texts)
                    texts = []
                if a < b:
                    unit = int(own[a])
                    texts += batch.column("text").slice(a, b - a).to_pylist()
        if texts:
            yield from named(unit, texts)
    return tagged.select("unit", "text").mapInArrow(run, "unit long NOT NULL, gram long NOT NULL, times int NOT NULL")


def counts(rows: DataFrame) -> DataFrame:
    """gram, count: the count table of the n-grams that more than one unit names, dealt as `rows` are. The others are counted
    by their unit."""
    return rows.groupBy("gram").agg(F.sum("times").alias("count"), F.min("unit").alias("first"), F.max("unit").alias("last")).filter("first < last").select("gram", "count")


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, unit_chars: int = UNIT_CHARS) -> DataFrame:
    """doc_id, n_words and log_score (natural logarithm) of each row."""
    tagged = units(docs, unit_chars)
    total = tagged.agg(F.sum("n_words").alias("n")).first()["n"] or 1
    rows = exploded(tagged, order).repartition("gram")
    # both sides read all columns of `rows`, so that Spark shuffles them once
    answered = rows.join(counts(rows), "gram").filter("count > times").select("unit", "gram", "count")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, grams = _unit_grams(texts.column("text").to_pylist(), order)
        known, times = answers.column("gram").to_numpy().view(np.uint64), answers.column("count").to_numpy()
        by_gram = np.argsort(known)
        known, times = known[by_gram], times[by_gram]
        found = []
        for own in grams:
            distinct, place, here = np.unique(own, return_inverse=True, return_counts=True)
            at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            found.append((np.where(known[at] == distinct, times[at], here) if len(known) else here).astype(float)[place])
        scores = _sums(sizes, found, total, alpha, min_count)
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(scores)], schema=schema)
    texts = tagged.select("unit", "doc_id", "text")
    return texts.groupBy("unit").cogroup(answered.groupBy("unit")).applyInArrow(run, "doc_id long, n_words long, log_score double")


def _sums(sizes: np.ndarray, times: list[np.ndarray], total: int, alpha: float, min_count: int) -> np.ndarray:
    """Per text the sum of its words' log scores. times[n - 1]: in the corpus, of the n-gram that starts at each position, text by text."""
    if not len(times[0]):
        return np.zeros(len(sizes))
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    position = np.arange(len(row)) - starts[row]
    log_s = np.log(times[0] / total)
    for n in range(2, len(times) + 1):
        shorter, own = times[n - 2], times[n - 1]
        own_starts = np.cumsum(np.maximum(sizes - n + 1, 0)) - np.maximum(sizes - n + 1, 0)
        before_starts = np.cumsum(np.maximum(sizes - n + 2, 0)) - np.maximum(sizes - n + 2, 0)
        at = np.flatnonzero(position >= n - 1)
        first = position[at] - n + 1
        whole, context = own[own_starts[row[at]] + first], shorter[before_starts[row[at]] + first]
        log_s[at] = np.where(whole >= min_count, np.log(whole / context), np.log(alpha) + log_s[at])
    return np.bincount(row, log_s, minlength=len(sizes))
