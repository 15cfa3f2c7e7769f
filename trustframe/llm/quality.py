"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is sigmoid(b + <w, x> + sum over pairs <v_i, v_j> x_i x_j); the pair sum costs linear time, as
it equals half of (sum of v x) squared less the sum of squares, summed over the factors. Words are hashed to a fixed number
of ids and weigh 1 / sqrt(count); structure statistics and the length given with the text are binned and weigh 1.

Null, empty and very long texts are scored whole, empty ones by their structure bins; repeated rows get the same score, an
empty table none, and columns of any name may come along. Without labelled rows every score is 0.5; if all labels agree, the
score is near that label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import HASHED, N_STRUCTURE, featurise, labelled_sample, structure_ids, word_ids
from .words import arrow_rows

SAMPLE_ROWS = 6_000
FACTORS = 8
EPOCHS = 12
BATCH = 128


def feature_ids(text: str | None, n_chars: int | None) -> np.ndarray:
    return np.concatenate([word_ids(text), np.array(structure_ids(text, n_chars), np.int32) + HASHED])


def _values(ids: np.ndarray) -> np.ndarray:
    word = ids < HASHED
    return np.where(word, 1.0 / np.sqrt(max(1, int(word.sum()))), 1.0)


class FactorisationMachine:
    """Fitted by AdaGrad on logistic loss; deterministic for the same rows in the same order."""

    def __init__(self, dims: int = HASHED + N_STRUCTURE, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(dims)
        self.v = rng.normal(0, 0.02, (dims, factors))

    def _raw(self, ids, x, starts):
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts).sum(1)
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares), vx, sums

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of feature id lists, none of them empty."""
        if not rows:
            return np.empty(0)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        raw, _, _ = self._raw(np.concatenate(rows), np.concatenate([_values(r) for r in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7):
        if not rows:
            return self
        mean = np.clip(labels.mean(), 0.001, 0.999)
        self.bias = float(np.log(mean / (1 - mean)))
        rng, values = np.random.default_rng(seed), [_values(r) for r in rows]
        gw, gv = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                pick = order[at:at + BATCH]
                sizes = np.array([len(rows[i]) for i in pick])
                ids, x = np.concatenate([rows[i] for i in pick]), np.concatenate([values[i] for i in pick])
                raw, vx, sums = self._raw(ids, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
                e = np.repeat(error, sizes) * x
                used, place = np.unique(ids, return_inverse=True)
                dw = np.bincount(place, e) + decay * self.w[used]
                parts = e[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                dv = np.stack([np.bincount(place, parts[:, k]) for k in range(parts.shape[1])], 1) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                self.bias -= rate * float(error.sum())
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """A model of at most `sample_rows` labelled documents. Their feature ids, a few hundred numbers a row, come to the
    driver: the bound on rows and the fixed number of ids bound their size."""
    sample = labelled_sample(docs, labels, label, sample_rows)
    table = featurise(sample, ["doc_id", "label"], feature_ids).toArrow().sort_by([("doc_id", "ascending")])
    rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) for x in table.column("ids").combine_chunks()] if table.num_rows else []
    return FactorisationMachine().fit(rows, np.array(table.column("label").to_pylist(), float))


def score(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """All columns of docs and the score as `name`, which none of them may have, one row per row. The broadcast model has a
    fixed size (under 5 MB)."""
    small = FactorisationMachine(1, 1)
    small.bias, small.w, small.v = model.bias, model.w.astype(np.float32), model.v.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(small)
    source = docs.withColumn("text", F.col("text").cast("string"))
    from .features import pa_fields
    schema = pa.schema([*pa_fields(source, source.columns), (name, pa.float64())])

    def run(part):
        sizes = part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else [None] * part.num_rows
        rows = [feature_ids(t, n) for t, n in zip(part.column("text").to_pylist(), sizes)]
        return {c: part.column(c) for c in part.schema.names} | {name: shared.value.score(rows)}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(arrow_rows(run, schema), f"{ddl}, `{name}` double")
