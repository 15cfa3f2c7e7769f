"""Toxicity: cumulative-link ordinal regression over hashed words and their beginnings.

P(severity > j) = sigmoid(<w, x> - threshold_j) for ordered thresholds and one weight vector. The result is the expected
severity, the sum of these probabilities (0 to the number of thresholds). Labels only say toxic or not, so toxic training rows are graded
1 to 3 by the density of telling words: words far more frequent, by documents, among the toxic rows of the sample.

x holds 1 for each hashed word or beginning that occurs; null and empty texts have none and get the baseline. Without toxic training
rows the severity is near 0 everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import featurise, labelled_sample, stem_ids
from .words import arrow_rows

SAMPLE_ROWS = 6_000
GRADES = 4
TELLING_RATIO = 20.0     # of document frequencies, toxic to other
TELLING_DOCS = 0.02      # least share of the toxic documents
ROUNDS = 100
HASHED = 1 << 18


def _ids(text: str | None, _n_chars: int | None) -> np.ndarray:
    return stem_ids(text, HASHED)


def grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic ones 1 to 3 by terciles of the share of telling words among their words."""
    bad, good = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    def df(flag):
        chosen = [r for r, t in zip(rows, toxic) if t == flag]
        return np.bincount(np.concatenate(chosen), minlength=HASHED) if chosen else np.zeros(HASHED, int)
    inside, outside = df(1), df(0)
    telling = (inside >= max(2, TELLING_DOCS * bad)) & ((inside + 0.5) / bad >= TELLING_RATIO * (outside + 0.5) / good)
    density = np.array([telling[r].mean() if len(r) else 0.0 for r in rows])
    of_toxic = density[toxic == 1]
    if not len(of_toxic):
        return np.zeros(len(rows), int)
    edges = np.quantile(of_toxic, [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (density > edges[0]) + (density > edges[1]), 0)


class OrdinalModel:
    """Proximal AdaGrad on the summed logistic losses of the thresholds; the L1 term keeps only telling words."""

    def __init__(self, n_grades: int = GRADES):
        self.w, self.thresholds = np.zeros(HASHED), np.linspace(1.0, 3.0, n_grades - 1)

    def exceed(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(severity > j) for each row and each threshold."""
        z = np.array([self.w[r].sum() for r in rows])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))

    def fit(self, rows: list[np.ndarray], grade: np.ndarray, rounds: int = ROUNDS, rate: float = 0.4, penalty: float = 2e-4):
        if not rows:
            return self
        sizes, ids = np.array([len(r) for r in rows]), np.concatenate(rows)
        row_of = np.repeat(np.arange(len(rows)), sizes)
        above = (grade[:, None] > np.arange(len(self.thresholds))[None, :]).astype(float)
        gw, gt = np.full(HASHED, 1e-6), np.full(len(self.thresholds), 1e-6)
        for _ in range(rounds):
            z = np.bincount(row_of, self.w[ids], minlength=len(rows))
            error = 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -30, 30))) - above
            dw = np.bincount(ids, error.sum(1)[row_of], minlength=HASHED) / len(rows)
            dt = -error.mean(0)
            gw += dw * dw
            gt += dt * dt
            step = rate / np.sqrt(gw)
            moved = self.w - step * dw
            self.w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0.0)
            self.thresholds = np.maximum.accumulate(self.thresholds - rate * dt / np.sqrt(gt))
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model of at most `sample_rows` labelled documents, whose feature ids come to the driver."""
    sample = labelled_sample(docs, labels, label, sample_rows)
    table = featurise(sample, ["doc_id", "label"], _ids).toArrow().sort_by([("doc_id", "ascending")])
    rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) for x in table.column("ids").combine_chunks()] if table.num_rows else []
    toxic = np.array(table.column("label").to_pylist(), int)
    return OrdinalModel().fit(rows, grades(rows, toxic))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity (0 to 3), severity (the likeliest grade) and toxic (P(severity > 0) >= 0.5), one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("severity", pa.int32()), ("toxic", pa.bool_())])

    def run(part):
        exceed = shared.value.exceed([stem_ids(t, HASHED) for t in part.column("text").to_pylist()])
        edges = np.concatenate([np.ones((len(exceed), 1)), exceed, np.zeros((len(exceed), 1))], 1)
        return {"doc_id": part.column("doc_id"), "expected_severity": exceed.sum(1), "severity": np.argmax(edges[:, :-1] - edges[:, 1:], 1).astype(np.int32), "toxic": exceed[:, 0] >= 0.5}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(arrow_rows(run, schema), "doc_id long, expected_severity double, severity int, toxic boolean")
