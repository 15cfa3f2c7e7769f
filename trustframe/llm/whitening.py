"""Embedding whitening: FEAST contour integration over the covariance.

Vectors become whole numbers x = floor(scale * c) + shift. Their exact sums, and then the covariance of the centred
numbers (divisor: the rows), are added up in Spark; only dimension-sized rows reach the driver. The largest eigenvalues
are cut into intervals at gaps of the spectrum that inertia counts find. For each interval a quadrature over a circle
adds up shifted solves (z I - V)^-1 Y, one Spark task per interval and node, which projects a random block onto the
interval's eigenvectors; Rayleigh-Ritz extracts them, and the block is projected again until the residuals are at rounding
level. The pairs found in an interval must be as many as its inertia counts say: if any is missing the block grows, up to
the whole space. One last Rayleigh-Ritz over all intervals makes the components orthogonal.

Vectors that are null, empty or hold null or non-finite entries take no part, nor do entries of 2^41 or more (x would not be
exact), nor vectors of another dimension than the most frequent one (ties: the higher). Repeated rows and ids count as often as
they occur; ids may be null. An empty table gives no rows. A component without variance (below the rounding of the
trace) has no whitened value (null) and explains 0. `deviation` is null where it does not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import local_frame, materialize

NODES = 12
LARGEST = 2.0 ** 41
#: Ritz residuals and eigenvalues below this share of the norm are rounding.
ROUNDING = 1e-13
#: The spectrum is searched for gaps down to this share of the eigenvalues beside them.
GAP = 1e-4


@dataclass(frozen=True)
class Whitening:
    """n, per-dimension sums S, eigenvalues (falling), components (a column each), trace, and the whole-number map."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    shift: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 and w else 0.0 for v, w in zip(self.values, self.varies)]

    @property
    def varies(self) -> np.ndarray:
        return self.values > ROUNDING * max(self.trace, np.finfo(float).tiny)


def usable(vector: Column) -> Column:
    """Whether a vector takes part, its dimension apart."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < LARGEST)), F.lit(False))


def whole_numbers(vectors: pa.Array, scale: float, shift: int) -> np.ndarray:
    """Rows of x, as longs."""
    lists = vectors.cast(pa.list_(pa.float64()))
    return np.floor(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) * scale).astype(np.int64) + shift


def _vectors(frame: DataFrame, vector: str, *more: Column) -> DataFrame:
    """The usable vectors as `vec`, after `more`."""
    return frame.select(*more, F.col(f"`{vector}`").cast("array<double>").alias("vec")).filter(usable(F.col("vec")))


def _dimension(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _row_sums(rows: DataFrame, partial, kind: str = "double") -> np.ndarray:
    """Sum over all partitions of the matrix that `partial` makes of each batch of vectors, whose size the dimension alone
    decides. Entries (`kind`: double or long) are added up in Spark one by one."""
    arrow = pa.list_(pa.float64() if kind == "double" else pa.int64())

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "entries": pa.array(list(total), arrow)})

    parts = rows.select("vec").mapInArrow(run, f"i int, entries array<{kind}>")
    summed = parts.select("i", F.posexplode("entries").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    lines = summed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    got = {r["i"]: [x["v"] for x in r["row"]] for r in lines.collect()}
    return np.array([got[i] for i in sorted(got)])


def fit(frame: DataFrame, vector: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none."""
    rows = _vectors(frame, vector)
    d = _dimension(rows)
    if not d:
        return None
    rows = rows.filter(F.size("vec") == d)

    def halves(vectors):                        # high and low bits apart, so that sums of 2^36 rows fit
        x = whole_numbers(vectors, scale, shift)
        return np.stack([(x >> 26).sum(axis=0), (x & (2 ** 26 - 1)).sum(axis=0), np.full(d, len(x))])

    high, low, counts = _row_sums(rows, halves, "long")
    n, sums = int(counts[0]), [(int(h) << 26) + int(x) for h, x in zip(high, low)]
    mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def products(vectors):
        centred = (whole_numbers(vectors, scale, shift) - mean) - rest
        return centred.T @ centred

    covariance = _row_sums(rows, products) / n
    covariance = (covariance + covariance.T) / 2
    values, basis = largest_eigenpairs(frame.sparkSession, covariance, components)
    return Whitening(n, sums, values, basis, float(np.trace(covariance)), scale, shift)


# Eigenpairs ------------------------------------------------------------------------------------------------------

def inertia(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the signs of its block-diagonal factorisation with
    pivots of order one, or of order two where an off-diagonal entry leads (one positive and one negative sign)."""
    a, positive = matrix.copy(), 0
    while len(a):
        size = np.abs(a)
        diagonal = int(np.argmax(size.diagonal()))
        top = size[diagonal, diagonal]
        i, j = divmod(int(np.argmax(size)), len(a))
        if size[i, j] == 0.0:
            break
        picked = [diagonal] if top >= 0.64 * size[i, j] else [i, j]
        left = np.setdiff1d(np.arange(len(a)), picked)
        block = a[np.ix_(picked, picked)]
        positive += 1 if len(picked) == 2 else int(block[0, 0] > 0)
        side = a[np.ix_(left, picked)]
        a = a[np.ix_(left, left)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def _spark_map(spark: SparkSession, tasks: pd.DataFrame, schema: str, result: str, fn) -> list:
    """`fn` of each row of a small frame, a task each."""
    frame = local_frame(spark, list(tasks.itertuples(index=False, name=None)), schema)

    def run(frames):
        for part in frames:
            if len(part):
                yield pd.concat([fn(row) for row in part.itertuples(index=False)], ignore_index=True)
    return frame.mapInPandas(run, result).collect()


def counts_above(spark: SparkSession, matrix: np.ndarray, shifts: list[float]) -> list[int]:
    """For each shift the number of eigenvalues above it, by inertia."""
    eye = np.eye(len(matrix))
    tasks = pd.DataFrame({"k": range(len(shifts)), "shift": shifts})
    found = _spark_map(spark, tasks, "k int, shift double", "k int, above long",
                       lambda r: pd.DataFrame({"k": [r.k], "above": [inertia(matrix - r.shift * eye)]}))
    above = {r["k"]: r["above"] for r in found}
    return [above[k] for k in range(len(shifts))]


def intervals(spark: SparkSession, matrix: np.ndarray, wanted: int, most: int = 4, parts: int = 8, rounds: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down, of disjoint intervals that hold the `wanted` largest or more.

    Stretches that hold several of the leading eigenvalues are divided until they hold one or are narrower than a gap. An
    interval takes up to `most` eigenvalues (more where no gap parts them) and ends in the middle of the stretch without
    eigenvalues that is widest against the interval.
    """
    d, norm = len(matrix), float(np.linalg.norm(matrix))
    points = {-norm * 1.01: d, norm * 1.01: 0}
    for _ in range(rounds):
        line = sorted(points)
        split = [(a, b) for a, b in zip(line, line[1:])
                 if points[a] - points[b] > 1 and points[b] < wanted + most and b > ROUNDING * norm and b - a > GAP * max(abs(a), b)]
        shifts = [float(a + (b - a) * k / parts) for a, b in split for k in range(1, parts)]
        if not shifts:
            break
        points.update(zip(shifts, counts_above(spark, matrix, shifts)))
    gaps = {}
    for s, above in points.items():
        low, high = gaps.get(above, (s, s))
        gaps[above] = (min(low, s), max(high, s))
    cuts = sorted((above, low, high) for above, (low, high) in gaps.items() if high - low > GAP / parts * max(abs(low), abs(high)) or above in (0, d))
    out, done, top = [], 0, norm * 1.01
    while done < wanted:
        below = [c for c in cuts if c[0] > done]
        within = [c for c in below if c[0] <= done + most] or below[:1]
        above, low, high = max(within, key=lambda c: (c[2] - c[1]) / (top - (c[1] + c[2]) / 2))
        out.append(((low + high) / 2, top, above - done))
        done, top = above, (low + high) / 2
    return out


def largest_eigenpairs(spark: SparkSession, matrix: np.ndarray, wanted: int, nodes: int = NODES, most_rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix (falling) and their eigenvectors, by contour integration."""
    d, norm = len(matrix), float(np.linalg.norm(matrix))
    wanted = min(wanted, d)
    if norm == 0.0:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    slices = intervals(spark, matrix, wanted)
    rng = np.random.default_rng(0)
    blocks = [rng.standard_normal((d, min(d, 2 * count + 2))) for _, _, count in slices]
    found: list[np.ndarray | None] = [None] * len(slices)
    for lap in range(1, most_rounds + 1):
        open_ = [k for k, v in enumerate(found) if v is None]
        if not open_:
            break
        for k, block in _projected(spark, matrix, {k: (slices[k][0], slices[k][1], blocks[k]) for k in open_}, nodes).items():
            low, high, count = slices[k]
            basis = np.linalg.qr(block)[0]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            ritz = basis @ turn
            error = np.linalg.norm(matrix @ ritz - ritz * values, axis=0)
            inside = (values > low) & (values <= high)
            settled = error[inside] <= ROUNDING * norm * np.sqrt(d)
            if inside.sum() == count and settled.all():
                found[k] = ritz[:, inside]
            else:                                       # some are missing, or close neighbours slow it down: a wider block
                wider = min(d, 2 * block.shape[1]) if lap % 3 == 0 or settled.all() else block.shape[1]
                blocks[k] = np.hstack([ritz, rng.standard_normal((d, wider - block.shape[1]))])
    if any(v is None for v in found):
        raise RuntimeError("the contour integrals did not settle")
    basis = np.linalg.qr(np.hstack(found))[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:wanted]
    return values[order], (basis @ turn)[:, order]


def _projected(spark: SparkSession, matrix: np.ndarray, work: dict[int, tuple[float, float, np.ndarray]], nodes: int) -> dict[int, np.ndarray]:
    """Each block projected onto the eigenvectors of its interval: the mean of r e^(it) (z I - V)^-1 Y over the upper half of the
    circle through the interval's ends (the lower half is its conjugate)."""
    d, eye = len(matrix), np.eye(len(matrix))
    angles = np.pi * (np.arange(nodes) + 0.5) / nodes

    def solve(row):
        low, high, block = work[row.k]
        turn = (high - low) / 2 * np.exp(1j * row.angle)
        part = (turn * np.linalg.solve(((low + high) / 2 + turn) * eye - matrix, block.astype(complex))).real / nodes
        return pd.DataFrame({"k": [row.k], "angle": [row.angle], "part": [part.tobytes()]})

    tasks = pd.DataFrame([(k, float(a)) for k in work for a in angles], columns=["k", "angle"])
    rows = _spark_map(spark, tasks, "k int, angle double", "k int, angle double, part binary", solve)
    out = {k: np.zeros((d, b.shape[1])) for k, (_, _, b) in work.items()}
    for r in sorted(rows, key=lambda r: r["angle"]):
        out[r["k"]] += np.frombuffer(r["part"]).reshape(d, -1)
    return out


# Application -----------------------------------------------------------------------------------------------------

def _squares(away: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """The exact sum of (n * away - rest)^2 of each row; None from 2^63."""
    about = ((away - rest / n) ** 2).sum(axis=1) * float(n) ** 2
    small = away[about < 2.0 ** 62] * n - rest
    out = np.full(len(away), None, object)
    out[about < 2.0 ** 62] = (small * small).sum(axis=1)
    for k in np.flatnonzero((about >= 2.0 ** 62) & (about < 2.0 ** 64)):
        exact = sum((int(a) * n - int(r)) ** 2 for a, r in zip(away[k], rest))
        out[k] = exact if exact < 2 ** 63 else None
    return [None if v is None else int(v) for v in out]


def whiten(frame: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Per usable vector: doc (struct of the columns in `keep`, all but the vector unless given), deviation and whitened (a
    value per component)."""
    kept = [c for c in frame.columns if c != vector] if keep is None else keep
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    n, d, scale, shift = model.n, len(model.sums), model.scale, model.shift
    rows = _vectors(frame, vector, doc.alias("doc")).filter(F.size("vec") == d)
    mean = np.array([s // n for s in model.sums], np.int64)
    rest = np.array([s % n for s in model.sums], np.int64)
    turn = model.components * np.where(model.varies, 1 / np.sqrt(np.where(model.varies, model.values, 1.0)), np.nan)

    def run(batches):
        for batch in batches:
            away = whole_numbers(batch.column(1), scale, shift) - mean
            white = (away - rest / n) @ turn
            deviation = pa.array(_squares(away, rest, n), pa.int64())
            lists = pa.array([[None if v != v else v for v in w] for w in white.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["doc", "deviation", "whitened"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened values' covariance less the identity, over components with variance."""
    live = np.flatnonzero(model.varies)
    if not len(live):
        return None
    rows = whitened.select(F.array(*[F.col("whitened")[int(k)] for k in live]).alias("vec"))

    def matrix(vectors):
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)

    mean = _row_sums(rows, lambda v: matrix(v).sum(axis=0, keepdims=True))[0] / model.n

    def products(vectors):
        centred = matrix(vectors) - mean
        return centred.T @ centred
    return float(np.abs(_row_sums(rows, products) / model.n - np.eye(len(live))).max())


def report(frame: DataFrame, vector: str = "embedding", components: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Per usable vector and component, from 1: doc, component, n, deviation, whitened, explained, identity_error."""
    model = fit(frame, vector, components)
    if model is None:
        empty = whiten(frame, Whitening(1, [0], np.ones(1), np.ones((1, 1)), 1.0, 1.0, 0), vector, keep).filter(F.lit(False))
        model, rows, error = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 1.0, 0), empty, None
    else:
        rows = materialize(whiten(frame, model, vector, keep), "whitened")
        error = identity_error(rows, model)
    share = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    each = rows.select("doc", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("doc", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
