"""Nearest neighbours by inner product: a vantage-point tree per shard.

Vectors get one more component that lifts all of a shard to the same length, and queries a zero there; the largest inner
product is then the smallest Euclidean distance, for which the triangle inequality prunes. A subtree is left out if its
lower bound times `relax` exceeds the distance of the k-th best so far: 1 is exact, more is faster and may miss some.

Shards are dealt by a hash of the id, so copies of one vector spread. Trees are written once. Queries travel in blocks to
every shard; each pair of block and shard is one group of bounded size. Scores are sums in double precision over the original
components; ties go to the smaller id. Vectors that are null, empty or zero, or hold null or non-finite components, take no
part; nor do rows with a null id. Of several rows with one id the smallest vector counts. Vectors of different lengths never meet.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

SHARD_ROWS = 8192
QUERY_BLOCK = 20_000
LEAF = 1024
BATCH = 512
SLACK = 1e-9


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    one = rows.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(v).alias("v"))
    return one.select("id", "v", F.size("v").alias("dim"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


class Tree:
    """Nodes in arrays; leaves are runs of `order`. Children carry the range of distances to their parent's vantage point."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 11):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        self.top = float((self.x * self.x).sum(1).max()) if len(ids) else 0.0
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []      # (vantage, left, right, left low, left high, right low, right high) or (-1, start, end)
        self._lift = np.sqrt(np.maximum(self.top - (self.x * self.x).sum(1), 0.0))
        rng = np.random.default_rng(seed)
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][1 + side] = at
            own = self.order[start:end]
            node = [-1, start, end, 0.0, 0.0, 0.0, 0.0]
            if len(own) > leaf:
                vantage = int(own[rng.integers(len(own))])
                d = np.sqrt(((self.x[own] - self.x[vantage]) ** 2).sum(1) + (self._lift[own] - self._lift[vantage]) ** 2)
                near = d <= np.median(d)
                if not near.all():
                    self.order[start:end] = np.concatenate([own[near], own[~near]])
                    cut = start + int(near.sum())
                    node = [vantage, 0, 0, d[near].min(), d[near].max(), d[~near].min(), d[~near].max()]
                    waiting += [(start, cut, at, 0), (cut, end, at, 1)]
            self.nodes.append(node)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, top=self.top, order=self.order, nodes=np.array(self.nodes, float))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, got = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.ids, tree.x, tree.top, tree.order = got["ids"], got["x"], float(got["top"]), got["order"]
        tree.nodes = [[int(n[0]), int(n[1]), int(n[2]), *n[3:]] for n in got["nodes"]]
        return tree

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, relax: float = 1.0):
        """(query row, id, score) of the k best per query, the query's own id aside. Batches are searched one by one, so the
        running best that each leaf is merged into stays small."""
        if len(q) > BATCH:
            found = [self.search(ids[a:a + BATCH], q[a:a + BATCH], k, relax) for a in range(0, len(q), BATCH)]
            return np.concatenate([r + i * BATCH for i, (r, _, _) in enumerate(found)]), np.concatenate([x for _, x, _ in found]), np.concatenate([s for _, _, s in found])
        square = (q * q).sum(1)
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]      # query row, index of x, score
        kth = np.full(len(q), -np.inf)

        def radius(rows):
            return np.sqrt(np.maximum(square[rows] + self.top - 2 * kth[rows], 0.0))

        def take(rows, start, end):
            nonlocal best
            own = self.order[start:end]
            rough = q[rows] @ self.x[own].T
            least = kth[rows]
            if len(own) > k + 1:
                least = np.maximum(least, np.partition(rough, len(own) - k - 1, axis=1)[:, len(own) - k - 1])
            r, c = np.nonzero(rough >= (least - SLACK * (1 + np.abs(least)))[:, None])
            r, c = rows[r], own[c]
            other = self.ids[c] != ids[r]
            r, c = r[other], c[other]
            s = np.empty(len(r))
            for a in range(0, len(r), 65_536):
                s[a:a + 65_536] = (q[r[a:a + 65_536]] * self.x[c[a:a + 65_536]]).sum(1)
            r, c, s = np.concatenate([best[0], r]), np.concatenate([best[1], c]), np.concatenate([best[2], s])
            by = np.lexsort((self.ids[c], -s, r))
            r, c, s = r[by], c[by], s[by]
            first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, bool)
            rank = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
            keep = rank < k
            best = [r[keep], c[keep], s[keep]]
            full = rank == k - 1
            kth[r[full]] = s[full]

        def visit(at, rows):
            vantage, left, right, *edges = self.nodes[at]
            if vantage < 0:
                take(rows, left, right)
                return
            d = np.sqrt(np.maximum(square[rows] + self.top - 2 * (q[rows] @ self.x[vantage]), 0.0))
            near_left = d <= (edges[1] + edges[2]) / 2
            for flag in (near_left, ~near_left):
                if not flag.any():
                    continue
                for side in ((0, 1) if flag is near_left else (1, 0)):
                    low, high = edges[2 * side], edges[2 * side + 1]
                    bound = np.maximum(np.maximum(d[flag] - high, low - d[flag]), 0.0)
                    limit = radius(rows[flag])
                    open_ = rows[flag][bound * relax <= limit + SLACK * (1 + limit)]
                    if len(open_):
                        visit((left, right)[side], open_)
        if len(self.ids) and len(q):
            visit(0, np.arange(len(q)))
        return best[0], self.ids[best[1]], best[2]


def index(rows: DataFrame, shards: int) -> DataFrame:
    """dim, shard and tree (bytes) of the usable vectors, written once. A shard holds about SHARD_ROWS of them."""
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        tree = Tree(table.column("id").to_numpy(), _matrix(table.column("v"), dim))
        return pa.Table.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([tree.dump()], pa.binary())], schema=schema)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "vantage-trees")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score. Both inputs have vec_id and embedding."""
    rows, asked = usable(candidates), usable(queries)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_block))
    trees = index(rows, shards)
    sent = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", "block", "id", "v")
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(block: pa.Table, tree: pa.Table) -> pa.Table:
        if not block.num_rows or not tree.num_rows:
            return schema.empty_table()
        ids = block.column("id").to_numpy()
        row, found, score = Tree.load(tree.column("tree")[0].as_py()).search(ids, _matrix(block.column("v"), block.column("dim")[0].as_py()), k, relax)
        return pa.Table.from_arrays([pa.array(ids[row], pa.int64()), pa.array(found, pa.int64()), pa.array(score)], schema=schema)
    keys = ["dim", "shard", "block"]
    best = sent.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
