"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and the groups that its links make.

Two sets link when 100 * |A and B| >= percent * |A or B|. A pair is found by the scheme of its smaller set:

* Small sets: all subsets that lack at most d(n) = (100 - percent) * n / 100 elements are enumerated. The common part of a
  linking pair is such a subset of both.
* Large sets: the hash space is cut into more parts than a linking pair of the size class can differ in, so the pair
  agrees on a whole part; inverted lists hold, for each part's content, the sets that have it. Lists of single shingles would
  serve as well, but a passage that a third of all documents share would make lists of that length.

The boundary is the largest size at which enumerating costs no more than list entries, of which each counts LIST_COST
subsets. Candidates pass a test of sizes and of parity bitmaps, whose distance never exceeds that of the sets, and are then
verified on the shingles themselves. Groups, not pairs, are the result: a few rounds test the members of a list against one
member of another group, and only lists that still span more than one group test all pairs across groups. No pair that may
link is left out.

Rows with a null doc_id get no group; texts without words have the empty set and link with nothing; exact copies of a set
within a task link at once and send no entries.
"""

from __future__ import annotations

import bisect
import functools
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from ..session import TEXT_ROWS, materialize
from .components import connected_components, grown
from .stored import discard
from .words import mix, shingles, text_slices

LIST_COST = 4
MOST_COPIES = 300_000
TRIPLES_FROM = 1000
WIDE_FROM = 800
WIDE = 4096
ROUNDS = 3
SHARES = 8
KEPT_BITS = 48
BITMAP = 1024
BITS = [f"bits{i}" for i in range(BITMAP // 64)]
SIGNATURES = [f"signatures{i}" for i in range(SHARES)]


class Scheme:
    """Signatures of a set: equal signatures make candidates."""

    def __init__(self, percent: int):
        self.percent = percent
        n = 1
        while self.n_subsets(n + 1) <= LIST_COST * self._parts((n + 1) * 5 // 4 + 1):
            n += 1
        self.boundary = n
        self.starts = [n + 1]
        self.classes: dict[int, tuple] = {}

    def missing(self, n: int) -> int:
        """Elements of a set of n that a linking set may lack."""
        return (100 - self.percent) * n // 100

    def n_subsets(self, n: int) -> int:
        return sum(comb(n, j) for j in range(self.missing(n) + 1))

    def _differ(self, high: int) -> int:
        """Most elements in which two linking sets differ if the smaller one has under `high`."""
        return (100 - self.percent) * (high - 1) // self.percent

    def _parts(self, high: int) -> int:
        return -(-(self._differ(high) + 1) * 21 // 20) + 2

    def size_class(self, n: int) -> int:
        """0 for small sets; a class spans a quarter of its least size, so that its parts hold about as much for all its sets."""
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 5 // 4 + 1)
        return bisect.bisect_right(self.starts, n)

    def _class(self, c: int):
        """Most differing elements, number of parts, their bounds, their salts, and whether parts are used by twos.

        In large sets every three parts make a triple: some triple holds one difference at most, so two of its parts agree,
        and an entry stands for two parts. Entries are then more and less likely to meet by chance.
        """
        if c not in self.classes:
            self.size_class(self.starts[c - 1])
            high = self.starts[c]
            differ, twos = self._differ(high), high > TRIPLES_FROM
            m = 3 * (-(-(differ + 1) * 21 // 40) + 1) if twos else self._parts(high)
            bounds = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
            self.classes[c] = differ, m, bounds, mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 32)), twos
        return self.classes[c]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """s: sorted distinct hashes. Of KEPT_BITS bits, in order, as int64: what is equal stays equal, and the few that fall
        together by chance only make candidates more."""
        n = len(s)
        if not n:
            return np.empty(0, np.int64)
        g = mix(s ^ np.uint64(0x5851F42D4C957F2D))
        smallest = -(-self.percent * n // 100)
        out = []
        for c in range(self.size_class(smallest), self.size_class(n) + 1):
            if c == 0:
                total = int(g.sum())
                sums = [total - sum(gone) for j in range(self.missing(n) + 1) for gone in combinations(g.tolist(), j)]
                out.append(mix(np.array([x & 0xFFFFFFFFFFFFFFFF for x in sums], np.uint64)))
            else:
                differ, m, bounds, salt, twos = self._class(c)
                at = np.concatenate([[0], np.searchsorted(s, bounds), [n]])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g)])
                content = mix(sums[at[1:]] - sums[at[:-1]] + salt)
                full = at[1:] > at[:-1]
                if twos:
                    x, y = content.reshape(-1, 3), full.reshape(-1, 3)
                    content = np.concatenate([mix(x[:, i] + mix(x[:, j])) for i, j in ((0, 1), (0, 2), (1, 2))])
                    full = np.concatenate([y[:, i] | y[:, j] for i, j in ((0, 1), (0, 2), (1, 2))])
                    # a triple with an entry of two empty parts may agree on that alone
                    enough = 2 * int((y.sum(1) >= 2).sum()) > differ
                else:
                    enough = int(full.sum()) > differ
                # empty parts say little; they are needed only where so many are empty that they may be all a pair agrees on
                out.append(content[full] if enough else content)
        return np.unique(np.concatenate(out) >> np.uint64(64 - KEPT_BITS)).view(np.int64)


@functools.cache
def scheme(percent: int) -> Scheme:
    return Scheme(percent)


def _bitmap(s: np.ndarray, size: int = BITMAP) -> np.ndarray:
    """Parities: bit i tells whether an odd number of elements falls on i. `size` is a power of two."""
    odd = np.bincount((mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(percent: int):
    """Holds for every pair (columns of x_ and y_) that links: two sets of n and m elements that link differ in at most
    (n + m) * (100 - percent) / (100 + percent), and their bitmaps in no more."""
    n, m = F.col("x_n"), F.col("y_n")
    distance = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in BITS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (distance * (100 + percent) <= (n + m) * (100 - percent))


def signature_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, same (an earlier document of the task with the same set, or null), the parity bitmap and the
    signatures, by their highest bits in SHARES columns, written once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.int64()), *[(b, pa.int64()) for b in BITS], ("wide", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in SIGNATURES]])
    cuts = np.array([(i << KEPT_BITS) // SHARES for i in range(1, SHARES)], np.int64)

    def dealt(found: list[np.ndarray]) -> list[pa.Array]:
        """A column per share of the range; the signatures of a set are in order."""
        ends = [[0, *np.searchsorted(f, cuts).tolist(), len(f)] for f in found]
        return [pa.array([f[e[i]:e[i + 1]] for f, e in zip(found, ends)], pa.list_(pa.int64())) for i in range(SHARES)]

    def run(batches):
        seen: dict[tuple, int] = {}
        rule, none = scheme(percent), np.empty(0, np.int64)
        for part in text_slices(batches):
            ids, sizes, same, found, bits, wide = part.column("doc_id").to_pylist(), [], [], [], [], []
            for doc_id, text in zip(ids, part.column("text").to_pylist()):
                s = shingles(text, words)
                sizes.append(len(s))
                bits.append(_bitmap(s))
                wide.append(_bitmap(s, WIDE) if len(s) >= WIDE_FROM else None)
                if doc_id is None or not len(s):
                    same.append(None)
                    found.append(none)
                    continue
                key = (len(s), int(s.sum()), int(mix(s).sum()))
                first = seen.get(key)
                same.append(first)
                found.append(none if first is not None else rule.signatures(s))
                if first is None:
                    if len(seen) >= MOST_COPIES:
                        seen.clear()
                    seen[key] = doc_id
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(same, pa.int64()), *[pa.array(b, pa.int64()) for b in np.array(bits).T],
                                              pa.array(wide, pa.list_(pa.int64())), *dealt(found)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, f"doc_id long, n_shingles long, same long, {', '.join(f'{b} long' for b in BITS)}, wide array<long>, {', '.join(f'{c} array<long>' for c in SIGNATURES)}"), "jaccard-signatures", TEXT_ROWS)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("members", pa.binary())])

    def run(batches):
        for part in text_slices(batches):
            sets = [shingles(t, words).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], schema=schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, members binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 0
                if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))
    one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to, itself included), one row per row."""
    table = signature_table(docs, words, percent)
    # one share of the signatures after the other is dealt out, so that no more than a share of them lies in shuffle files
    shares = [_written(_shared(table.select("doc_id", F.explode(c).alias("signature"))), "jaccard-share") for c in SIGNATURES]
    lists = _written(functools.reduce(DataFrame.unionByName, shares).groupBy("signature", "doc_id").agg(F.sum("weight").alias("weight")), "jaccard-lists")
    members = lists.select("doc_id").distinct()
    facts = _written(table.join(members, "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "wide", *BITS), "jaccard-facts")
    signed, table = table, _written(table.select("doc_id", "n_shingles", "same"), "jaccard-sizes")
    discard(signed)                                     # the signatures are the bulk of all that is written
    for share in shares:
        discard(share)

    # groups by the bitmaps alone say whose shingles are needed: two documents that link are in one such group or meet across two
    likely = _written(stars(lists, None, facts, percent, 0), "jaccard-likely")
    guess = _written(connected_components(likely), "jaccard-guess")
    for turn in range(1, ROUNDS):
        more = _written(stars(lists, guess, facts, percent, turn), "jaccard-likely")
        if more.isEmpty():
            break
        likely = likely.unionByName(more)
        old, guess = guess, _written(grown(guess, more), "jaccard-guess")
        discard(old)
    across = crossing(lists, guess, facts, percent)
    discard(guess)
    pairs = likely.unionByName(across)
    needed = _written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "jaccard-needed")
    # a doc_id with several texts has several sets; each may link. Kept by doc_id, the sets are dealt out once for all rounds
    mine = docs.join(needed, docs["doc_id"].cast("long") == needed["doc_id"], "left_semi")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(shingle_sets(mine, words), "jaccard-sets", TEXT_ROWS, broadcasts=False)
    sets = stored.repartition(n_parts, "doc_id").persist(StorageLevel.DISK_ONLY)

    links = _written(verified(pairs.distinct(), sets, percent), "jaccard-links")
    parts = _written(connected_components(links), "jaccard-parts")
    for turn in range(1, ROUNDS):
        found = _written(verified(stars(lists, parts, facts, percent, turn), sets, percent), "jaccard-links")
        if found.isEmpty():
            break
        parts = _written(grown(parts, found), "jaccard-parts")
    late = crossing(lists, parts, facts, percent)
    rest = _written(verified(late.join(across, ["a", "b"], "left_anti"), sets, percent), "jaccard-links")
    sets.unpersist()
    for done in (stored, lists, facts, across, late, needed):
        discard(done)
    copies = table.filter(F.col("same").isNotNull()).select(F.col("same").alias("a"), F.col("doc_id").alias("b"))
    final = grown(parts, rest.unionByName(copies))
    joined = table.join(final, table["doc_id"] == final["node"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _written(frame: DataFrame, label: str) -> DataFrame:
    return materialize(frame, label, broadcasts=False)


def _shared(entries: DataFrame) -> DataFrame:
    """signature, doc_id and weight of the lists of several documents. Lists of the same documents are one list from here on,
    with a weight; should two others fall together, they only grow."""
    own = Window.partitionBy("signature")
    ends = [F.min("doc_id").over(own).alias("low"), F.max("doc_id").over(own).alias("high"), F.bit_xor(F.xxhash64("doc_id")).over(own).alias("mark")]
    shared = entries.select("doc_id", *ends).filter("low < high")
    return shared.groupBy(F.xxhash64("low", "high", "mark").alias("signature"), "doc_id").agg(F.count(F.lit(1)).alias("weight"))


def stars(lists: DataFrame, parts: DataFrame | None, facts: DataFrame, percent: int, turn: int) -> DataFrame:
    """The star pairs (a, b) of the lists that may link."""
    pairs = star_pairs(spanning(lists, parts), turn)
    near = pairs.join(_facts_of(facts, "x", "a"), "a").join(_facts_of(facts, "y", "b"), "b").filter(may_link(percent)).select("a", "b")
    return wide_test(near.distinct(), facts, percent)


def crossing(lists: DataFrame, parts: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of one list and of two groups that may link, written."""
    open_lists = _written(merged(spanning(lists, parts)), "jaccard-open")
    sides = open_lists.withColumnRenamed("doc_id", "a")
    one = sides.join(_facts_of(facts, "x", "a"), "a").withColumnRenamed("part", "part_a")
    two = sides.withColumnRenamed("a", "b").join(_facts_of(facts, "y", "b"), "b").withColumnRenamed("part", "part_b")
    test = (one["signature"] == two["signature"]) & (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & may_link(percent)
    near = _written(wide_test(one.join(two, test).select("a", "b").distinct(), facts, percent), "jaccard-across")
    discard(open_lists)
    return near


def merged(named: DataFrame) -> DataFrame:
    """signature, doc_id and part of fewer lists in which all documents meet that met before. Near texts share hundreds of lists, and
    each would name their pair again; lists with the same hub become one where that makes no more pairs than they make alone."""
    own = Window.partitionBy("signature")
    hub = F.min(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("hub"))).over(own)["hub"]
    hubbed = _written(named.select("signature", "doc_id", "part", hub.alias("hub"), F.count(F.lit(1)).over(own).alias("size")), "jaccard-hubs")
    once = hubbed.groupBy("hub", "doc_id", "part").agg(F.sum("size").alias("tests"))
    # a list of n documents makes n * n tests: each of its rows brings n
    paying = _written(once.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("tests").alias("tests")).filter("n * n <= tests").select("hub"), "jaccard-paying")
    together = once.join(paying, "hub", "left_semi").select(F.xxhash64("hub", F.lit("hub")).alias("signature"), "doc_id", "part")
    alone = hubbed.join(paying, "hub", "left_anti").select("signature", "doc_id", "part")
    found = _written(together.unionByName(alone), "jaccard-merged")
    discard(hubbed)
    return found


def wide_test(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wider bitmaps, where both sets are large, do not rule a link out."""
    wide = facts.filter(F.col("wide").isNotNull())
    x, y = wide.select(F.col("doc_id").alias("a"), F.col("n").alias("x_n"), F.col("wide").alias("x")), wide.select(F.col("doc_id").alias("b"), F.col("n").alias("y_n"), F.col("wide").alias("y"))
    distance = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    may = distance * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent)
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce(may, F.lit(True))).select("a", "b").distinct()


def _facts_of(facts: DataFrame, side: str, key: str) -> DataFrame:
    return facts.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *BITS)])


def spanning(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
    """signature, doc_id and part (the group so far) of the lists that span more than one group."""
    if parts is None:
        return lists.withColumn("part", F.col("doc_id"))
    named = lists.join(parts, lists["doc_id"] == parts["node"], "left").select("signature", "doc_id", "weight", F.coalesce("component", "doc_id").alias("part"))
    own = Window.partitionBy("signature")
    return named.select("*", F.min("part").over(own).alias("low"), F.max("part").over(own).alias("high")).filter("low < high").drop("low", "high")


def star_pairs(named: DataFrame, turn: int) -> DataFrame:
    """Pairs of a document and the hub of one of its lists, another hub each turn. Of all its hubs a document takes the one it
    shares most lists with: one in turn 0, later one of each group that is not its own."""
    hub = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id").alias("hub"), F.col("part").alias("hub_part"))).over(Window.partitionBy("signature"))
    met = named.withColumn("s", hub).filter("part != s.hub_part").groupBy("doc_id", F.col("s.hub").alias("hub"), F.col("s.hub_part").alias("hub_part")).agg(F.sum("weight").alias("count"))
    best = met.groupBy("doc_id", *(["hub_part"] if turn else [])).agg(F.max(F.struct("count", "hub")).alias("s"))
    return best.select(F.least("doc_id", "s.hub").alias("a"), F.greatest("doc_id", "s.hub").alias("b")).distinct()
