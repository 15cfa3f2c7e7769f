"""Regions read from rows of bits, against a plain reading of the cells."""

import random

from pyspark.sql import functions as F

from trustframe.functions import fixed_values as V
from trustframe.operators import grid as G, regions as R

from test_bands import fold_rows

N = None


def plain_regions(cells, gap=V.MIN_GAP_ROWS):
    """cells: (row, col, text or None), repeats counted -> the rows of `regions` for one sheet."""
    used = sorted({c for _, c, _ in cells})
    pieces, of = [], {}
    for c in used:
        if not pieces or c > pieces[-1][1] + 1:
            pieces.append([c, c])
        pieces[-1][1] = c
        of[c] = len(pieces)
    rows = {}
    for r, c, _ in cells:
        rows.setdefault(r, set()).add(of[c])
    bands = fold_rows(list(rows.values()), len(pieces))
    out = []
    for band in sorted(set(bands)):
        mine = [(r, c, t) for r, c, t in cells if bands[of[c] - 1] == band]
        at = sorted({r for r, _, _ in mine})
        stretches = [[at[0]]]
        for r in at[1:]:
            if r - stretches[-1][-1] - 1 >= gap:
                stretches.append([])
            stretches[-1].append(r)

        def header(r, width):
            here = [t for q, _, t in mine if q == r]
            texts = [t.strip().lower() for t in here if t is not None]
            return len(here) >= max(1.0, 0.6 * width) and len(texts) >= 0.8 * len(here) and len(set(texts)) >= 0.5 * len(texts)

        blocks = []
        for s in stretches:
            width = len({c for r, c, _ in mine if s[0] <= r <= s[-1]})
            if not blocks or header(s[0], width):
                blocks.append([])
            blocks[-1] += s
        for b in blocks:
            inside = [(r, c) for r, c, _ in mine if b[0] <= r <= b[-1]]
            cols, top = {c for _, c in inside}, range(b[0], b[0] + V.HEADER_SCAN_ROWS)
            heads = [r for r in b if r in top and header(r, len(cols)) and r + 1 in b]
            kind = "table" if b[0] < b[-1] and len(cols) >= 2 else "note"
            out.append((kind, b[0], min(cols), b[-1], max(cols), heads[0] if heads else N, len(inside)))
    return sorted(out, key=lambda x: (x[1], x[2]))


def frame(spark, sheets):
    rows = [("s", name, r, c, "num" if t is None else "text", 1.0 if t is None else N, t, N, N) for name, cells in sheets.items() for r, c, t in cells]
    return spark.createDataFrame(rows, G.CELL)


def check(spark, sheets, gap=V.MIN_GAP_ROWS):
    got = {}
    for r in R.regions(frame(spark, sheets), gap).orderBy("region_no").collect():
        got.setdefault(r.sheet, []).append((r.kind, r.first_row, r.first_col, r.last_row, r.last_col, r.header_row, r.cells))
    for name, cells in sheets.items():
        assert got[name] == plain_regions(cells, gap), name


def random_sheet(rng):
    """Tables over and beside each other, across words of columns and spans of rows, with gaps, texts and repeated cells."""
    cells, col = [], rng.choice([1, 55, 120])
    for _ in range(rng.randint(1, 3)):
        row, width = rng.choice([1, 50, 62, 120]), rng.choice([2, 3, 9, 14])
        for _ in range(rng.randint(1, 4)):
            texts = rng.random() < 0.7
            for r in range(row, row + rng.randint(1, 9)):
                for c in range(col, col + width):
                    if rng.random() < 0.93:
                        text = rng.choice([f"h{c}", f" H{c} ", "same"]) if (texts and r == row) or rng.random() < 0.1 else N
                        cells += [(r, c, text)] * (1 if rng.random() < 0.9 else rng.randint(2, 4))
            row = r + rng.choice([1, 2, 3, 4, 70])
        col += width + rng.choice([1, 1, 2, 60])
    return cells or [(1, 1, N)]


def test_random_sheets_against_a_plain_reading(spark):
    rng = random.Random(12)
    check(spark, {f"t{i}": random_sheet(rng) for i in range(60)})
    check(spark, {f"t{i}": random_sheet(rng) for i in range(20)}, 65)


def test_cells_that_stand_often_are_counted_by_band(spark, monkeypatch):
    monkeypatch.setattr(R, "FEW", 1)                             # blocks meet rows in buckets
    cells = [(1, 1, "a"), (1, 2, "b"), (2, 1, N), (2, 2, N), (1, 5, "x"), (1, 6, "y"), (9, 1, "c"), (9, 2, "d"), (10, 1, N), (10, 2, N), (20, 1, "e"), (20, 2, "f"), (21, 1, N)]
    check(spark, {"few": cells + [(2, 2, N)] * 3, "many": cells + [(2, 2, N)] * 300 + [(1, 6, "y")] * 2, "one": cells})


def test_a_large_sheet_keeps_a_row_for_many_cells(spark, monkeypatch):
    """Every third row starts a stretch; none but the first may be a header, so no other one is stored, nor met with the cells."""
    kept, stored = {}, R.materialize

    def noted(df, label):
        return kept.setdefault(label, stored(df, label))

    monkeypatch.setattr(R, "materialize", noted)
    rows = spark.range(3000).select((F.col("id") * 3 + 1).cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("col"))
    text = (F.col("row") == 1) | (F.col("col") == 6)
    cells = rows.select(F.lit("s").alias("source_id"), F.lit("t").alias("sheet"), "row", "col", F.when(text, "text").otherwise("num").alias("kind"), F.lit(1.0).alias("num"),
                        F.when(text, F.concat(F.lit("h"), "col")).alias("txt"), F.lit(N).cast("string").alias("format"), F.lit(N).cast("string").alias("formula"))
    got = R.regions(cells).collect()
    assert [(r.first_row, r.last_row, r.last_col, r.header_row, r.cells) for r in got] == [(1, 8998, 6, N, 18000)]
    assert kept["segments"].count() == 1 and kept["row-masks"].count() == 3000 and kept["row-spans"].count() == 141
