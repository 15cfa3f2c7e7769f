"""Several tables on one sheet: column bands, row blocks and what each region holds.

A sheet is read into one row of bits per sheet row, then these into one row of bits per 64 sheet rows, where gaps are found
in chunks and across their borders: even a sheet with a third of all rows is never sorted in one task. Bands are merged on
counts of neighbouring pieces, not on rows. Texts are read again only where the bits leave a header possible.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V
from ..session import materialize
from .grid import S, first_headers, header_like, row_shape

CHUNK = 1 << 16
SPAN = 1 << 10
#: Spans of one key that a row is compared with one by one; where there are more, rows and spans meet in buckets.
FEW = 16
#: Rows of possible headers up to which cells are sought by a list of rows.
FETCH = 1_000
#: Cells of a word up to which the uses of each column are counted in a byte.
MOST = 127


def previous_used(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows(keys, at) distinct -> with `prev`, the next smaller `at` of the same keys, by chunks of 65,536 positions."""
    chunked = rows.withColumn("_chunk", F.floor(F.col(at) / CHUNK))
    inside = chunked.withColumn("prev", F.lag(at).over(Window.partitionBy(*keys, "_chunk").orderBy(at)))
    ends = chunked.groupBy(*keys, "_chunk").agg(F.max(at).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    return inside.join(ends, [*keys, "_chunk"]).withColumn("prev", F.coalesce("prev", "_before")).drop("_chunk", "_before")


def runs(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, start, end): stretches of used positions; `gap` or more unused ones separate two stretches."""
    marked = previous_used(rows, keys, at)
    starts = marked.filter(F.col("prev").isNull() | (F.col(at) - F.col("prev") - 1 >= gap)).select(*keys, F.col(at).alias("start"), "prev")
    last = rows.groupBy(*keys).agg(F.max(at).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("start")
    return starts.join(last, keys).select(*keys, "start", F.coalesce(F.lead("prev").over(order), F.col("_last")).alias("end"))


def _bit(at: str) -> Column:
    """A position as one of the 64 bits of its word."""
    return F.expr(f"shiftleft(1L, CAST(pmod({at}, 64) AS INT))")


def _positions(bits: Column) -> Column:
    """The set bits of a word, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)


def row_shapes(rows: DataFrame) -> DataFrame:
    """(source_id, sheet, words, rows): how many rows use just these columns. Only the rows of sheets that are wider than a word are
    brought together."""
    wide = rows.groupBy(*S).agg(F.min("word").alias("lo"), F.max("word").alias("hi")).filter("lo < hi").select(*S)
    one = F.struct("word", "mask")
    narrow = rows.join(wide, S, "left_anti").select(*S, F.array(one).alias("words"))
    broad = rows.join(wide, S, "left_semi").groupBy(*S, "row").agg(F.array_sort(F.collect_list(one)).alias("words"))
    return narrow.unionByName(broad.drop("row")).groupBy(*S, "words").agg(F.count(F.lit(1)).alias("rows"))


def column_bands(shapes: DataFrame) -> DataFrame:
    """(source_id, sheet, band, lo, hi): columns between fully empty ones; row-aligned neighbours are one band."""
    words = shapes.select(*S, "words", "rows", F.explode("words").alias("w")).select(*S, "words", "rows", "w.word", "w.mask")
    used = words.groupBy(*S, "word").agg(F.bit_or("mask").alias("mask"))
    used = used.select(*S, F.explode(_positions(F.col("mask"))).alias("bit"), "word").select(*S, (F.col("word") * 64 + F.col("bit")).alias("col"))
    raw = runs(used, S, "col", 1).withColumn("piece", F.row_number().over(Window.partitionBy(*S).orderBy("start")))
    raw = materialize(raw, "column-runs")
    of_word = _column_words(raw, "piece", "start", "end")
    per_row = words.join(of_word, [*S, "word"]).filter(F.col("mask").bitwiseAND(F.col("within")) != 0).groupBy(*S, "words", "rows").agg(
        F.array_sort(F.collect_set("piece")).alias("pieces"))
    before = F.transform("pieces", lambda p, i: F.struct(p.alias("piece"), F.when(i > 0, F.get("pieces", i - 1)).otherwise(0).alias("before")))
    pairs = per_row.select(*S, "rows", F.explode(before).alias("p")).groupBy(*S, "p.piece", "p.before").agg(F.sum("rows").alias("rows"))
    bands = pairs.groupBy(*S).applyInPandas(fold_pieces, "source_id string, sheet string, piece int, band int")
    return raw.join(bands, [*S, "piece"]).groupBy(*S, "band").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))


def _column_words(groups: DataFrame, label: str, lo: str, hi: str) -> DataFrame:
    """(source_id, sheet, label, word, within): the columns of each group as bits."""
    columns = groups.select(*S, label, F.explode(F.sequence(lo, hi)).alias("col"))
    return columns.groupBy(*S, label, F.shiftright("col", 6).alias("word")).agg(F.bit_or(_bit("col")).alias("within"))


def fold_pieces(pairs: pd.DataFrame) -> pd.DataFrame:
    """Bands of one sheet from its (piece, before, rows): rows that use a piece and, as the nearest one to its left, `before` (0: none).

    Pieces are folded left to right: one joins the band so far when both use nearly the same rows. A row uses the band and
    the piece if its nearest piece to the left lies in the band, so these counts decide, whatever the number of rows: at most
    one for two pieces of a sheet.
    """
    first, band, used, out = 1, 1, 0, []
    for piece, here in pairs.sort_values("piece").groupby("piece"):
        both, rows = int(here["rows"][here["before"] >= first].sum()), int(here["rows"].sum())
        if out and (not both or both / (used + rows - both) < V.BAND_OVERLAP):
            first, band, used, both = piece, band + 1, 0, 0
        used += rows - both
        out.append((piece, band))
    return pd.DataFrame({"source_id": pairs["source_id"].iloc[0], "sheet": pairs["sheet"].iloc[0], "piece": [p for p, _ in out], "band": [b for _, b in out]})


def regions(cells: DataFrame, min_gap_rows: int = V.MIN_GAP_ROWS) -> DataFrame:
    """(source_id, sheet, region_no, kind, first_row, first_col, last_row, last_col, header_row, cells).

    A new block starts after at least two blank rows, and only if its first row looks like a header; otherwise the
    table continues. A block of one row or one column is a note. `cells` is read twice, for the rows of bits and where these leave a
    header possible: hand over a stored cell table, or one that is laid out as fast as it is read.
    """
    here = cells.filter("kind <> 'error' AND (kind <> 'text' OR trim(txt) <> '')")
    rows = materialize(row_masks(here.filter("col IS NOT NULL"), S), "row-masks")
    bands = materialize(column_bands(materialize(row_shapes(rows), "row-shapes")), "bands")
    keys = [*S, "band"]
    of_column = bands.select(*keys, F.explode(F.sequence("lo", "hi")).alias("col"))
    lines = _lines(rows, bands, here, of_column)
    spans = materialize(row_spans(lines, keys), "row-spans")
    extent = materialize(spans.groupBy(*keys).agg(F.min("first").alias("start"), F.max("last").alias("end")), "extents")
    starts = materialize(possible_starts(spans, extent, keys, min_gap_rows), "segments")
    width = _outline(_inside(lines, starts.withColumn("segment", F.col("start")), keys, "segment"), [*keys, "segment"])
    near = materialize(_heads(starts.select(*keys, "start").unionByName(extent.select(*keys, "start")), keys).distinct(), "near-rows")
    asked = [r.row for r in near.select("row").distinct().limit(FETCH + 1).collect()]
    heads = here.filter(F.col("row").isin(asked)) if len(asked) <= FETCH else here      # most cells go before they meet anything
    heads = heads.join(near.select(*S, "row").distinct(), [*S, "row"], "left_semi").join(of_column, [*S, "col"])
    shape = materialize(row_shape(heads.join(near, [*keys, "row"]), keys), "head-rows")
    opening = starts.select(*keys, F.col("start").alias("row")).join(width.select(*keys, F.col("segment").alias("row"), "width"), [*keys, "row"])
    opens = opening.join(shape, [*keys, "row"]).filter(header_like(F.col("width"))).select(*keys, F.col("row").alias("start"))
    blocks = opens.unionByName(extent.select(*keys, "start")).distinct()
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start")) - 1
    blocks = blocks.withColumn("after", after).join(extent.select(*keys, "end"), keys)
    blocks = materialize(blocks.select(*keys, F.col("start").alias("block"), "start", F.coalesce("after", "end").alias("end")), "row-blocks")
    key = [*keys, "block"]
    boxes = materialize(_outline(_inside(lines, blocks, keys, "block"), key), "region-boxes")
    last = F.least("last_row", F.col("first_row") + V.HEADER_SCAN_ROWS)
    heads = boxes.select(*key, "first_row", "width", F.explode(F.sequence("first_row", last)).alias("row")).join(shape, [*keys, "row"])
    found = boxes.join(first_headers(heads, key), key, "left")
    order = Window.partitionBy(*S).orderBy("first_row", "first_col")
    kind = F.when((F.col("first_row") < F.col("last_row")) & (F.col("width") >= 2), "table").otherwise("note")
    return found.select(*S, F.row_number().over(order).alias("region_no"), kind.alias("kind"), "first_row", "first_col", "last_row",
                        "last_col", "header_row", "cells")


def row_masks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, word, mask, text_mask, n, text_n, times): the used columns of each row as bits, 64 columns a word, and those with
    a text. What regions are made of is read from these, a row for many cells. `times` tells how often each column is used, eight
    columns a number, if n is at most MOST."""
    text, octet, one = F.col("kind") == "text", F.shiftright("col", 3).bitwiseAND(7), F.expr("shiftleft(1L, CAST(pmod(col, 8) * 8 AS INT))")
    return cells.groupBy(*keys, "row", F.shiftright("col", 6).alias("word")).agg(
        F.bit_or(_bit("col")).alias("mask"), F.coalesce(F.bit_or(F.when(text, _bit("col"))), F.lit(0).cast("long")).alias("text_mask"),
        F.count(F.lit(1)).alias("n"), F.count_if(text).alias("text_n"), F.array(*[F.try_sum(F.when(octet == i, one)) for i in range(8)]).alias("times"))


def _lines(rows: DataFrame, bands: DataFrame, cells: DataFrame, of_column: DataFrame) -> DataFrame:
    """(source_id, sheet, band, row, word, mask, n, likely): the part of each row of bits that lies in a band, and if it may be a
    header by its texts: four fifths of its cells, where texts of other bands stand once at least and of its other columns one cell.
    A row of several words that are four fifths texts has such a word."""
    within, mask, other = F.col("within"), F.col("mask"), F.bitwise_not("within")
    here, keys = mask.bitwiseAND(within), [*S, "band"]
    parts = rows.filter("row IS NOT NULL").join(_column_words(bands, "band", "lo", "hi"), [*S, "word"]).filter(here != 0)
    texts = F.col("text_n") - F.bit_count(F.col("text_mask").bitwiseAND(other))
    likely = (texts > 0) & (texts >= 4 * F.bit_count(here.bitwiseAND(F.bitwise_not("text_mask"))))
    column = lambda b: F.call_function("shiftright", F.get("times", F.shiftright(b, 3)), b.bitwiseAND(7) * 8).bitwiseAND(255)
    n = F.when(F.col("n") == F.bit_count("mask"), F.bit_count(here).cast("long")).when(mask == here, F.col("n")).otherwise(
        F.aggregate(_positions(here), F.lit(0).cast("long"), lambda total, b: total + column(b)))
    lines = parts.select(*keys, "row", "word", here.alias("mask"), n.alias("n"), likely.alias("likely"))
    often = rows.filter((F.col("n") > MOST) & (F.col("n") > F.bit_count("mask"))).select(*S, "row", "word")
    if often.isEmpty():
        return lines
    again = cells.withColumn("word", F.shiftright("col", 6)).join(often, [*S, "row", "word"], "left_semi").join(of_column, [*S, "col"])
    again = materialize(again.groupBy(*keys, "row", "word").agg(F.count(F.lit(1)).alias("counted")), "repeated-cells")
    return lines.join(again, [*keys, "row", "word"], "left").withColumn("n", F.coalesce("counted", "n")).drop("counted")


def row_spans(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, used, likely, first, last): the used rows as bits, 64 rows a span, and those that may be a header."""
    return lines.groupBy(*keys, F.shiftright("row", 6).alias("at")).agg(
        F.bit_or(_bit("row")).alias("used"), F.coalesce(F.bit_or(F.when(F.col("likely"), _bit("row"))), F.lit(0).cast("long")).alias("likely"),
        F.min("row").alias("first"), F.max("row").alias("last"))


def possible_starts(spans: DataFrame, extent: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, start, end): stretches of rows, parted by `gap` or more unused ones, whose first row may be a header; `end` is the row
    before the next stretch, or the last one. Each span needs the last row before it and the first stretch after it, which are
    found in chunks and across them."""
    chunked = spans.withColumn("_chunk", F.floor(F.col("at") / SPAN))
    chunk = [*keys, "_chunk"]
    ends = chunked.groupBy(*chunk).agg(F.max("last").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    known = chunked.withColumn("_prev", F.lag("last").over(Window.partitionBy(*chunk).orderBy("at"))).join(ends, chunk)
    apart = F.coalesce(F.col("first") - F.coalesce("_prev", "_before") - 1 >= gap, F.lit(True))
    near = F.lit(0).cast("long")
    for i in range(1, min(gap, 63) + 1):
        near = near.bitwiseOR(F.shiftleft("used", i))
    inside = F.col("used").bitwiseAND(F.bitwise_not(near))
    known = known.withColumn("starts", F.when(apart, inside).otherwise(inside.bitwiseAND(F.bitwise_not(_bit("first")))))
    lowest = F.instr(F.reverse(F.bin("starts")), "1") - 1
    known = known.withColumn("_own", F.when(F.col("starts") != 0, F.col("at") * 64 + lowest)).drop("_prev", "_before")
    later = F.last("_own", ignorenulls=True)
    firsts = known.groupBy(*chunk).agg(F.min("_own").alias("_own"))
    firsts = firsts.withColumn("_after", later.over(Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1))).drop("_own")
    following = later.over(Window.partitionBy(*chunk).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    known = known.withColumn("_next", following).join(firsts, chunk).filter(F.col("starts").bitwiseAND(F.col("likely")) != 0)
    bits = known.select(*keys, "at", "likely", _positions(F.col("starts")).alias("p"), F.coalesce("_next", "_after").alias("_next"))
    each = F.transform("p", lambda b, i: F.struct(b.alias("bit"), (F.col("at") * 64 + b).alias("start"),
                                                  F.coalesce(F.col("at") * 64 + F.get("p", i + 1), F.col("_next")).alias("next")))
    found = bits.select(*keys, "likely", F.explode(each).alias("s")).filter(F.getbit("likely", F.col("s.bit")) == 1)
    return found.join(extent.select(*keys, "end"), keys).select(*keys, "s.start", F.coalesce(F.col("s.next") - 1, F.col("end")).alias("end"))


def _heads(starts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows from each start on in which a header is sought."""
    return starts.select(*keys, F.explode(F.sequence("start", F.col("start") + V.HEADER_SCAN_ROWS)).alias("row"))


def _outline(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_row, last_row, first_col, last_col, cells, width) of groups of row masks."""
    words = lines.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
                                             F.sum("n").alias("n"))
    bits = _positions(F.col("mask"))
    words = words.withColumn("lo", F.col("word") * 64 + F.array_min(bits)).withColumn("hi", F.col("word") * 64 + F.array_max(bits))
    return words.groupBy(*keys).agg(F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.min("lo").alias("first_col"),
                                    F.max("hi").alias("last_col"), F.sum("n").alias("cells"), F.sum(F.bit_count("mask")).alias("width"))


def _inside(lines: DataFrame, spans: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Range join lines.row between spans.start and spans.end, which do not overlap: compared where a key has few spans."""
    crowded = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select(*keys)
    few = spans.select(*keys, label, "start", "end")
    if crowded.isEmpty():
        return lines.join(few, keys).filter(F.col("row").between(F.col("start"), F.col("end"))).drop("start", "end")
    few = few.join(crowded, keys, "left_anti")
    compared = lines.join(few, keys).filter(F.col("row").between(F.col("start"), F.col("end"))).drop("start", "end")
    return compared.unionByName(_within(lines, spans.join(crowded, keys, "left_semi"), keys, label))


def _within(cells: DataFrame, spans: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Range join cells.row between spans.start and spans.end: both meet on buckets of 1,024 rows."""
    pieces = spans.select(*keys, label, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("end") / SPAN))).alias("_at"))
    joined = cells.withColumn("_at", F.floor(F.col("row") / SPAN)).join(pieces, [*keys, "_at"])
    return joined.filter((F.col("row") >= F.col("start")) & (F.col("row") <= F.col("end"))).drop("_at", "start", "end")


def region_cells(cells: DataFrame, region_rows: DataFrame) -> DataFrame:
    """(source_id, sheet, region_no, row, col, name, num, txt): body cells of every region, named by its own header row."""
    boxes = region_rows.filter("kind = 'table'").select(*S, "region_no", F.col("first_row").alias("start"), F.col("last_row").alias("end"),
                                                        "first_col", "last_col", "header_row")
    here = cells.filter("kind <> 'error'")
    tagged = _within(here, boxes.withColumn("box", F.struct("region_no", "first_col", "last_col", "header_row")), S, "box")
    tagged = tagged.filter(F.col("col").between(F.col("box.first_col"), F.col("box.last_col"))).select(
        *S, "box.region_no", "box.header_row", "row", "col", "num", "txt")
    names = tagged.filter("row = header_row").select(*S, "region_no", "col", F.coalesce("txt", F.col("num").cast("string")).alias("name"))
    body = tagged.filter("header_row IS NULL OR row > header_row")
    named = F.coalesce("name", F.concat(F.lit("col_"), F.col("col").cast("string")))
    return body.join(names, [*S, "region_no", "col"], "left").select(*S, "region_no", "row", "col", named.alias("name"), "num", "txt")


def region_table(cells: DataFrame, region_rows: DataFrame, source_id: str, sheet: str, region_no: int) -> DataFrame:
    """One region as rows: `_row_id` and a text column per header name."""
    mine = region_cells(cells, region_rows.filter((F.col("source_id") == source_id) & (F.col("sheet") == sheet)
                                                  & (F.col("region_no") == region_no)))
    names = [r.name for r in mine.groupBy("col").agg(F.first("name").alias("name")).orderBy("col").collect()]
    value = F.coalesce("txt", F.col("num").cast("string"))
    return mine.groupBy(F.col("row").alias("_row_id")).pivot("name", names).agg(F.first(value)).orderBy("_row_id")


def table_regions(region_rows: DataFrame) -> DataFrame:
    """How many real tables each sheet holds (notes never count)."""
    return region_rows.filter("kind = 'table'").groupBy(*S).agg(F.count(F.lit(1)).alias("tables"))
