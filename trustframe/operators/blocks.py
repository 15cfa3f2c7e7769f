"""Documents as ordered text blocks and table cells: plain text, Markdown, CSV and HTML."""

from __future__ import annotations

import html as html_module

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions.entities import entities_of, may_hold_entities
from ..functions.numbers import parse_number

BLOCK = "source_id string, part string, kind string, page int, section string, level int, ord int, text string"
CELL = "source_id string, table_no int, section string, row int, col int, text string"


def _paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?U)\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def with_block_id(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("block_id", F.concat(F.col("source_id"), F.lit("#"), F.col("ord").cast("string")))


def text_blocks(docs: DataFrame, source_id: Column, text: Column, kind: str = "paragraph") -> DataFrame:
    """One block per paragraph; paragraphs are separated by blank lines."""
    rows = docs.select(source_id.cast("string").alias("source_id"), F.posexplode(_paragraphs(text)).alias("ord", "text"))
    return with_block_id(rows.select("source_id", F.lit("").alias("part"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("page"),
                                     F.lit("").alias("section"), F.lit(None).cast("int").alias("level"),
                                     (F.col("ord") + 1).alias("ord"), "text"))


def push_heading(stack: Column, heading: Column) -> Column:
    """The heading stack with one more entry: where it stands, and the titles from the top down to it."""
    before = F.when(F.size(stack) > 0, F.element_at(stack, -1)["path"]).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.slice(before, 1, heading["level"] - 1), F.array(heading["title"]))
    return F.concat(stack, F.array(F.struct(heading["at"].alias("at"), path.alias("path"))))


def _markdown_chunks(docs: DataFrame, source_id: Column, text: Column) -> DataFrame:
    """(source_id, at, chunk, lines, is_table, level, title, path): path is the heading stack after this chunk.

    The stack is folded over the headings of one document only (a few per document); blocks take it from a window.
    """
    def lines_of(c: Column) -> Column:
        return F.split(c, r"\r\n|\n|\r")

    def pipes(c: Column) -> Column:
        return F.forall(lines_of(c), lambda x: F.trim(x).startswith("|")) & (F.size(lines_of(c)) >= 2)

    def level_of(c: Column) -> Column:
        first = lines_of(c)[0]
        return F.when(pipes(c), 0).otherwise(F.length(F.regexp_extract(first, r"^(#{1,6})\s+.*", 1)))

    chunks = _paragraphs(text)
    described = F.transform(chunks, lambda c, i: F.struct(
        i.alias("at"), c.alias("chunk"), lines_of(c).alias("lines"), pipes(c).alias("is_table"), level_of(c).alias("level"),
        F.trim(F.regexp_extract(lines_of(c)[0], r"^#{1,6}\s+(.*)", 1)).alias("title")))
    empty = F.array().cast("array<struct<at: int, path: array<string>>>")

    rows = docs.select(source_id.cast("string").alias("source_id"), described.alias("d")).filter(F.size("d") > 0)
    rows = rows.withColumn("stack", F.aggregate(F.filter("d", lambda d: d["level"] > 0), empty, push_heading))
    rows = rows.withColumn("paths", F.map_from_entries("stack"))
    flat = rows.select("source_id", "paths", F.explode("d").alias("c")).select("source_id", "c.*", F.try_element_at("paths", "c.at").alias("own"))
    order = Window.partitionBy("source_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("path", F.coalesce(F.last("own", ignorenulls=True).over(order), F.array().cast("array<string>"))).drop("own")


def _section(path: Column) -> Column:
    return F.array_join(path, " > ")


def markdown_blocks(docs: DataFrame, source_id: Column, text: Column) -> DataFrame:
    """Headings (with their level) and paragraphs, each under its heading path; pipe tables go to `markdown_cells`."""
    chunks = _markdown_chunks(docs, source_id, text).filter("NOT is_table")
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    rest = F.regexp_replace(F.array_join(F.slice("lines", 2, 1 << 20), "\n"), r"(?U)^\s+|\s+$", "")
    heading = F.struct(F.lit("heading").alias("kind"), _section(parent).alias("section"), F.col("level").alias("level"), F.col("title").alias("text"))
    below = F.struct(F.lit("paragraph").alias("kind"), _section(F.col("path")).alias("section"), F.lit(None).cast("int").alias("level"),
                     F.when(F.col("level") > 0, rest).otherwise(F.col("chunk")).alias("text"))
    pieces = F.filter(F.when(F.col("level") > 0, F.array(heading, below)).otherwise(F.array(below)), lambda p: p["text"] != "")
    rows = chunks.select("source_id", "at", F.posexplode(pieces).alias("piece", "b"))
    order = Window.partitionBy("source_id").orderBy("at", "piece")
    return with_block_id(rows.select("source_id", F.lit("").alias("part"), "b.kind", F.lit(None).cast("int").alias("page"), "b.section",
                                     "b.level", F.row_number().over(order).alias("ord"), "b.text"))


def markdown_cells(docs: DataFrame, source_id: Column, text: Column) -> DataFrame:
    """(source_id, table_no, section, row, col, text) of every pipe table; separator lines are not rows."""
    tables = _markdown_chunks(docs, source_id, text).filter("is_table")
    tables = tables.withColumn("table_no", F.row_number().over(Window.partitionBy("source_id").orderBy("at")))
    body = F.filter("lines", lambda x: ~x.rlike(r"^\s*\|?\s*:?-{2,}"))
    rows = tables.select("source_id", "table_no", _section(F.col("path")).alias("section"), F.posexplode(body).alias("row", "line"))
    bare = F.regexp_replace(F.trim("line"), r"^\|+|\|+$", "")
    return rows.select("source_id", "table_no", "section", (F.col("row") + 1).alias("row"),
                       F.posexplode(F.split(bare, r"\|")).alias("col", "text")).select(
        "source_id", "table_no", "section", "row", (F.col("col") + 1).alias("col"), F.trim("text").alias("text"))


# ---- web pages --------------------------------------------------------------------------------------------------
# Markup is turned into marked text by regular expressions: MARK name END opens a piece, CUT parts tables from the rest,
# and HELD stands for `<` inside tables until their cells are read.
MARK, END, CUT, HELD = "\x01", "\x02", "\x04", "\x05"
INSIDE_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|head)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)"
BREAKS = "p|div|li|h[1-6]|br|tr|section|article|blockquote"
ANY_TAG = rf"</?[A-Za-z]{INSIDE_TAG}>|<[!?][^>]*>"


@F.pandas_udf(StringType())
def _without_references(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else html_module.unescape(t))


def _characters(c: Column) -> Column:
    """Character references become characters; texts without any never leave the JVM."""
    some = F.when(F.contains(c, F.lit("&")), c)
    return F.coalesce(_without_references(some), c)


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def _marked(html: Column) -> Column:
    """A page as marked text: MARK name END text, where an unnamed piece follows a closing tag; pieces hold text, but for the first."""
    seen = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), MARK + END + CUT + HELD, ""), UNSEEN, "")
    parted = F.regexp_replace(F.regexp_replace(seen, r"(?i)(<table(?=[\s/>]))", CUT + "$1"), r"(?i)(</table\s*>)", "$1" + CUT)
    whole = F.transform(F.split(parted, CUT), lambda p: F.when(
        p.rlike(r"(?i)^<table(?=[\s/>])"), F.concat(F.lit(MARK + "table" + END), F.translate(p, "<", HELD), F.lit(MARK + END))).otherwise(p))
    opened = F.regexp_replace(F.array_join(whole, ""), rf"(?i)<({BREAKS})(?=[\s/>]){INSIDE_TAG}>", f"{MARK}$1{END}")
    closed = F.regexp_replace(opened, rf"(?i)</(?:{BREAKS})\s*>", MARK + END)
    text = _characters(F.regexp_replace(closed, ANY_TAG, ""))
    # of a run of pieces without text the last name counts
    named = F.regexp_replace(text, rf"(?U)(?:{MARK}\w*{END}\s*)*{MARK}(\w+){END}\s*(?:{MARK}{END}\s*)*", f"{MARK}$1{END}")
    return F.regexp_replace(named, rf"(?U)(?:{MARK}{END}\s*)+", MARK + END)


def _table_rows(table: Column) -> Column:
    """The closed rows of a table's markup, each an array of the texts of its closed cells."""
    def after(c: Column, tag: str, closing: str) -> Column:
        parts = F.slice(F.split(c, rf"(?i)<{tag}(?=[\s/>]){INSIDE_TAG}>"), 2, 1 << 30)
        return F.transform(F.filter(parts, lambda x: x.rlike(f"(?i)</{closing}")), lambda x: F.regexp_replace(x, rf"(?is)</{closing}\s*>.*", ""))

    return F.transform(after(table, "tr", "tr"), lambda r: F.transform(after(r, "t[dh]", "t[dh]"), lambda x: _one_line(F.regexp_replace(x, ANY_TAG, ""))))


def html_parts(pages: DataFrame, source_id: Column, html: Column) -> DataFrame:
    """(source_id, what, kind, level, section, ord, table_no, row, col, text): blocks and table cells of web pages; `what` tells them
    apart. Pages are read where they lie, by expressions on the whole page; only character references need Python.

    Headings, list items and paragraphs end at block tags; scripts, styles, comments and the head are not shown. A cell counts
    if its tag, its row and its table are closed.
    """
    rows = pages.select(source_id.cast("string").alias("source_id"), _marked(html).alias("marked"))
    split = F.transform(F.split("marked", MARK), lambda p: F.struct(
        F.when(F.contains(p, F.lit(END)), F.lower(F.substring_index(p, END, 1))).otherwise("").alias("tag"), F.substring_index(p, END, -1).alias("body")))
    shown = F.transform("split", lambda p: F.struct(
        p["tag"].alias("tag"), F.when(p["tag"] == "table", F.translate(p["body"], HELD, "<")).otherwise(_one_line(p["body"])).alias("text")))
    kept = F.filter("shown", lambda p: F.when(p["tag"] == "table", p["text"].rlike("(?i)</table")).otherwise(p["text"] != ""))
    rows = rows.withColumn("split", split).withColumn("shown", shown).withColumn("kept", kept)
    is_heading = lambda p: p["tag"].rlike("^h[1-6]$")
    heads = F.filter(F.transform("kept", lambda p, i: F.struct(i.alias("at"), p["tag"].alias("tag"), F.substring(p["tag"], 2, 1).try_cast("int").alias("level"), p["text"].alias("title"))), is_heading)
    empty = F.array().cast("array<struct<at: int, path: array<string>>>")
    rows = rows.select("source_id", "kept", F.aggregate(heads, empty, push_heading).alias("stack"))

    def path(i: Column) -> Column:
        above = F.filter("stack", lambda s: s["at"] <= i)
        return F.when(F.size(above) > 0, F.element_at(above, -1)["path"]).otherwise(F.array().cast("array<string>"))

    pieces = F.transform("kept", lambda p, i: F.struct(p["tag"].alias("tag"), p["text"].alias("text"), path(i).alias("path"), is_heading(p).alias("heading")))
    rows = rows.select("source_id", pieces.alias("pieces"))
    nothing = [F.lit(None).cast("int").alias(c) for c in ("table_no", "row", "col")]
    blocks = rows.select("source_id", F.posexplode(F.filter("pieces", lambda p: p["tag"] != "table")).alias("ord", "p"))
    parent = F.slice("p.path", 1, F.greatest(F.size("p.path") - 1, F.lit(0)))
    blocks = blocks.select("source_id", F.lit("block").alias("what"), F.when(F.col("p.heading"), "heading").when(F.col("p.tag") == "li", "list_item").otherwise("paragraph").alias("kind"),
                           F.when(F.col("p.heading"), F.substring("p.tag", 2, 1).try_cast("int")).alias("level"),
                           _section(F.when(F.col("p.heading"), parent).otherwise(F.col("p.path"))).alias("section"), (F.col("ord") + 1).alias("ord"), *nothing, F.col("p.text").alias("text"))
    numbered = F.transform(F.filter("pieces", lambda p: p["tag"] == "table"), lambda p, i: F.transform(_table_rows(p["text"]), lambda r, j: F.transform(
        r, lambda c, k: F.struct((i + 1).alias("table_no"), (j + 1).alias("row"), (k + 1).alias("col"), c.alias("text"), _section(p["path"]).alias("section")))))
    cells = rows.filter(F.exists("pieces", lambda p: p["tag"] == "table")).select("source_id", F.posexplode(F.flatten(F.flatten(numbered))).alias("ord", "c"))
    cells = cells.select("source_id", F.lit("cell").alias("what"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("level"), "c.section", (F.col("ord") + 1).alias("ord"),
                         "c.table_no", "c.row", "c.col", "c.text")
    return blocks.unionByName(cells)


def html_blocks(parts: DataFrame) -> DataFrame:
    return with_block_id(parts.filter("what = 'block'").select("source_id", F.lit("").alias("part"), "kind",
                                                               F.lit(None).cast("int").alias("page"), "section", "level", "ord", "text"))


def html_cells(parts: DataFrame) -> DataFrame:
    return parts.filter("what = 'cell'").select("source_id", "table_no", "section", "row", "col", "text")


def document_tables(cells: DataFrame) -> DataFrame:
    """Cells of real tables only: empty rows go, what is left needs two rows and two columns. Rows are numbered anew."""
    key = ["source_id", "table_no"]
    filled = cells.withColumn("text", F.trim("text")).groupBy(*key, "row").agg(F.count_if(F.col("text") != "").alias("f"))
    shape = cells.join(filled.filter("f > 0").drop("f"), [*key, "row"], "left_semi")
    sizes = shape.groupBy(*key).agg(F.count_distinct("row").alias("rows"), F.max("col").alias("cols"))
    kept = shape.join(sizes.filter("rows >= 2 AND cols >= 2").select(*key), key, "left_semi")
    return kept.withColumn("row", F.dense_rank().over(Window.partitionBy(*key).orderBy("row")))


def typed_document_columns(cells: DataFrame) -> DataFrame:
    """(source_id, table_no, col, header, kind): numbers when at least 90% of the filled cells parse, mixed when some do not."""
    key = ["source_id", "table_no", "col"]
    number = parse_number(F.col("text"))
    body = cells.filter("row > 1 AND text <> ''").groupBy(*key).agg(
        F.count(F.lit(1)).alias("filled"), F.count(number).alias("parsed"), F.bool_and(F.coalesce(number == F.floor(number), F.lit(True))).alias("whole"))
    header = cells.filter("row = 1").select(*key, F.col("text").alias("header"))
    numeric = F.col("parsed") >= 0.9 * F.col("filled")
    kind = (F.when(numeric & (F.col("parsed") < F.col("filled")), "mixed").when(numeric & F.col("whole"), "int")
            .when(numeric, "real").otherwise("text"))
    return header.join(body, key, "left").select(*key, "header", F.when(F.col("filled").isNull(), "text").otherwise(kind).alias("kind"))


def typed_document_values(cells: DataFrame) -> DataFrame:
    """Body cells with their typed value: (source_id, table_no, row, col, header, kind, num, txt)."""
    kinds = typed_document_columns(cells)
    rows = cells.filter("row > 1").join(kinds, ["source_id", "table_no", "col"])
    number = F.when(F.col("kind") != "text", parse_number(F.col("text")))
    text = F.when((F.col("text") != "") & number.isNull(), F.col("text"))
    return rows.select("source_id", "table_no", "row", "col", "header", "kind", number.alias("num"), text.alias("txt"))


def entities(blocks: DataFrame) -> DataFrame:
    """(source_id, block_id, kind, value, normalized, start, end) for every entity of every block."""
    found = blocks.filter(may_hold_entities(F.col("text"))).select("source_id", "block_id", F.explode(entities_of(F.col("text"))).alias("e"))
    return found.select("source_id", "block_id", "e.kind", "e.value", "e.normalized", "e.start", "e.end")
