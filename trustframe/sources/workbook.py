"""Spreadsheet files (OOXML) as a long table of cells, with merged areas, sheets and what could not be read."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.dates import format_class
from ..session import spread

PART = ("source_id string, what string, sheet string, row int, col int, kind string, num double, txt string, format string, "
        "formula string, row2 int, col2 int, epoch1904 boolean")
NAMES = [f.split()[0] for f in PART.split(", ")]
BATCH = 50_000
DAYS_1904 = 1462

# fixed values: number formats the file format defines by id
BUILT_IN = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm",
            21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}
BLIND = {"xl/externalLinks/externalLink": "external_link", "xl/pivotTables/pivotTable": "pivot_table", "xl/model/": "data_model",
         "xl/charts/chart": "chart", "customXml/item": "custom_xml"}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _place(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(ref[len(letters):]), col


class Workbook:
    """Just enough of the package format to stream cells sheet by sheet."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.parts = set(self.zip.namelist())
        self.strings = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in self.elements("xl/sharedStrings.xml", "si")]
        codes, self.formats = dict(BUILT_IN), []
        for e in self.elements("xl/styles.xml", "numFmt", "cellXfs"):
            if _tag(e) == "numFmt":
                codes[int(e.get("numFmtId"))] = e.get("formatCode")
            else:
                self.formats = [codes.get(int(xf.get("numFmtId", 0))) for xf in e]
        targets = {e.get("Id"): e.get("Target") for e in self.elements("xl/_rels/workbook.xml.rels", "Relationship")}
        self.epoch1904, self.sheets = False, []
        for e in self.elements("xl/workbook.xml", "sheet", "workbookPr"):
            if _tag(e) == "workbookPr":
                self.epoch1904 = e.get("date1904") in ("1", "true")
                continue
            target = next((targets.get(v) for k, v in e.attrib.items() if k.endswith("}id")), None)
            if target:
                part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
                self.sheets.append((e.get("name"), e.get("state", "visible"), part))

    def elements(self, part: str, *wanted: str):
        if part in self.parts:
            with self.zip.open(part) as f:
                for _, e in iterparse(f):
                    if _tag(e) in wanted:
                        yield e
                        if _tag(e) not in ("numFmt", "si"):
                            e.clear()

    def cell(self, e) -> tuple:
        """(row, col, kind, num, txt, format, formula) of one <c> element; kind None when it is empty."""
        row, col = _place(e.get("r"))
        value = formula = inline = None
        for child in e.iter():
            name = _tag(child)
            if name == "v":
                value = child.text
            elif name == "f":
                formula = child.text or ""
            elif name == "t":
                inline = (inline or "") + (child.text or "")
        kind, style = e.get("t", "n"), int(e.get("s", 0))
        fmt = self.formats[style] if style < len(self.formats) else None
        if kind == "inlineStr":
            value = inline
        if value is None or value == "":
            return row, col, None, None, None, fmt, formula
        if kind == "n":
            return row, col, "num", float(value), None, fmt, formula
        if kind == "b":
            return row, col, "bool", float(value), None, None, formula
        if kind == "e":
            return row, col, "error", None, value, None, formula
        return row, col, "text", None, self.strings[int(value)] if kind == "s" else value, None, formula

    def rows(self):
        for name, state, part in self.sheets:
            yield ("sheet", name, None, None, state, None, None, None, None, None, None)
            shared: dict[str, str] = {}
            for e in self.elements(part, "c", "mergeCell"):
                if _tag(e) == "mergeCell":
                    first, _, last = e.get("ref").partition(":")
                    (r1, c1), (r2, c2) = _place(first), _place(last or first)
                    yield ("merge", name, r1, c1, None, None, None, None, None, r2, c2)
                    continue
                for f in e:
                    if _tag(f) == "f" and f.get("t") == "shared":
                        shared.setdefault(f.get("si"), f.text or "")
                        f.text = f.text or shared[f.get("si")]
                row, col, kind, num, txt, fmt, formula = self.cell(e)
                if kind:
                    yield ("cell", name, row, col, kind, num, txt, fmt, None if formula is None else f"={formula}", None, None)
        counts: dict[str, int] = {}
        for p in self.parts:
            for prefix, kind in BLIND.items():
                if p.startswith(prefix) and p.endswith((".xml", ".data")):
                    counts[kind] = counts.get(kind, 0) + 1
        for kind, n in sorted(counts.items()):
            yield ("blind_spot", None, None, None, kind, float(n), "not read", None, None, None, None)


def workbook_parts(files: DataFrame) -> DataFrame:
    """All parts of spreadsheet files(source_id, content): cells, merged areas, sheets and blind spots.

    Files are read where they lie and streamed out in batches. A file that cannot be opened becomes a blind spot of
    kind `reader_limit`; it never fails the job or disappears.
    """
    def read(batches):
        out = []
        for batch in batches:
            for sid, content in zip(batch["source_id"], batch["content"]):
                try:
                    book = Workbook(content)
                    for what, sheet, *rest in book.rows():
                        out.append((sid, what, sheet, *rest, book.epoch1904))
                        if len(out) >= BATCH:
                            yield _frame(out)
                            out = []
                except Exception as e:                      # damaged, encrypted or foreign file
                    out.append((sid, "blind_spot", None, None, None, "reader_limit", 1.0, f"{type(e).__name__}: {e}", None, None,
                                None, None, False))
        yield _frame(out)

    return spread(files.select("source_id", "content")).mapInPandas(read, PART)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=NAMES)
    for name in ("row", "col", "row2", "col2"):
        frame[name] = frame[name].astype("Int32")
    return frame


def cells(parts: DataFrame) -> DataFrame:
    """The cell table. Numbers under a date format are dates; 1904 serials are moved to the 1900 count."""
    date = (F.col("kind") == "num") & format_class(F.col("format")).isNotNull()
    num = F.when(date & F.col("epoch1904") & (format_class(F.col("format")) != "time"), F.col("num") + DAYS_1904).otherwise(F.col("num"))
    return parts.filter("what = 'cell'").select("source_id", "sheet", "row", "col", F.when(date, "date").otherwise(F.col("kind")).alias("kind"),
                                                num.alias("num"), "txt", "format", "formula")


def merged_areas(parts: DataFrame) -> DataFrame:
    return parts.filter("what = 'merge'").select("source_id", "sheet", F.col("row").alias("row1"), F.col("col").alias("col1"), "row2", "col2")


def blind_spots(parts: DataFrame) -> DataFrame:
    return parts.filter("what = 'blind_spot'").select("source_id", F.lit("workbook").alias("scope"), "kind",
                                                      F.col("num").cast("long").alias("count"), F.col("txt").alias("detail"))


def sheet_states(parts: DataFrame) -> DataFrame:
    return parts.filter("what = 'sheet'").select("source_id", "sheet", F.col("kind").alias("visibility"))
