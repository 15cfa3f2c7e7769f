"""Names of sources, tables and columns: cleaning, identity, cell addresses, and what a name says about a column."""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column, functions as F

from . import fixed_values as V


# ---- identity (driver side: names are metadata) ----------------------------------------------------------------
def identity_text(value: str) -> str:
    return unicodedata.normalize("NFKC", value or "").strip().casefold()


def _short(value: str) -> str:
    return hashlib.sha256(identity_text(value).encode("utf-8")).hexdigest()[:12]


def table_identity(source_id: str, name: str) -> str:
    """Schema is not part of identity: a table keeps its id when columns change."""
    return f"{source_id}/sheet-{_short(name)}"


def column_identity(table_id: str, name: str) -> str:
    return f"{table_id}/col-{_short(name)}"


def stable_id(*parts: Column) -> Column:
    """Twenty hex digits that depend only on the joined parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 20)


# ---- cleaning ---------------------------------------------------------------------------------------------------
def clean_identifier(c: Column) -> Column:
    """Runs of non-word characters become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?U)\W+", "_"), "^_+|_+$", "")


def clean_header(c: Column) -> Column:
    whole = c.rlike(r"^-?\d+\.0$")
    return F.coalesce(clean_identifier(F.when(whole, F.regexp_replace(c, r"\.0$", "")).otherwise(c)), F.lit(""))


def table_identifier(c: Column) -> Column:
    name = clean_identifier(c)
    name = F.when(name == "", "sheet").otherwise(name)
    return F.when(name.rlike("^[0-9]") | F.lower(name).startswith("sqlite_"), F.concat(F.lit("t_"), name)).otherwise(name)


def source_alias(c: Column) -> Column:
    name = clean_identifier(c)
    name = F.when(name == "", "src").otherwise(name)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("s_"), name)).otherwise(name)


def slug(c: Column, length: int = 40) -> Column:
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?U)[^\w]+", "-"), "^-+|-+$", ""))
    text = F.substring(F.when(text == "", "source").otherwise(text), 1, length)
    return F.regexp_replace(text, "^-+|-+$", "")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


# ---- cell addresses ---------------------------------------------------------------------------------------------
def column_number(letters: Column) -> Column:
    """'A' -> 1, 'AB' -> 28."""
    digits = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def column_letters(number: Column) -> Column:
    """1 -> 'A', 28 -> 'AB' (up to three letters, as far as spreadsheets go)."""
    def letter(n: Column) -> Column:
        return F.char((n % 26 + 65).cast("long"))

    n = number.cast("long")
    last, middle, first = n - 1, F.floor((n - 1) / 26) - 1, F.floor((F.floor((n - 1) / 26) - 1) / 26) - 1
    return F.concat(F.when(n > 702, letter(first)).otherwise(""), F.when(n > 26, letter(middle)).otherwise(""),
                    letter(last))


def parse_address(c: Column) -> Column:
    """'B2:D3' -> struct(row1, col1, row2, col2); NULL when it is not a plain cell range."""
    pattern = r"^([A-Z]+)([0-9]+)(?::([A-Z]+)([0-9]+))?$"
    text = F.upper(F.replace(c, F.lit("$"), F.lit("")))
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 5)]
    row1, col1 = part[1].try_cast("int"), column_number(part[0])
    last = part[2] == ""
    return F.when(text.rlike(pattern), F.struct(
        row1.alias("row1"), col1.alias("col1"), F.when(last, row1).otherwise(part[3].try_cast("int")).alias("row2"),
        F.when(last, col1).otherwise(column_number(part[2])).alias("col2")))


def cell_address(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


# ---- what a column name says ------------------------------------------------------------------------------------
def name_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)[_\W]+"), lambda w: w != "")


def has_word(c: Column, wanted: list[str]) -> Column:
    """Whole words only: 'notes' does not contain the word 'no'."""
    return F.arrays_overlap(name_words(c), F.array(*[F.lit(w) for w in wanted]))


def compact_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def is_additive(c: Column) -> Column:
    return ~has_word(c, V.NON_ADDITIVE_WORDS)


def name_currency(c: Column) -> Column:
    spaced, low = F.array_join(name_words(c), " "), F.lower(c)
    found = F.lit(None).cast("string")
    for token, code in reversed(V.NAME_CURRENCIES):
        found = F.when(F.contains(spaced, F.lit(token)) | F.contains(low, F.lit(token)), code).otherwise(found)
    return found


def name_unit(c: Column) -> Column:
    return F.when(name_currency(c).isNotNull(), "currency").when(has_word(c, V.PERCENT_WORDS), "percent")


def type_family(kind: Column) -> Column:
    return (F.when(kind.isin("date", "datetime", "time"), "date")
            .when(kind.isin("int", "real", "bool"), "number").otherwise("text"))
