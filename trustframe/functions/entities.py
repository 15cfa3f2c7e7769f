"""Entities in free text: the values that link a document to data, each with its character span.

Expressions only: where a pattern matches follows from the pieces between its matches, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed_values as V

ENTITY = "array<struct<start:int,end:int,kind:string,value:string,normalized:string>>"


def _iso_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "yyyy-M-d").cast("string")


def _numeric_date(value: Column) -> Column:
    parts = F.split(value, "[-/.]")
    ymd = _iso_date(parts[0], F.regexp_replace(parts[1], "^0", ""), F.regexp_replace(parts[2], "^0", ""))
    dmy = _iso_date(parts[2], F.regexp_replace(parts[1], "^0", ""), F.regexp_replace(parts[0], "^0", ""))
    return F.when(F.length(parts[0]) == 4, ymd).otherwise(dmy)


def _named_date(value: Column) -> Column:
    """The year stands last, the day is the other number, the month the word."""
    numbers, word = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), F.lower(F.regexp_extract(value, r"(?U)\p{L}+", 0))
    months = F.create_map(*[F.lit(x) for m, n in V.ARABIC_MONTHS.items() for x in (m, n)])
    english = F.array_position(F.array(*[F.lit(m) for m in V.ENGLISH_MONTHS]), F.substring(word, 1, 3)).cast("int")
    month = F.coalesce(F.try_element_at(months, word), english)
    return _iso_date(F.get(numbers, F.lit(1)), month, F.regexp_replace(F.get(numbers, F.lit(0)), "^0", ""))


def _money(value: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in V.TEXT_CURRENCIES.items() for x in pair])
    number = F.regexp_extract(value, V.NUMBER_PATTERN, 0)
    sign = F.lower(F.regexp_replace(F.replace(value, number, F.lit("")), r"(?U)\s", ""))
    amount = F.regexp_replace(number, "[,٬]", "").try_cast("double")
    return F.concat(F.format_string("%.2f", F.bround(amount, 2)), F.lit(" "), F.try_element_at(codes, sign))


#: Kinds in priority order: where two matches overlap, the earlier kind keeps the text; without a normal form there is no entity.
FINDERS: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("email", V.EMAIL_PATTERN, F.lower), ("money", V.MONEY_PATTERN, _money), ("date", V.NUMERIC_DATE_PATTERN, _numeric_date),
    ("date", V.NAMED_DATE_PATTERN, _named_date), ("percent", V.PERCENT_PATTERN, lambda v: F.replace(v, F.lit(" "), F.lit(""))),
    ("phone", V.PHONE_PATTERN, lambda v: F.regexp_replace(v, r"(?U)[\s-]", "")), ("code", V.CODE_PATTERN, F.upper)]


#: Stands around matches while a text is cut at them.
CUT = "\x00"


def _matches(text: Column, kind: str, pattern: str, normal: Callable[[Column], Column]) -> Column:
    """All matches of one pattern, found in one pass: they are cut out, and each starts where the piece before it ends.

    A cut by the pattern itself would compile it anew for every text; it is left to the texts that hold the mark.
    """
    pattern = "(?U)" + pattern
    cut = F.split(F.regexp_replace(text, pattern, f"{CUT}$0{CUT}"), CUT, -1)
    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    paired = F.filter(F.flatten(F.transform(pairs, lambda p: F.array(p["0"], p["1"]))), lambda p: p.isNotNull())
    pieces = F.when(F.contains(text, F.lit(CUT)), paired).otherwise(cut)
    empty = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(ENTITY).alias("found"))

    def step(done: Column, value: Column) -> Column:
        start = done["at"]
        end = start + F.length(value)
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"), normal(value).alias("normalized"))
        return F.struct(end.alias("at"), (~done["inside"]).alias("inside"), F.when(done["inside"], F.concat(done["found"], F.array(one))).otherwise(done["found"]).alias("found"))

    return F.aggregate(pieces, empty, step, lambda done: done["found"])


def _entities_of_plain(plain: Column) -> Column:
    by_kind = F.array(*[_matches(plain, *finder) for finder in FINDERS])

    def add(found: Column, more: Column) -> Column:
        free = F.filter(more, lambda m: m["normalized"].isNotNull() & ~F.exists(found, lambda f: (f["start"] < m["end"]) & (f["end"] > m["start"])))
        return F.concat(found, free)

    return F.array_sort(F.aggregate(by_kind, F.array().cast(ENTITY), add))


def entities_of(text: Column) -> Column:
    """[(start, end, kind, value as written, normalized)] of a text in text order; Arabic-Indic digits are read as digits, once."""
    return F.get(F.transform(F.array(F.translate(text, *V.ARABIC_DIGITS)), _entities_of_plain), F.lit(0))


def stated_values(text: Column) -> Column:
    """Dates and amounts of a text in normal form, amounts also without their currency."""
    norms = F.transform(F.filter(entities_of(text), lambda e: e["kind"].isin("date", "money")), lambda e: e["normalized"])
    return F.flatten(F.transform(norms, lambda n: F.array(n, F.substring_index(n, " ", 1))))


def may_hold_entities(c: Column) -> Column:
    """Every kind needs a digit or an @: other texts are passed over."""
    return c.rlike("[0-9@٠-٩۰-۹]")
