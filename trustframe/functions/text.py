"""Text normal forms and predicates as column expressions (they stay inside code generation)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from . import fixed_values as V


def _latin_accents() -> tuple[str, str]:
    """(accented, base) letters of the Latin blocks, from their canonical decompositions."""
    pairs = []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _latin_accents()


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters whose folding is another letter, and those whose folding is several; without the two common ones."""
    lower = [chr(c) for c in range(0x80, 0x110000) if chr(c).lower() == chr(c) != chr(c).casefold() and chr(c) not in "ßς"]
    return {x: x.casefold() for x in lower if len(x.casefold()) == 1}, {x: x.casefold() for x in lower if len(x.casefold()) > 1}


def _ranges(letters, gap: int = 16) -> str:
    """A character class of few ranges that holds the letters, and maybe some between them."""
    codes = sorted(map(ord, letters))
    cuts = [i for i in range(1, len(codes)) if codes[i] - codes[i - 1] > gap]
    return "[" + "".join(f"{chr(codes[i])}-{chr(codes[j - 1])}" for i, j in zip([0, *cuts], [*cuts, len(codes)])) + "]"


FOLDED, SPREAD = _foldings()


def casefold(c: Column) -> Column:
    """Full Unicode case folding. Beside the German and the Greek s, letters that fold further are rare: only texts with one of
    them are translated, and read letter by letter where one letter becomes several."""
    return _further_folded(_lower(c))


def _lower(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def _further_folded(low: Column) -> Column:
    single = F.translate(low, "".join(FOLDED), "".join(FOLDED.values()))
    known = F.create_map(*[F.lit(x) for pair in SPREAD.items() for x in pair])
    letters = F.transform(F.regexp_extract_all(single, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(known, x), x))
    further = F.when(low.rlike(_ranges(SPREAD)), F.array_join(letters, "")).otherwise(single)
    return F.when(low.rlike(_ranges([*SPREAD, *FOLDED])), further).otherwise(low)


def fold(c: Column) -> Column:
    """Search form: case, Arabic letter variants and marks unified; `_` and `-` read as spaces; NULL reads as ''."""
    bare = F.regexp_replace(casefold(c.cast("string")), V.DIACRITICS, "")
    return F.coalesce(squeeze(F.translate(bare, *V.LETTER_FORMS)), F.lit(""))


def normalize_digits(c: Column) -> Column:
    return F.translate(c, *V.ARABIC_DIGITS)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, UNACCENTED)


def search_form(c: Column) -> Column:
    return fold(normalize_digits(c))


def arabic_stem(word: Column) -> Column:
    """Remove a leading conjunction, preposition and article from an Arabic word of the search form."""
    def rest(c: Column, n: int) -> Column:
        return F.substring(c, n + 1, 1 << 30)

    def longer(c: Column, n: int) -> Column:
        return F.length(c) > n

    no_and = F.when(longer(word, 3) & F.substring(word, 1, 1).isin("و", "ف"), rest(word, 1)).otherwise(word)
    glued = longer(no_and, 4) & F.substring(no_and, 1, 1).isin("ب", "ك", "ل") & (F.substring(no_and, 2, 2) == "ال")
    no_prep = F.when(glued, rest(no_and, 1)).otherwise(no_and)
    no_article = F.when(longer(no_prep, 3) & no_prep.startswith("ال"), rest(no_prep, 2)).otherwise(no_prep)
    to_the = longer(no_and, 4) & no_and.startswith("لل")
    return (F.when(~word.rlike("^[ء-ي]"), word)
            .when(to_the, rest(no_and, 2)).otherwise(no_article))


def words(c: Column) -> Column:
    """Words of the search form, split on spaces."""
    return F.array_remove(F.split(search_form(c), " "), "")


def index_text(c: Column) -> Column:
    """The search form followed by the stems it does not already contain (only Arabic words have stems)."""
    form, base = search_form(c), words(c)
    extra = F.array_sort(F.array_except(F.transform(base, arabic_stem), base))
    return F.when(form.rlike("[ء-ي]"), F.concat_ws(" ", F.concat(base, extra))).otherwise(form)


def index_tokens(c: Column) -> Column:
    """Letter and digit runs of the index text without accents: what a full-text index stores.

    Digits, marks and letter forms are unified, and stems added, only in texts with a letter of the Arabic block. Spaces,
    `_` and `-` part words anyway, so other texts are case-folded and cut. Each step reads its text once.
    """
    def bare(text: Column) -> Column:
        return once(_lower(text), lambda low: F.when(F.octet_length(low) == F.char_length(low), low).otherwise(strip_accents(_further_folded(low))))

    form = once(F.coalesce(c.cast("string"), F.lit("")), lambda text: F.when(
        text.rlike("[\u0600-\u06FF]"), strip_accents(index_text(text))).otherwise(bare(text)))
    return F.array_remove(F.split(form, r"[^\p{L}\p{N}\p{Co}]+"), "")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a column that is computed once a row, however often `use` names it, also where Spark does not see to that."""
    return F.transform(F.array(c), use)[0]


def is_null_token(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(V.NULL_TOKENS)


def is_totals_label(c: Column) -> Column:
    """A total label on its own, or at either end of a short text. Every label is short, so one pattern decides."""
    whole, ends = ("|".join(re.escape(w) for w in words_) for words_ in (V.TOTALS_LABELS, V.TOTALS_AFFIXES))
    label = F.trim(c)
    return (F.length(label) <= V.TOTALS_MAX_LENGTH) & F.lower(label).rlike(rf"^(?:{whole})\z|^(?:{ends}) | (?:{ends})\z")


def category_form(c: Column) -> Column:
    """Spelling variants that differ only in case and spacing share this form."""
    return casefold(squeeze(c))


def token_units(c: Column) -> Column:
    """Sevenths of an estimated token: 2 per ASCII character, 7 per other character (an integer, so sums are exact)."""
    ascii_chars = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return (ascii_chars * 2 + (F.length(c) - ascii_chars) * 7).cast("long")


def token_estimate(c: Column) -> Column:
    return F.ceil(token_units(c) / F.lit(7.0)).cast("long")


def snippet(c: Column, tokens: Column, words_shown: int = V.SNIPPET_WORDS) -> Column:
    """About thirty words around the first word that contains one of the searched tokens."""
    parts = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    hits = F.transform(parts, lambda w: F.exists(
        tokens, lambda t: F.contains(arabic_stem(strip_accents(search_form(w))), t)))
    at = F.greatest(F.coalesce(F.array_position(hits, F.lit(True)), F.lit(0)).cast("int"), F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - words_shown // 3)
    body = F.array_join(F.slice(parts, start + 1, words_shown), " ")
    return F.concat(F.when(start > 0, "... ").otherwise(""), body,
                    F.when(start + words_shown < F.size(parts), " ...").otherwise(""))


def location(part: Column, page: Column, section: Column, kind: Column) -> Column:
    """`part > pN > section`, or the kind when nothing else is known."""
    def empty_to_null(c: Column) -> Column:
        return F.when(c == "", None).otherwise(c)

    path = F.concat_ws(" > ", empty_to_null(part), F.when(page > 0, F.concat(F.lit("p"), page.cast("string"))),
                       empty_to_null(section))
    return F.when(path == "", kind).otherwise(path)


#: What `register_sql_functions` adds to free SQL.
SQL_FUNCTIONS = frozenset(["fold", "search_form"])


def register_sql_functions(spark: SparkSession) -> None:
    """`fold` and `search_form` for free SQL, as SQL functions: they are inlined and stay inside code generation."""
    letters, targets = V.LETTER_FORMS
    digits, plain = V.ARABIC_DIGITS
    marks = V.DIACRITICS
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION fold(t STRING) RETURNS STRING RETURN
        coalesce(trim(regexp_replace(translate(regexp_replace(replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ'), '{marks}', ''),
                 '{letters}', '{targets}'), '(?U)\\\\s+', ' ')), '')""")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION search_form(t STRING) RETURNS STRING RETURN fold(translate(t, '{digits}', '{plain}'))")
