"""Personal data: plain identifiers, and disguised ones found in a normal form that keeps source offsets.

Plain (base) spans are the leftmost non-overlapping matches of each kind; matches that fail their test (octets up to 255,
13-19 digits with a Luhn sum, 9-15 digits) are dropped without another try. Disguises are undone by transducers that
write a normal form in segments, each knowing the source characters it came from: lookalike letters, full-width forms,
other scripts' digits and invisible characters; "at" / "dot" in brackets, spaced or as words; digits spelled out, in four
languages, wholly or in part. Matches in the
normal form are mapped back to source characters and added if no base span of their kind already covers them; base spans
stay as they are. Offsets count code points, ends are exclusive. Null and empty texts hold nothing.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import arrow_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT_BYTES = b"0123456789"

# Letters of other alphabets that look like Latin ones, written as pairs.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoikvptuxABEZHIKMNOPTYX"))
LOOKALIKES |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@", " ": " ", " ": " ", " ": " "}
INVISIBLE = "​‌‍⁠﻿­"
# Words for digits in English, German, French and Spanish.
SPELLED = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "null eins zwo drei vier fuenf sechs sieben acht neun",
                                   "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())}
# Words before "at" in prose, where "word at host.tld" names a place and no address.
PROSE = frozenset("""available hosted found find look looking looked see visit online us me you him her them it site website page here there is are was were be more read
arrive arrived live lives work works working meet register download join order ask sign posted published listed starts start begins one all not only""".split())
OTHER_DIGITS = "".join(f"{chr(i)}-{chr(i + 9)}" for i in range(128, 0x110000) if unicodedata.decimal(chr(i), None) == 0 and unicodedata.decimal(chr(i + 9), None) == 9)

DISGUISED = re.compile(f"[{''.join(LOOKALIKES)}{INVISIBLE}！-～𝐀-𝟿{OTHER_DIGITS}]")
_AT_WORDS, _DOT_WORDS = r"(?:at|ät|arroba|arobase|arobas|klammeraffe)", r"(?:dot|punkt|punto|point)"
_AT = rf"(?:\s*[\[({{<]\s*(?:{_AT_WORDS}|@)\s*[\])}}>]\s*)"
_DOT_SIGN = rf"\s*[\[({{<]\s*(?:{_DOT_WORDS}|\.)\s*[\])}}>]\s*"


def _mail(at: str, dot: str) -> re.Pattern:
    """Chains of parts joined by the given words and the bracketed and spaced signs; where an address starts with the chain,
    the groups `at` and `host` too. Every step is possessive and a chain is never entered again, so parts of any length and
    number are read once."""
    at, local = rf"(?:{_AT}|[ \t]+{at}[ \t]+|[ \t]*@[ \t]*)", rf"(?:{_DOT_SIGN}|[ \t]+{dot}[ \t]+|\.)"
    return re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]++(?:{local}[A-Za-z0-9_%+-]++)*+)(?:(?P<at>{at})"
                      rf"(?P<host>[A-Za-z0-9-]++(?:(?:{local}|[ \t]+\.[ \t]+)[A-Za-z0-9-]++)++))?+", re.I)


# "point" is a word of English prose ("at this point in"): it is a dot only beside the French word for the sign, or in brackets.
MAIL, MAIL_FR = _mail("(?:at|ät|arroba|klammeraffe)", "(?:dot|punkt|punto)"), _mail("arobase?", _DOT_WORDS)
MAIL_HINT = re.compile(rf"[\[({{<]\s*(?:{_DOT_WORDS}|\.)\s*[\])}}>]|[ \t](?:dot|punkt|punto)[ \t]|(?:[\[({{<]\s*(?:{_AT_WORDS}|@)\s*[\])}}>]\s*|[ \t](?:at|ät|arroba|klammeraffe)[ \t]+|[ \t]@[ \t]*|@[ \t]+)[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|[ \t]+\.)|@[A-Za-z0-9-]++[ \t]+\.", re.I)
MAIL_DOT = re.compile(rf"{_DOT_SIGN}|[ \t]+{_DOT_WORDS}[ \t]+|[ \t]+\.[ \t]+", re.I)
_NUMBER_WORD = r"(?>" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")"
_ENDS = rf"(?={_NUMBER_WORD}|[\W\d_]|\Z|{_DOT_WORDS})"
_ITEM = rf"(?:{_NUMBER_WORD}{_ENDS}|[0-9]{{1,19}}+(?={_NUMBER_WORD}|[\W_]|\Z|{_DOT_WORDS}))"
_NUMBER_DOT = rf"[ \t]*[\[({{<]?[ \t]*(?:{_DOT_WORDS}|\.)[ \t]*[\])}}>]?[ \t]*"
# Every step is possessive: a run is read once, however long.
NUMBERS = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|más|mas)[ \t]+|\+[ \t]?)?\(?{_ITEM}(?:(?:{_NUMBER_DOT}|[ \t]*(?:[-,/()][ \t]*){{0,3}}+){_ITEM})++", re.I)
NUMBER_PART = re.compile(rf"plus|más|mas|\+|{_NUMBER_DOT}|{_NUMBER_WORD}|[0-9]|[ \t,/()-]+", re.I)
DISGUISED_NUMBER = re.compile(rf"{_NUMBER_WORD}|{_DOT_WORDS}|[\[({{<][ \t]*\.|[ \t]\.[ \t]", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: linear, however long the runs of address characters are."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    raw = text.encode("utf-8", "surrogatepass")
    n_digits = len(raw) - len(raw.translate(None, DIGIT_BYTES))
    if n_digits >= 4 and "." in text:
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    if n_digits >= 13:
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if n_digits >= 9 and "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Normal:
    """A normal form written segment by segment, with the way back to source characters."""

    def __init__(self):
        self.parts: list[str] = []
        self.at: list[int] = []        # where each segment starts in the normal form
        self.source: list[tuple[int, int, bool]] = []    # its source span, and whether it is copied character by character
        self.length = 0

    def add(self, text: str, start: int, end: int, copied: bool) -> None:
        if text:
            self.at.append(self.length)
            self.parts.append(text)
            self.source.append((start, end, copied))
            self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        first, last = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a, _, copied = self.source[first]
        low = a + start - self.at[first] if copied else a
        a, b, copied = self.source[last]
        return low, a + end - self.at[last] if copied else b


def _one_char(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return unicodedata.normalize("NFKC", c)


def look_alike_form(text: str) -> Normal | None:
    """Letters, digits and signs that only look different, written plainly; None if there are none."""
    form, start = Normal(), 0
    for m in DISGUISED.finditer(text):
        form.add(text[start:m.start()], start, m.start(), True)
        form.add(_one_char(m[0]), m.start(), m.end(), False)
        start = m.end()
    if not start:
        return None
    form.add(text[start:], start, len(text), True)
    return form


def _rewritten(text: str, match: re.Match, rules) -> Normal:
    """The normal form of one match: each part that a rule knows is replaced, the rest copied."""
    form, at, end = Normal(), match.start(), match.end()
    pattern, write = rules
    for m in pattern.finditer(text, at, end):
        form.add(text[at:m.start()], at, m.start(), True)
        form.add(write(m), m.start(), m.end(), False)
        at = m.end()
    form.add(text[at:end], at, end, True)
    return form


def _digits(m: re.Match) -> str:
    low = m[0].lower()
    if low in SPELLED:
        return SPELLED[low]
    if low in ("plus", "más", "mas", "+"):
        return "+"
    return low if low.isdigit() else "." if "." in low or any(c.isalpha() for c in low) else ""


def _spaced_digits(m: re.Match) -> str:
    """As _digits, but separators beside digits stay: a number before an address is not part of it."""
    out = _digits(m)
    beside = m.string[max(m.start() - 1, 0):m.start()] + m.string[m.end():m.end() + 1]
    return out or (" " if any(c in "0123456789" for c in beside) else "")


NUMBER_RULES, SPACED_RULES = (NUMBER_PART, _digits), (NUMBER_PART, _spaced_digits)


def _mail_form(text: str, m: re.Match) -> Normal | None:
    """The plain address of a match; None for prose: spaced signs and a bare "at" need a host that ends in letters."""
    form = Normal()
    host = MAIL_DOT.sub(".", m["host"])
    if m["at"] != "@" and host == m["host"] or " ." in m["host"]:
        top = host.rpartition(".")[2]
        if not (top.isalpha() and len(top) > 1) or m["at"].strip().lower() == "at" and m["local"].lower() in PROSE:
            return None
    for name in ("local", "host"):
        at = m.start(name)
        for d in MAIL_DOT.finditer(text, at, m.end(name)):
            form.add(text[at:d.start()], at, d.start(), True)
            form.add(".", d.start(), d.end(), False)
            at = d.end()
        form.add(text[at:m.end(name)], at, m.end(name), True)
        if name == "local":
            form.add("@", m.start("at"), m.end("at"), False)
    return form


def disguised_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans found in the normal forms, as source offsets."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    outer = None if text.isascii() else look_alike_form(text)
    plain = outer.text if outer else text
    back = outer.back if outer else (lambda a, b: (a, b))
    if outer:
        for kind, spans in plain_spans(plain).items():
            found[kind] += [back(*s) for s in spans]
    low = plain.lower()
    for pattern, hinted in ((MAIL, MAIL_HINT.search(plain)), (MAIL_FR, "arobas" in low)):
        for m in pattern.finditer(plain) if hinted else ():
            form = _mail_form(plain, m) if m["host"] else None
            if form:
                found["email"] += [back(*form.back(*s)) for s in _emails(form.text)]
    for m in NUMBERS.finditer(plain):
        if not DISGUISED_NUMBER.search(m[0]):
            continue
        form = _rewritten(plain, m, NUMBER_RULES)
        for kind, spans in plain_spans(form.text).items():
            found[kind] += [back(*form.back(*s)) for s in spans]
        if "." in form.text:
            form = _rewritten(plain, m, SPACED_RULES)
            found["ip"] += [back(*form.back(*s)) for s in plain_spans(form.text)["ip"]]
    return found


def spans(text: str | None) -> tuple[dict[str, list], dict[str, list]]:
    """Base spans, and all spans: base ones and those added by the normal forms, both sorted per kind."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base = plain_spans(text)
    every = {}
    for kind, added in disguised_spans(text).items():
        new = {s for s in added if not any(a <= s[0] and s[1] <= b for a, b in base[kind])}
        every[kind] = sorted(set(base[kind]) | new)
    return base, every


def listed(found: dict[str, list]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in found[kind])


def redacted(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    if not text:
        return text
    _, every = spans(text)
    marks = sorted((a, b, kind) for kind in KINDS for a, b in every[kind])
    out, at = [], 0
    for a, b, kind in marks:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if marks else text


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of struct kind, start, end), one row per row."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])

    def run(part):
        both = [spans(t) for t in part.column("text").to_pylist()]
        flat = lambda found: [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]]
        return {"doc_id": part.column("doc_id"), "base": [flat(b) for b, _ in both], "spans": [flat(e) for _, e in both]}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(arrow_rows(run, schema), f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame) -> DataFrame:
    """All columns of docs, with the spans of `text` replaced by their kinds."""
    from .features import pa_fields
    source = docs.withColumn("text", F.col("text").cast("string"))
    schema = pa.schema(pa_fields(source, source.columns))

    def run(part):
        texts = [redacted(t) for t in part.column("text").to_pylist()]
        return {c: texts if c == "text" else part.column(c) for c in part.schema.names}
    return source.mapInArrow(arrow_rows(run, schema), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema))
