"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with the reference of its
language by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). The reference is the median share of
each class among the documents of the language that pass the base rules: each document counts once, and junk below half of
them does not become the norm. A language with few such documents is compared with all languages (common words by their
place in the lists, which run from frequent to rare). Below the minimum lengths a histogram says little, and its distance
is null and fails nothing.

Base rules come first: a document with under 20 words, or with over 30 % of its words in 8-word windows that occur twice or
more in it, is rejected. Null and empty texts have no words and so are rejected. A null `lang` is a language of its own; a
language without a list of common words is judged by its characters alone. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "was", "with", "as", "be", "by", "this", "not", "are", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
# Character classes, each counted by what is left without it. Lower-case letters, spaces and line feeds, most
# of a text, go first, so that the others read little. What is left at the end is the last class.
PLAIN = r"[a-z\x20\n]+"
CLASSES = [r"[\x09-\x0D]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]+"""]
SYMBOLS_AT = 3
N_CLASSES = len(CLASSES) + 2
WHITE_CHARS = " \t\n\x0b\x0c\r"
WHITE = r"[\x20\x09-\x0D]+"

MIN_CHARS = 200            # of a text, for its character classes to be judged
MIN_COMMON = 20            # common words in a text, for their histogram to be judged
MAX_CHAR_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.62
MIN_WORDS = 20
MAX_REPEATED = 30          # per cent of the words
WINDOW = 8
MIN_REFERENCE = 30         # judged documents of a language, for a reference of its own
STEPS = 10_000             # of a share, in the references


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _pairs(a: Column, by: int) -> Column:
    """Hashes of each element with the one `by` places on; `by` elements less."""
    return F.slice(F.zip_with(a, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.size(a) - by, F.lit(0)))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (as a struct `doc`), the base measures and the two histograms of each row.

    Hashes of 2, 4, then 8 words stand for the windows. Lambda functions run outside generated code, where every projection copies its columns: there are few steps, and each
    drops what the next does not need.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("_"))
    rows = docs.select(kept.alias("doc"), F.coalesce(lang, F.lit("")).alias("language"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    inner = F.btrim("t", F.lit(WHITE_CHARS))
    w = F.col("w")
    rows = rows.select("doc", "language", "t", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE)).alias("w"))

    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    rows = rows.select(
        "doc", "language", F.size(w).cast("long").alias("n_words"), F.char_length("t").alias("length"), F.regexp_replace("t", PLAIN, "").alias("rest"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")).alias("spaced"), F.when(F.size(w) >= WINDOW, _pairs(w, 1)).alias("h"))

    lists = F.create_map(*[x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*[F.lit(f" {v} ") for v in ws]))])
    mine = F.coalesce(F.element_at(lists, F.col("language")), F.array().cast("array<string>"))
    commons = F.transform(mine, lambda x: ((F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), x, F.lit("")))) / F.octet_length(x)).cast("long"))
    rest, sizes = F.col("rest"), [F.char_length("rest")]
    for c in CLASSES:
        rest = F.regexp_replace(rest, c, "")
        sizes.append(F.char_length(rest))
    word_chars = F.when(F.col("n_words") > 0, F.char_length("spaced") - 2 * F.col("n_words")).otherwise(0).cast("long")
    rows = rows.select("doc", "language", "n_words", "length", "n_dup_lines", word_chars.alias("word_chars"), F.array(*sizes).alias("sizes"), commons.alias("commons"),
                       _pairs(F.col("h"), 2).alias("h"))
    rows = rows.withColumn("windows", _pairs(F.col("h"), 4)).drop("h")
    counted = [(F.col("sizes")[i] - F.col("sizes")[i + 1]).cast("long") for i in range(len(CLASSES))] + [F.col("sizes")[len(CLASSES)].cast("long")]
    white = F.col("length") - F.col("word_chars")
    lower = F.col("word_chars") - (F.col("sizes")[0] - counted[0])
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select("doc", "language", "n_words", "word_chars", counted[SYMBOLS_AT].alias("n_symbols"), "n_dup_lines", F.array(lower, white, *counted[1:]).alias("chars"), "commons",
                       F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed)).alias("s"))
    # from here on only texts with two equal windows have work: equal hashes stand side by side
    s = F.col("s")
    same = F.filter(s, lambda e, i: ((i > 0) & F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
    rows = rows.withColumn("at", F.sort_array(F.transform(same, lambda e: e["i"]))).drop("s")
    following = F.concat(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
    gaps = F.zip_with("at", following, lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))).cast("long"))
    return rows.withColumn("n_repeat_words", F.coalesce(_total(gaps), F.lit(0).cast("long"))).drop("at")


def jensen_shannon(a: Column, b: Column) -> Column:
    """Distance of two histograms given as arrays of counts; null if one has no counts."""
    p = F.transform(a, lambda x: x / F.nullif(_total(a), F.lit(0)))
    q = F.transform(b, lambda x: x / F.nullif(_total(b), F.lit(0)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.when((_total(a) > 0) & (_total(b) > 0), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))))


def judged_chars(chars: Column) -> Column:
    """Whether a text is long enough for its character classes to be judged."""
    return _total(chars) >= MIN_CHARS


def judged_commons(commons: Column) -> Column:
    return _total(commons) >= MIN_COMMON


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """One row per language, and one with a null language for all: `kind` (chars or commons), n_docs and twice the medians, `ref`.

    Only rows that pass the base rules and are long enough count, each once, whatever its length. Shares are counted in
    steps of 1/STEPS, so that at most STEPS + 1 counts per class meet in a median, and sums are whole and free of order.
    """
    def shares(name: str) -> Column:
        a = F.col(name)
        steps = F.transform(a, lambda x, i: F.struct(F.lit(name).alias("kind"), i.alias("i"), F.round(x * STEPS / F.nullif(_total(a), F.lit(0))).cast("int").alias("step")))
        return F.when(judged_chars(a) if name == "chars" else judged_commons(a), steps)
    places = F.explode(F.flatten(F.array_compact(F.array(shares("chars"), shares("commons")))))
    counts = measured.filter(~base_failed()).select("language", places.alias("p")).groupBy("language", "p.kind", "p.i", "p.step").agg(F.count(F.lit(1)).alias("n"))
    median = F.percentile("step", F.lit(0.5), F.col("n"))
    counts = materialize(counts, "quality-shares")
    medians = counts.groupBy("language", "kind", "i").agg(median.alias("m"), F.sum("n").alias("n"))
    every = counts.groupBy("kind", "i").agg(median.alias("m"), F.sum("n").alias("n")).withColumn("language", F.lit(None).cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return medians.unionByName(every).groupBy("language", "kind").agg(F.max("n").alias("n_docs"), F.transform(ordered, lambda x: (2 * x["m"]).cast("long")).alias("ref"))


def judge(docs: DataFrame, keep: list[str] | None = None, max_char_distance: float = MAX_CHAR_DISTANCE,
          max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """`doc` (struct of the kept columns), the measures, base_failed, char_distance, word_distance and kept, one row per row.

    The measures are written once; the references are a row per language and kind, joined by Spark's own choice. A language
    with under MIN_REFERENCE documents is compared with all languages: one row, read to the driver.
    """
    measured = materialize(measures(docs, docs.columns if keep is None else keep), "quality-measures")
    refs = materialize(references(measured), "quality-references")
    every = {r.kind: r.ref for r in refs.filter("language IS NULL").collect()}
    rows = measured
    for kind in ("chars", "commons"):
        mine = refs.filter((F.col("kind") == kind) & F.col("language").isNotNull() & (F.col("n_docs") >= MIN_REFERENCE))
        rows = rows.join(mine.select("language", F.col("ref").alias(f"ref_{kind}")), "language", "left")
        common = F.array(*map(F.lit, every[kind])).cast("array<long>") if kind in every else F.lit(None).cast("array<long>")
        rows = rows.withColumn(f"ref_{kind}", F.coalesce(f"ref_{kind}", common))
    chars = F.when(judged_chars(F.col("chars")), jensen_shannon(F.col("chars"), F.col("ref_chars")))
    ref = F.slice("ref_commons", 1, F.greatest(F.size("commons"), F.lit(1)))
    commons = F.when(judged_commons(F.col("commons")), jensen_shannon(F.col("commons"), ref))
    rows = rows.withColumn("char_distance", chars).withColumn("word_distance", commons).withColumn("base_failed", base_failed())
    odd = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance)
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd).drop("ref_chars", "ref_commons")
