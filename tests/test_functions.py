import unicodedata

import pytest
from pyspark.sql import functions as F

from trustframe.functions import dates as D, names as N, numbers as M, text as X
from trustframe.functions.entities import entities_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, values, fn, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_fold_unifies_case_marks_letters_and_separators(spark):
    got = each(spark, ["Order_ID ", "القاهرة", "القَاهِره", "مــصر", "Straße-1", None], X.fold)
    assert got == ["order id", "القاهره", "القاهره", "مصر", "strasse 1", ""]


def test_arabic_stem(spark):
    assert each(spark, ["والقاهره", "بالقاهره", "للقاهره", "القاهره", "the", "و"], X.arabic_stem) == [
        "قاهره", "قاهره", "قاهره", "قاهره", "the", "و"]


def test_index_tokens_split_on_punctuation_and_drop_accents(spark):
    assert one(spark, X.index_tokens(F.lit("Thé, order-id: café! 12.5"))) == ["the", "order", "id", "cafe", "12", "5"]


def test_parse_number(spark):
    got = each(spark, ["1,234.50", "(300)", "12%", "٣٥٠٠", "P-12", "1.2.3", "", "-5"], M.parse_number)
    assert got == [1234.5, -300.0, 0.12, 3500.0, None, None, None, -5.0]


def test_number_repair(spark):
    assert each(spark, ["1,234", "12", "1,234.50", "x", "007"], M.number_repair) == ["1234", None, "1234.5", None, "7"]


def test_totals_labels(spark):
    texts = ["Total", " grand total ", "Cairo Total", "Total Q1", "إجمالي القاهرة", "totally", "a total of many words that go on and on", "sum"]
    assert each(spark, texts, X.is_totals_label) == [True, True, True, True, True, False, False, True]


def test_null_tokens(spark):
    assert each(spark, ["N/A", " none ", "--", "nothing"], X.is_null_token) == [True, True, True, False]


@pytest.mark.parametrize("serial,kind,is1904,want", [
    (59.0, "date", False, "1900-02-28"), (60.0, "date", False, "1900-02-29"), (61.0, "date", False, "1900-03-01"),
    (0.0, "date", False, "1900-01-00"), (45000.5, "datetime", False, "2023-03-15 12:00:00"), (0.25, "time", False, "06:00:00"),
    (1.5, "time", False, "36:00:00"), (0.0, "date", True, "1904-01-01"), (-1.0, "date", False, "-1")])
def test_serials(spark, serial, kind, is1904, want):
    assert one(spark, D.serial_to_iso(F.lit(serial), F.lit(kind), F.lit(is1904))) == want


def test_number_formats(spark):
    formats = ["yyyy-mm-dd", "d/m/yy h:mm", "[h]:mm:ss", "General", "0.00E+00", '#,##0 "days"', "mmm yy", "0.00", None]
    assert each(spark, formats, D.format_class) == ["date", "datetime", "time", None, None, None, "date", None, None]


def test_addresses_and_letters(spark):
    assert each(spark, ["A", "Z", "AA", "XFD"], N.column_number) == [1, 26, 27, 16384]
    assert each(spark, [1, 26, 27, 702, 703, 16384], N.column_letters, "int") == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    boxes = each(spark, ["$B$2:D3", "AA10", "Sheet1!A1"], N.parse_address)
    assert [None if b is None else tuple(b) for b in boxes] == [(2, 2, 3, 4), (10, 27, 10, 27), None]


def test_names(spark):
    assert each(spark, ["unit price (EGP)", "__x__", "2024", "5.0"], N.clean_header) == ["unit_price_EGP", "x", "2024", "5"]
    assert each(spark, ["2024 data", "", "sqlite_x"], N.table_identifier) == ["t_2024_data", "sheet", "t_sqlite_x"]
    assert each(spark, ["amount_usd", "price", "rate", "سعر جنيه"], N.name_currency) == ["USD", None, None, "EGP"]
    assert each(spark, ["notes", "order_no", "unit price"], lambda c: N.has_word(c, ["no", "price"])) == [False, True, True]


def found_in(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", entities_of(F.col("text")).alias("e")).orderBy("i").collect()
    return [[(e.kind, e.value, e.normalized, e.start, e.end) for e in r.e or []] for r in rows]


def test_entities_of_an_arabic_sentence(spark):
    text = "الفاتورة INV-000123 بتاريخ ١٥/٠٣/٢٠٢٤ بمبلغ 4,250.50 جنيه وخصم 12.5% راسل a.b@Example.com أو 01001234567"
    found = [(k, n) for k, _, n, _, _ in found_in(spark, text)[0]]
    assert found == [("code", "INV-000123"), ("date", "2024-03-15"), ("money", "4250.50 EGP"), ("percent", "12.5%"),
                     ("email", "a.b@example.com"), ("phone", "01001234567")]


def test_entities_month_names_and_overlaps(spark):
    assert [(k, n) for k, _, n, _, _ in found_in(spark, "due 5 March 2024, Apr 6, 2023 and 7 يناير 2022")[0]] == [
        ("date", "2024-03-05"), ("date", "2023-04-06"), ("date", "2022-01-07")]
    mail, bad, none, empty, many = found_in(spark, "INV-2024@mail.example.com", "99/99/2024", None, "", "🙂 $1,250.5 is 12 usd, 31.02.2024; USD 7 on 01/02/2023 or 2023-2-1 +20 1001234567 A12/3; le 5")
    assert [k for k, *_ in mail] == ["email"] and bad == none == empty == []
    assert [(k, v, n) for k, v, n, _, _ in many] == [
        ("money", "$1,250.5", "1250.50 USD"), ("money", "12 usd", "12.00 USD"), ("money", "USD 7", "7.00 USD"), ("date", "01/02/2023", "2023-02-01"),
        ("date", "2023-2-1", "2023-02-01"), ("phone", "+20 1001234567", "+201001234567"), ("code", "A12/3", "A12/3"), ("money", "le 5", "5.00 EGP")]
    assert all("🙂 $1,250.5 is 12 usd, 31.02.2024; USD 7 on 01/02/2023 or 2023-2-1 +20 1001234567 A12/3; le 5"[s:e] == v for _, v, _, s, e in many)


def test_snippet_and_location(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = one(spark, X.snippet(F.lit(text), F.array(F.lit("w40"))))
    assert got.startswith("... w30 ") and got.endswith("w59") and len(got.split()) == 31
    assert one(spark, X.location(F.lit("a.txt"), F.lit(3), F.lit("Intro"), F.lit("paragraph"))) == "a.txt > p3 > Intro"
    assert one(spark, X.location(F.lit(""), F.lit(None).cast("int"), F.lit(""), F.lit("paragraph"))) == "paragraph"


def test_token_estimate(spark):
    assert each(spark, ["abcdefg", "", "مرحبا"], X.token_estimate) == [2, 0, 5]


def test_displays_and_addresses(spark):
    assert each(spark, [5.0, 1234567.891, None], M.display_number, "double") == ["5", "1,234,567.89", "-"]
    assert each(spark, [float("nan"), float("inf"), 2.0, 2.5], M.printable, "double") == ["nan", "inf", "2", "2.5"]
    assert one(spark, N.cell_address(F.lit(3), F.lit(28))) == "AB3"
    stamps = ["1899-12-30 06:30:00", "2024-01-02 00:00:00", "2024-01-02 03:04:05"]
    assert each(spark, stamps, lambda c: D.stamp_to_iso(c.cast("timestamp"))) == ["06:30:00", "2024-01-02", "2024-01-02 03:04:05"]


def test_sql_functions_equal_the_columns(spark):
    X.register_sql_functions(spark)
    frame = spark.createDataFrame([("Order_ID  ـ القَاهرة ٣",), (None,)], "t string")
    got = frame.select(F.expr("fold(t)").alias("a"), X.fold(F.col("t")).alias("b"), F.expr("search_form(t)").alias("c"), X.search_form(F.col("t")).alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in got.collect())


def test_case_folding_is_unicode_s(spark):
    """Every letter alone, and words with several foldings, against Python's case folding."""
    letters = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L"]
    texts = [f"a{x}b" for x in letters] + ["STRASSE Straße ẞ", "ﬃ ŉ ΐ ᾳ ᏸ", "ΟΔΥΣΣΕΥΣ", "", "İstanbul"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.casefold(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got if r.f != r.t.casefold()} == {}
    assert spark.range(1).select(X.casefold(F.lit(None).cast("string")).alias("f")).first().f is None


def test_entities_are_found_in_one_pass(spark):
    """No cut by a pattern, which would be compiled for every text, but for texts that hold the mark; digits are read once."""
    text = "pay $1,250.5 by 2024-03-05, INV-000123"
    plain, marked = found_in(spark, text, text.replace(", ", ",\x00"))
    assert [(k, n) for k, _, n, _, _ in plain] == [(k, n) for k, _, n, _, _ in marked] == [("money", "1250.50 USD"), ("date", "2024-03-05"), ("code", "INV-000123")]
    assert [(text[s:e], v) for _, v, _, s, e in plain] == [(v, v) for _, v, _, _, _ in plain] and marked[-1][3:] == plain[-1][3:]
    shown = spark.createDataFrame([(text,)], "text string").select(entities_of(F.col("text")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("translate(") == 1


def test_index_tokens_of_plain_texts_are_those_of_the_search_form(spark):
    texts = ["Thé_Straße-x İs ﬁne ŉ ΌΣΟΣ ½ Ⅷ", "aًb ٣۴ والكتاب_x", "café “B”  KÅ", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    form = F.array_remove(F.split(X.strip_accents(X.index_text(F.col("t"))), r"[^\p{L}\p{N}\p{Co}]+"), "")
    assert d.filter(~X.index_tokens(F.col("t")).eqNullSafe(form)).count() == 0


def test_once_computes_a_column_once(spark):
    r = spark.range(5).select(F.explode(X.once(F.rand(), lambda x: F.array(F.struct(x.alias("a"), x.alias("b"))))).alias("s")).select("s.*")
    assert r.filter("a != b").count() == 0 and r.count() == 5
