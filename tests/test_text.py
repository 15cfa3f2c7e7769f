import random

import pytest
from pyspark.sql import functions as F

from trustframe.operators import blocks as B, grounding as G, lineage as L, packing as P, search as S, search_index as X


def blocks_of(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return B.text_blocks(docs, F.col("id"), F.col("text"))


def test_markdown(spark):
    md = "intro\n\n# Prices\ntext below\n\n### Deep\n\npara\n\n## 2024\n\n|a|b|\n|---|---|\n|x|1|\n|y|2|\n\nend"
    docs = spark.createDataFrame([("d", md)], "id string, text string")
    got = [(r.ord, r.kind, r.section, r.level, r.text) for r in B.markdown_blocks(docs, F.col("id"), F.col("text")).orderBy("ord").collect()]
    assert got == [(1, "paragraph", "", None, "intro"), (2, "heading", "", 1, "Prices"), (3, "paragraph", "Prices", None, "text below"),
                   (4, "heading", "Prices", 3, "Deep"), (5, "paragraph", "Prices > Deep", None, "para"), (6, "heading", "Prices", 2, "2024"),
                   (7, "paragraph", "Prices > 2024", None, "end")]
    values = B.typed_document_values(B.document_tables(B.markdown_cells(docs, F.col("id"), F.col("text")))).orderBy("row", "col").collect()
    assert [(v.row, v.header, v.kind, v.num, v.txt) for v in values] == [
        (2, "a", "text", None, "x"), (2, "b", "int", 1.0, None), (3, "a", "text", None, "y"), (3, "b", "int", 2.0, None)]


def page_parts(spark, *pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    parts = B.html_parts(frame, F.col("id"), F.col("html")).collect()
    blocks = [(int(r.source_id), r.kind, r.level, r.section, r.text) for r in sorted(parts, key=lambda r: (int(r.source_id), r.ord)) if r.what == "block"]
    cells = [(int(r.source_id), r.table_no, r.section, r.row, r.col, r.text) for r in sorted(parts, key=lambda r: (int(r.source_id), r.ord)) if r.what == "cell"]
    return blocks, cells


def test_html_blocks_and_tables(spark):
    blocks, cells = page_parts(spark, "<html><head><title>t</title></head><body><h1>Top</h1><p>a &amp; b<ul><li>one</li></ul>"
                               "<table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><h2>Sub</h2>tail</body></html>")
    assert [b[1:] for b in blocks] == [("heading", 1, "", "Top"), ("paragraph", None, "Top", "a & b"), ("list_item", None, "Top", "one"),
                                       ("heading", 2, "Top", "Sub"), ("paragraph", None, "Top > Sub", "tail")]
    assert [c[3:] for c in cells] == [(1, 1, "x"), (1, 2, "y"), (2, 1, "1"), (2, 2, "2")]


def test_html_corner_cases(spark):
    blocks, cells = page_parts(
        spark, None, "", "plain &lt;p&gt; text &eacute;&#33;", "<script>var a = '<p>no</p>';</script>a<b>b</b>c<!-- <p>no</p> --><style>p{}</style> d",
        "<li><p>inner</p></li><li></li>after", "<P CLASS='a>b'>one<BR/>two<hr>three", "<h3>deep</h3><h2>up</h2><h3>down</h3>x<header>y</header>",
        "<p>cut <script>never closed", "1 < 2 and <em>3 > 2</em>",
        "<h1>t</h1><table><tr><td>lost<td>a</td><td><p>b</p> &amp; c</td></tr><tr><td>open row</td></table>mid<table><tr><td>z</td></tr></table><TABLE><tr><td>open table</td></tr>")
    got = {}
    for i, *block in blocks:
        got.setdefault(i, []).append(tuple(block))
    par = lambda *texts: [("paragraph", None, "", t) for t in texts]
    assert got == {2: par("plain <p> text é!"), 3: par("abc d"), 4: par("inner") + [("list_item", None, "", "after")], 5: par("one", "twothree"),
                   6: [("heading", 3, "", "deep"), ("heading", 2, "deep", "up"), ("heading", 3, "deep > up", "down"), ("paragraph", None, "deep > up > down", "xy")],
                   7: par("cut"), 8: par("1 < 2 and 3 > 2"), 9: [("heading", 1, "", "t"), ("paragraph", None, "t", "mid")]}
    assert cells == [(9, 1, "t", 1, 1, "a"), (9, 1, "t", 1, 2, "b & c"), (9, 2, "t", 1, 1, "z")]


def test_stored_index_equals_a_scan_and_reads_only_itself(spark, tmp_path):
    rng = random.Random(4)
    words = ["red", "redder", "blue", "green", "bluebird", "stone", "tree", "قلم"]
    blocks = blocks_of(spark, [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(80)] + [""])
    blocks = blocks.withColumn("kind", F.when(F.col("source_id").cast("int") % 2 == 0, "even").otherwise("odd"))
    X.build_index(blocks, str(tmp_path / "index"))
    for kind, document in ((None, None), ("even", None), (None, "7"), ("odd", "7")):
        want = [(r.block_id, r.snippet, r.location, round(r.score, 9)) for r in S.search(blocks, "red blue", 15, kind, document).collect()]
        for limit in (15, X.FETCH + 1):
            got = X.search_index(spark, str(tmp_path / "index"), "red blue", limit, kind, document).collect()
            assert [(r.block_id, r.snippet, r.location, round(r.score, 9)) for r in got][:15] == want and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert X.search_index(spark, str(tmp_path / "index"), "nowhere").collect() == []
    plan = X.search_index(spark, str(tmp_path / "index"), "red", 5)._jdf.queryExecution().toString()
    ranked = X.ranked(spark, str(tmp_path / "index"), ["red"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(block_id" in plan and "StringStartsWith(token,red)" in ranked and f"{tmp_path}/index/blocks" not in ranked


def test_document_tables_need_two_rows_and_columns(spark):
    cells = spark.createDataFrame([("d", 1, "", 1, 1, "only"), ("d", 1, "", 2, 1, "one column"), ("d", 2, "", 1, 1, "h"), ("d", 2, "", 1, 2, "k"),
                                   ("d", 2, "", 2, 1, ""), ("d", 2, "", 2, 2, ""), ("d", 2, "", 3, 1, "v"), ("d", 2, "", 3, 2, "")], B.CELL)
    got = {(r.table_no, r.row) for r in B.document_tables(cells).collect()}
    assert got == {(2, 1), (2, 2)}


def test_typing_of_document_columns(spark):
    rows = [("d", 1, "", 1, 1, "n"), ("d", 1, "", 1, 2, "m")]
    rows += [("d", 1, "", i + 2, 1, "x" if i == 0 else str(i)) for i in range(10)] + [("d", 1, "", i + 2, 2, "x" if i < 3 else "1.5") for i in range(10)]
    kinds = {r.header: r.kind for r in B.typed_document_columns(spark.createDataFrame(rows, B.CELL)).collect()}
    assert kinds == {"n": "mixed", "m": "text"}


@pytest.mark.parametrize("query,want", [("oil units", ["0#1"]), ("القاهره", ["1#1"]), ("uni", ["0#1", "2#1"])])
def test_search_words_prefixes_and_spelling_variants(spark, query, want):
    b = blocks_of(spark, ["please send 20 oil units", "زيارة القاهرة غدا", "a unit is one", "nothing"])
    hits = S.search(b, query)
    assert sorted(r.block_id for r in hits.collect()) == want
    assert sorted(r.block_id for r in S.scan_search(b, query).collect()) == want


def test_stored_index_gives_the_same_ranking(spark, tmp_path):
    rng = random.Random(2)
    b = blocks_of(spark, [" ".join(rng.choice(["red", "reddish", "blue", "green"]) for _ in range(rng.randint(1, 30))) for _ in range(40)])
    S.write_index(b, str(tmp_path))
    stored = S.search(b, "red blue", 50, posting_rows=spark.read.parquet(f"{tmp_path}/postings"), lengths=spark.read.parquet(f"{tmp_path}/lengths"))
    direct = S.search(b, "red blue", 50)
    assert [(r.block_id, round(r.score, 9)) for r in stored.collect()] == [(r.block_id, round(r.score, 9)) for r in direct.collect()]


def test_empty_search_is_an_error(spark):
    with pytest.raises(ValueError):
        S.search(blocks_of(spark, ["x"]), "  ")


def test_read_stops_at_the_limit_but_shows_one_block(spark):
    b = blocks_of(spark, ["a" * 50 + "\n\n" + "b" * 30 + "\n\n" + "c" * 30])
    assert [r.ord for r in S.read(b, "0", max_chars=85).orderBy("ord").collect()] == [1, 2]
    assert [r.ord for r in S.read(b, "0", max_chars=10).collect()] == [1]
    assert [r.ord for r in S.read(b, "0", block=2, around=1).orderBy("ord").collect()] == [1, 2, 3]


def test_grounded_records(spark):
    blocks = blocks_of(spark, ["Invoice of 12 March 2024: 1,250.00 EGP for 20 units"])
    quote = "12 March 2024: 1,250.00 EGP"
    rows = [(0, "amount", "1250", "0#1", quote), (0, "day", "2024-03-12", "0#1", quote), (1, "amount", "999", "0#1", quote),
            (2, "amount", "1250", "0#1", "13 March"), (3, "amount", "1250", None, quote), (4, "bad-name", "1250", "0#1", quote),
            (5, "amount", "1250", "9#9", quote), (6, "note", None, "0#1", quote), (7, "_x", "20", "0#1", quote)]
    checked = G.check_fields(spark.createDataFrame(rows, "record_no long, field string, value string, block_id string, quote string"), blocks)
    reasons = {(r.record_no, r.field): r.reason for r in checked.collect()}
    assert reasons[(0, "amount")] is None and reasons[(0, "day")] is None and reasons[(6, "note")] is None
    assert reasons[(1, "amount")] == "value does not appear in the quote" and reasons[(2, "amount")] == "quote not found in that block"
    assert reasons[(3, "amount")].startswith("missing source") and reasons[(5, "amount")] == "no such block"
    assert reasons[(4, "bad-name")] == reasons[(7, "_x")] == "invalid field name"
    good = G.as_records(G.accepted(checked), ["amount", "day"]).filter("record_no = 0").first()
    assert (good.amount, good.day) == ("1250", "2024-03-12")


def test_upsert_replaces_by_key_and_grows_the_schema(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c", True), (3, "d", False)], "id int, x string, y boolean")
    assert sorted((r.id, r.x, r.y) for r in G.upsert(old, new, "id").collect()) == [(1, "a", None), (2, "c", True), (3, "d", False)]


@pytest.mark.parametrize("seed", range(3))
def test_budget_matches_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    data = [(p, i, rng.choice([1, 2, 3, 5, 8, 40, 200, 5000])) for p in range(4) for i in range(rng.choice([0, 50, 800]) + 5)]
    frame = spark.createDataFrame(data, "pack int, at int, s long")
    got = {(r.pack, r["at"]) for r in P.fitting_items(frame, ["pack"], ["at"], F.col("s"), 300, 17).collect()}
    want = set()
    for p in range(4):
        left = 300 - 17
        for _, i, s in sorted(x for x in data if x[0] == p):
            if s <= left:
                want.add((p, i))
                left -= s
    assert got == want


def test_pack_hash_depends_on_order_and_content(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "p int, i int, t string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "x")], "p int, i int, t string")
    one, two = (P.pack_hash(df, ["p"], ["i"], "t").first().hash for df in (a, b))
    assert one != two and one == P.pack_hash(a.orderBy(F.desc("i")), ["p"], ["i"], "t").first().hash


def test_formula_references(spark):
    cases = {"='Raw Data'!D2*1.14": [(None, "Raw Data")], "=SUM(Jan!A:A)+[Sales.xlsx]Feb!B1": [(None, "Jan"), ("Sales.xlsx", "Feb")],
             "='It''s'!A1": [(None, "It's")], '=IF(A1="x!y",1,0)': [], "=A1+B2*R[1]C": [], "=[1]Prices!A1": [("1", "Prices")],
             "=Data!A1+Data!B1": [(None, "Data")], r"='C:\d\[B k.xlsx]My Sheet'!R1C1": [("B k.xlsx", "My Sheet")], None: []}
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(cases)], "i int, f string")
    got = [[tuple(x) for x in r.r] for r in frame.select("i", L.formula_refs(F.col("f")).alias("r")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_accepted_fields_are_checked_once(spark):
    blocks = spark.createDataFrame([("b", "s", "paid 12.50 EGP")], "block_id string, source_id string, text string")
    rows = [(1, "amount", "12.50", "b", "paid 12.50 EGP"), (2, "amount", "9", "b", "paid 12.50 EGP"), (2, "unit", "EGP", "b", "12.50 EGP"), (None, "amount", "12.50", "b", "paid 12.50")]
    taken = G.accepted(G.check_fields(spark.createDataFrame(rows, "record_no long, field string, value string, block_id string, quote string"), blocks))
    assert "translate(" not in taken._jdf.queryExecution().optimizedPlan().toString()      # read back, not checked anew
    assert sorted((r.record_no or 0, r.field, r.value) for r in taken.collect()) == [(0, "amount", "12.50"), (1, "amount", "12.50")]


def test_index_totals_count_blocks_without_words(spark, tmp_path):
    from trustframe.operators import search_index as X

    rows = [("a#1", "a", "text", "", 1, "", "one two two"), ("b#1", "b", "text", "", 1, "", None), ("c#1", "c", "text", "", 1, "", "..."), ("a#1", "a", "text", "", 1, "", "one two two")]
    blocks = spark.createDataFrame(rows, "block_id string, source_id string, kind string, part string, page int, section string, text string")
    X.build_index(blocks, str(tmp_path / "index"))
    assert tuple(spark.read.parquet(str(tmp_path / "index" / "totals")).first()) == (4, 6)


def test_index_postings_are_counted_in_their_row_and_never_shuffled(spark, tmp_path, monkeypatch):
    import glob
    import os
    from collections import Counter

    import pyarrow.parquet as pq
    from trustframe.operators import search_index as X

    plans, stored = {}, X.store

    def noted(df, path, **options):
        plans[os.path.basename(path)] = df._jdf.queryExecution().executedPlan().toString()
        stored(df, path, **options)

    monkeypatch.setattr(X, "store", noted)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["one", "two", "Two", "three3", "ÉTÉ", "قلم", "--"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "...", "x " * 500]
    blocks = blocks_of(spark, texts)
    X.build_index(blocks.union(blocks.filter("source_id = '7'")), str(tmp_path / "index"))
    assert "Exchange" not in plans["postings"] and "Exchange" in plans["blocks"]
    words = {r.block_id: r.w for r in blocks.select("block_id", X.index_tokens(X._searched(blocks)).alias("w")).collect()}
    got = Counter()
    for r in spark.read.parquet(str(tmp_path / "index" / "postings")).collect():
        got[r.token, r.block_id] += r.tf
        assert r.length == len(words[r.block_id]) and (r.source_id, r.kind) != (None, None)
    twice = {r.block_id for r in blocks.filter("source_id = '7'").collect()}
    assert got == Counter({(t, b): n * (2 if b in twice else 1) for b, w in words.items() for t, n in Counter(w).items()})
    files = [pq.read_table(f, columns=["token", "block_id"]).to_pylist() for f in glob.glob(str(tmp_path / "index" / "postings" / "*.parquet"))]
    assert all([(r["token"].encode(), r["block_id"]) for r in f] == sorted((r["token"].encode(), r["block_id"]) for r in f) for f in files)
