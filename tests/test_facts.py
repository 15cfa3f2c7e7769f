import collections
import datetime as dt
import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from trustframe import Table, TableSet
from trustframe.operators import audit, changes as H, digest as D, keys as K, profile as P, quality as Q, reconcile as C, relations as R, repair as E, rows, semantics as S
from trustframe.operators.anomalies import rare_negatives
from trustframe.operators.frequencies import merge_frequencies, value_frequencies
from trustframe.operators.quantiles import order_statistics
from trustframe.plans.facts import Facts
from trustframe.tables import with_file_row_id


def table(spark, name, schema, data, source="local", **kw):
    rows_ = [(i + 2, *r) for i, r in enumerate(data)]
    return Table(name, spark.createDataFrame(rows_, f"_row_id long, {schema}"), "_row_id", source=source, hide_row_id=True, **kw)


@pytest.fixture(scope="module")
def shop(spark):
    customers = table(spark, "customers", "customer_id long, name string", [(i, f"c{i}") for i in range(1, 6)])
    orders = table(spark, "orders", "order_id long, customer_id long, note string",
                   [(10, 1, "a"), (11, 2, "N/A"), (12, 2, "b"), (13, 4, "c"), (14, 5, "d")])
    return Facts(TableSet(spark, [customers, orders]))


def test_profiles_keys_and_findings(shop):
    assert shop.profiles.count() == 5
    assert shop.keys.filter("method = 'single_column_uniqueness'").count() >= 2
    token = shop.findings.filter("code = 'DQ_NULL_TOKEN'").collect()
    assert [(r["count"], r.examples) for r in token] == [(1, ["N/A"])]
    assert shop.fingerprints.count() == 2


def test_relationship_between_orders_and_customers(spark):
    customers = table(spark, "customers", "customer_id long, name string", [(i, f"c{i}") for i in range(1, 6)])
    orders = table(spark, "orders", "order_id long, customer_id long", [(10, 1), (11, 2), (12, 2), (13, 4), (14, 5)])
    f = Facts(TableSet(spark, [customers, orders]))
    got = R.named_relationships(f.tables, f.relationships).filter("from_table = 'orders'").collect()
    assert [(r.from_name, r.to_table, r.containment) for r in got] == [("customer_id", "customers", 1.0)]


def test_declared_facts_win_and_keep_measurements(spark):
    t = table(spark, "orders", "order_id long, customer_id long", [(1, 5), (2, 6)])
    c = table(spark, "customers", "customer_id long", [(5,), (6,)])
    f = Facts(TableSet(spark, [t, c]), declared_keys={"orders": ["order_id"]},
              declared_relations=[("orders", "customer_id", "customers", "customer_id")])
    key = f.keys.filter("status = 'confirmed'").collect()
    assert [(k.column_names, k.uniqueness) for k in key] == [(["order_id"], 1.0)]
    assert [r.status for r in f.relationships.filter("method = 'declared'").collect()] == ["confirmed"]


def test_similar_names_match_brute_force(spark):
    import difflib
    rng = random.Random(7)
    words = ["order", "id", "customer", "key", "nation", "region", "amount", "date", "no", "x", "ab"]
    names = sorted({"".join(rng.sample(words, rng.randint(1, 3))) for _ in range(120)} | {"orderid", "ordersid", "orderids", "ids", "idx"})
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.child_name, r.parent_name) for r in R.similar_names(frame, frame).collect()}
    want = {(a, b) for a, b in itertools.product(names, names) if a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.82}
    assert got == want


def test_order_does_not_matter(spark, shop):
    t = shop.tables.table("orders")
    shuffled = Table("orders", t.df.orderBy(F.rand(3)).repartition(3), "_row_id", hide_row_id=True)
    a, b = rows.fingerprints(rows.row_hash_counts(t)).first(), rows.fingerprints(rows.row_hash_counts(shuffled)).first()
    assert a == b
    first = {tuple(r) for r in value_frequencies(TableSet(spark, [t])).collect()}
    assert first == {tuple(r) for r in value_frequencies(TableSet(spark, [shuffled])).collect()}


def test_frequencies_are_additive(spark, shop):
    t = shop.tables.table("orders")
    halves = [Table("orders", t.df.filter(c), "_row_id", hide_row_id=True) for c in ("_row_id < 4", "_row_id >= 4")]
    parts = [value_frequencies(TableSet(spark, [h])) for h in halves]
    merged = {tuple(r) for r in merge_frequencies(parts[0].unionByName(parts[1])).collect()}
    assert merged == {tuple(r) for r in value_frequencies(TableSet(spark, [t])).collect()}


def test_long_texts_are_compared_in_full(spark):
    base = "x" * 5000
    t = table(spark, "docs", "body string", [(base + "a",), (base + "b",), (base + "a",)])
    s = TableSet(spark, [t])
    p = P.profile(s).first()
    assert (p.n, p.distinct_count, p.max_value) == (3, 2, base + "b")
    hit = value_frequencies(s).filter("cnt = 2")
    assert P.resolve_long_values(t, "body", hit).first().full_text == base + "a"


def test_mixed_column(spark):
    t = Table("m", spark.createDataFrame([(1, (5.0, None)), (2, (None, "Total")), (3, (5.0, None))],
                                         "_row_id long, v struct<num: double, txt: string>"), "_row_id", hide_row_id=True)
    f = Facts(TableSet(spark, [t]))
    p = f.profiles.first()
    assert (p.kind, p.distinct_count, p.min_num, p.max_text) == ("mixed", 2, 5.0, "Total")
    assert [r.detail for r in f.flags.collect()] == ["Total"]
    assert f.findings.filter("code = 'DQ_MIXED_TYPE'").count() == 1


def test_totals_row_is_flagged_excluded_and_reported(spark):
    t = table(spark, "sales", "region string, amount double", [("North", 100.0), ("South", 200.0), ("Total", 300.0)])
    f = Facts(TableSet(spark, [t]))
    assert [(r.row_id, r.detail) for r in f.flags.collect()] == [(4, "Total")]
    assert Q.without_flagged(t, f.flags).agg(F.sum("amount")).first()[0] == 300.0
    assert f.kinds.first().table_kind == "report"


def test_roles_grain_coverage(spark):
    t = table(spark, "orders", "order_id long, status string, amount double, order_date date",
              [(i, "open" if i % 2 else "shut", i * 1.5, dt.date(2024, 1, i + 1)) for i in range(5)])
    f = Facts(TableSet(spark, [t]))
    roles = {r.column_name: r.role for r in f.roles.collect()}
    assert roles == {"order_id": "identifier", "status": "category", "amount": "money", "order_date": "date"}
    assert f.grain.first().columns == "order_id" and f.time_coverage.first().min_value == "2024-01-01"


def test_unknown_grain(spark):
    t = table(spark, "log", "category string, code long", [("A", 1), ("A", 1), ("B", 2)])
    assert Facts(TableSet(spark, [t])).grain.first().status == "unknown"


def test_duplicate_tables(spark):
    data = [(i, f"n{i}") for i in range(3)]
    s = TableSet(spark, [table(spark, "customers", "customer_id long, name string", data, source=x) for x in ("jan", "feb")])
    assert [d.score for d in S.duplicate_tables(s).collect()] == [1.0]


def test_quantiles_match_sorting(spark):
    rng = random.Random(1)
    data = {0: [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(501)], 1: [rng.gauss(0, 1) for _ in range(5000)], 2: [7.0],
            3: [5.0] * 3000 + [rng.random() for _ in range(2500)]}
    frame = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "column_no int, v double")
    for accuracy, bound, fractions in ((100, 10, (0.25, 0.5, 0.75)), (1000, 200, (0.0, 0.001, 0.5, 0.999, 1.0)), (10_000, 1_000_000, (0.25, 0.5, 0.75))):
        for r in order_statistics(frame, fractions, accuracy=accuracy, bound=bound).collect():
            vs = sorted(data[r.column_no])
            assert (r.n, r.q) == (len(vs), [vs[round(f * (len(vs) - 1))] for f in fractions])
    assert order_statistics(frame.filter("false")).collect() == []


def test_ranks_of_ten_million_distinct_values(spark):
    """A pseudo-random order of 0..n-1: the value at a rank is the rank, and no task sorts more than the bound."""
    n = 10_000_019
    values = spark.range(n).select(F.lit(3).alias("column_no"), ((F.col("id") * 7_654_321) % n).alias("v"))
    got = order_statistics(values, (0.001, 0.5, 0.9), accuracy=2000, bound=50_000).collect()
    assert [(r.n, r.q) for r in got] == [(n, [round(f * (n - 1)) for f in (0.001, 0.5, 0.9)])]
    hot = values.select("column_no", F.when(F.col("v") < 9_900_000, 0).otherwise(F.col("v")).alias("v"))
    got = order_statistics(hot, (0.5, 0.995, 1.0), accuracy=2000, bound=20_000).collect()
    assert [r.q for r in got] == [[0, round(0.995 * (n - 1)), n - 1]]


def test_rare_negatives_need_to_be_rare(spark):
    values = spark.createDataFrame([(0, i, -1.0 if i == 0 else 1.0) for i in range(100)]
                                   + [(1, i, -1.0 if i % 3 == 0 else 1.0) for i in range(100)], "column_no int, row_id long, v double")
    assert [(r.column_no, r["count"]) for r in rare_negatives(values).collect()] == [(0, 1)]


def test_digest_excludes_totals_and_counts_the_blank_group(spark):
    cities = [f"city{i:02d}" for i in range(12)]
    data = [(i, cities[i % 12] if i % 13 else None, float(i % 5 + 1) * 10, dt.date(2024, 1 + i % 3, 1)) for i in range(60)]
    t = table(spark, "orders", "order_id long, city string, amount double, order_date date", data + [(99, "Total", 999999.0, None)])
    f = Facts(TableSet(spark, [t]))
    d = f.digest.collect()
    total = next(r.value for r in d if r.section == "total" and r.key == "sum")
    assert total == sum(r[2] for r in data)
    groups = [r for r in d if r.section == "by_group"]
    assert groups[-1].key == "(other 3 groups)" or any(r.key == "(other 3 groups)" for r in groups)
    assert abs(sum(r.share for r in groups) - 1) < 1e-9 and len([r for r in d if r.section == "by_month"]) == 3


def test_report_regions_and_totals_are_reconciled(spark):
    data = [(i, ["Cairo", "Giza", "Luxor"][i % 3], float(i)) for i in range(30)]
    sums = {c: sum(r[2] for r in data if r[1] == c) for c in ("Cairo", "Giza", "Luxor")}
    orders = table(spark, "orders", "order_id long, city string, amount double", data, source="a")
    report = table(spark, "report", "city string, sales double",
                   [("cairo", sums["Cairo"]), ("Giza", sums["Giza"] + 5), ("Luxor", sums["Luxor"]), ("Total", sum(sums.values()))], source="b")
    got = Facts(TableSet(spark, [orders, report])).reconciliation().collect()
    assert [(r.agg, r.measure, r.compared, r.matched, r.status, [m.label for m in r.mismatches]) for r in got] == [
        ("SUM", "amount", 4, 3, "partial", ["Giza"])]


def test_long_reports_and_long_labels_are_reconciled(spark):
    """A report of 5,100 rows, and one whose labels mostly have 300 characters."""
    data = [(i, f"c{i % 5100}", float(i)) for i in range(20_400)]
    sums = [sum(float(i) for i in range(k, 20_400, 5100)) + (k >= 5080) for k in range(5100)]
    orders = table(spark, "orders", "order_id long, city string, amount double", data, source="a")
    report = table(spark, "report", "city string, sales double", [(f"C{k}", s) for k, s in enumerate(sums)], source="b")
    got = Facts(TableSet(spark, [orders, report])).reconciliation().filter("number_column = 'sales'").collect()
    assert [(r.agg, r.measure, r.compared, r.matched, r.status, len(r.mismatches)) for r in got] == [("SUM", "amount", 5100, 5080, "partial", 10)]
    names = [x * 300 for x in "abc"] + ["d"]
    orders = table(spark, "orders", "order_id long, city string, amount double", [(i, names[i % 4], float(i)) for i in range(40)], source="a")
    report = table(spark, "report", "city string, sales double", [(n.upper(), float(sum(range(k, 40, 4)))) for k, n in enumerate(names)], source="b")
    got = Facts(TableSet(spark, [orders, report])).reconciliation().filter("number_column = 'sales'").collect()
    assert [(r.agg, r.measure, r.compared, r.matched, r.status) for r in got] == [("SUM", "amount", 4, 4, "reconciled")]


def test_reports_without_a_match_are_never_read(spark):
    """Labels meet in the value frequencies: a report that shares none is not scanned, and of one that does only its label columns that match."""
    data = [(i, f"c{i % 40}", float(i)) for i in range(400)]
    orders = table(spark, "orders", "order_id long, city string, amount double", data, source="a")
    report = table(spark, "report", "city string, remark string, sales double", [(f"C{k}", f"r{k}", float(sum(range(k, 400, 40)))) for k in range(40)], source="b")
    other = table(spark, "other", "word string, size double", [(f"w{k}", float(k)) for k in range(30)], source="c")
    long = table(spark, "long", "word string, size double", [("x" * 300 + str(k), float(k)) for k in range(30)], source="d")
    facts = Facts(TableSet(spark, [orders, report, other, long]))
    facts.frequencies, facts.profiles, facts.roles

    def unreadable(t, names):
        broken = [F.raise_error(F.concat(F.lit("read "), F.col(c).cast("string"))).cast(kind).alias(c) if c in names else F.col(c) for c, kind in t.df.dtypes]
        return replace(t, df=t.df.select(*broken))

    safe = TableSet(spark, [orders, unreadable(report, ["remark"]), unreadable(other, ["word", "size"]), unreadable(long, ["word", "size"])])
    got = C.reconcile(safe, facts.profiles, facts.frequencies, facts.roles, [orders.table_id], facts.all_flags).collect()
    assert [(r.label_column, r.number_column, r.compared, r.matched, r.status) for r in got] == [("city", "sales", 40, 40, "reconciled")]


def test_a_report_of_a_million_rows(spark):
    n = 1_000_000
    orders = Table("orders", spark.range(2 * n).select(F.col("id").alias("order_id"), F.concat(F.lit("c"), F.col("id") % n).alias("city"), F.col("id").cast("double").alias("amount")), "order_id", source="a")
    sold = (2 * F.col("id") + n).cast("double") + F.when(F.col("id") % 4 == 0, 1000.0).otherwise(0.0)
    report = Table("report", spark.range(n).select(F.col("id").alias("row_no"), F.concat(F.lit("C"), F.col("id")).alias("city"), sold.alias("sales")), "row_no", source="b", hide_row_id=True)
    tables = TableSet(spark, [orders, report])
    schema = "column_no int, table_id string, column_name string, position int, role string, distinct_count long, kind string, sql_type string"
    roles = spark.createDataFrame([(tables.number(orders, "city"), orders.table_id, "city", 1, "dimension", n, "text", "TEXT"),
                                   (tables.number(orders, "amount"), orders.table_id, "amount", 2, "money", 2 * n, "real", "REAL")], schema)
    counts = spark.createDataFrame([(orders.table_id, 2 * n), (report.table_id, n)], "table_id string, row_count long")
    flags = spark.createDataFrame([], "table_id string, row_id long, flag string, detail string")
    got = C.reconcile(tables, counts, value_frequencies(tables), roles, [orders.table_id], flags).collect()
    assert [(r.agg, r.measure, r.compared, r.matched, r.status, [m.row_id for m in r.mismatches]) for r in got] == [
        ("SUM", "amount", n, 3 * n // 4, "partial", [4 * k for k in range(10)])]


def test_repairs(spark):
    t = table(spark, "dirty", "city string, quantity_text string",
              [("Cairo", "1"), ("Cairo", "1,234"), ("cairo", "not a number"), (" CAIRO ", "4"), ("N/A", "5")])
    s = TableSet(spark, [t])
    got = {(r.row_id, r.column_name, r.repaired_value, r.rule) for r in E.repairs(s).collect()}
    assert got == {(4, "city", "Cairo", "category_consolidation"), (5, "city", "Cairo", "category_consolidation"),
                   (6, "city", None, "null_token"), (3, "quantity_text", "1234", "text_as_number")}
    shown = [r.city for r in E.repaired_view(t, E.repairs(s)).orderBy("_row_id").collect()]
    assert shown == ["Cairo", "Cairo", "Cairo", "Cairo", None]
    assert E.repairs(s, ()).count() == 0


def test_long_spelling_variants(spark):
    text = "word " * 100
    t = table(spark, "docs", "body string", [(text,), (text,), (text.upper(),)])
    got = E.repairs(TableSet(spark, [t]), ("category_consolidation",)).collect()
    assert [(r.row_id, r.repaired_value) for r in got] == [(4, text)]


def test_category_and_distribution_changes(spark):
    cols = "table_id string, column_name string, distinct_count long, top_k array<struct<value: string, cnt: long>>"
    tabs = "table_id string, source_id string, table_name string, row_count long, schema_fingerprint string, fingerprint string"

    def snap(top, fp="f"):
        return H.Snapshot(spark.createDataFrame([("s", "h")], "source_id string, sha256 string"),
                          spark.createDataFrame([("t", "s", "t", 5, "x", fp)], tabs),
                          spark.createDataFrame([("t", "r", 1)], "table_id string, row_hash string, n long"),
                          spark.createDataFrame([("t", "category", len(top), top)], cols),
                          spark.createDataFrame([("p", "k", "1")], "pack string, kpi_id string, value string"))

    one, two, three = [("A", 3), ("B", 2)], [("A", 2), ("B", 3)], [("A", 2), ("C", 3)]
    assert [r.kind for r in H.changes(snap(one), snap(two)).collect()] == ["distribution"]
    assert [r.kind for r in H.changes(snap(two), snap(three)).collect()] == ["category"]
    assert H.changes(snap(one), snap(one)).count() == 0


def test_audit_finds_tampering(spark, shop):
    good = shop.tables.catalog().join(shop.profiles.groupBy("table_id").agg(F.max("row_count").alias("row_count")), "table_id")
    assert audit.audit(good, shop.tables).count() == 0
    bad = good.withColumn("row_count", F.col("row_count") + 1)
    assert {r.code for r in audit.audit(bad, shop.tables).collect()} == {"AUDIT_ROW_COUNT"}


def test_aggregate_rejects_what_it_cannot_do(spark, shop):
    t = shop.tables.table("orders")
    for bad in (dict(column="*", op="sum"), dict(column="x"), dict(column="note", op="median"), dict(column="note", group_by="x")):
        with pytest.raises(ValueError):
            D.aggregate(t, **bad)
    assert D.aggregate(t, "*").first().value == 5


def test_file_row_ids_are_unique_and_stable(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    df = with_file_row_id(spark.read.parquet(str(tmp_path / "t")))
    ids = [r["_row_id"] for r in df.collect()]
    assert len(set(ids)) == 100 and sorted(ids) == sorted(r["_row_id"] for r in df.repartition(2).collect())


def test_row_ids_stay_when_files_arrive(spark, tmp_path):
    folder, registry = str(tmp_path / "t"), str(tmp_path / "numbers")
    spark.range(40).coalesce(1).write.parquet(f"{folder}/m")
    read = lambda: with_file_row_id(spark.read.option("recursiveFileLookup", True).parquet(folder), registry=registry)
    before = {r.id: r["_row_id"] for r in read().collect()}
    spark.range(100, 140).coalesce(1).write.parquet(f"{folder}/a")              # sorts before the first file
    spark.range(200, 240).coalesce(1).write.parquet(f"{folder}/z")
    after = {r.id: r["_row_id"] for r in read().collect()}
    assert len(set(after.values())) == 120 and all(after[k] == v for k, v in before.items())
    assert after == {r.id: r["_row_id"] for r in read().collect()}


def test_composite_key_of_late_columns(spark):
    """Among thirteen candidates only the eighth and ninth column together identify rows."""
    other = [f"c{i}" for i in range(13)]
    data = []
    for k in range(100):
        row = [k // 20 * 2 + k % 10 // 5] * 13
        row[7], row[8] = k // 10, k % 10
        data.append(tuple(row))
    facts = Facts(TableSet(spark, [table(spark, "wide", ", ".join(f"{c} long" for c in other), data)]))
    assert [r.column_names for r in facts.keys.collect()] == [["c7", "c8"]]


def test_composite_key_among_forty_columns_takes_three_scans(spark, monkeypatch):
    """780 pairs over 30,000 rows: a sample and sketches leave so few that one exact scan finds the only key."""
    n, names = 30_000, [f"c{i:02d}" for i in range(40)]
    k = F.col("id")
    nearly = (k % 8) * 1_000_000 + F.floor(k / 64)                              # with blocks of eight, the key; else repeats in a tenth of the rows
    columns = [F.floor((k + i) / 9).alias(c) for i, c in enumerate(names)]
    columns[30], columns[35] = F.floor(k / 8).alias(names[30]), nearly.alias(names[35])
    wide = Table("wide", spark.range(n).select("id", *columns), "id", hide_row_id=True)
    tables = TableSet(spark, [wide])
    counted, refuted, sketched = [], K.refuted_by_sample, K.sketched_counts
    monkeypatch.setattr(K, "pair_counts", lambda t, pairs, f=K.pair_counts: counted.append(("exact", len(pairs))) or f(t, pairs))
    monkeypatch.setattr(K, "refuted_by_sample", lambda s, pairs: counted.append(("sample", len(pairs))) or refuted(s, pairs))
    monkeypatch.setattr(K, "sketched_counts", lambda t, pairs: counted.append(("sketch", len(pairs))) or sketched(t, pairs))
    found = [r.asDict() for r in wide.df.agg(*[F.count_distinct(c).alias(c) for c in names]).collect()][0]
    Candidate = collections.namedtuple("Candidate", "table_id position column_id column_name distinct_count row_count")
    got = K.first_pair(tables, wide, [Candidate(wide.table_id, i, c, c, found[c], n) for i, c in enumerate(names)]).collect()
    assert [(r.column_names, r.uniqueness, r.null_rate) for r in got] == [([names[30], names[35]], 1.0, 0.0)]
    assert len(counted) <= 3 and counted[0][0] == "sample" and counted[-1][0] == "exact" and counted[-1][1] <= K.PAIRS_PER_SCAN


def test_sketches_only_refute_what_repeats(spark):
    t = Table("t", spark.range(40_000).select("id", F.floor(F.col("id") / 2).alias("half"), (F.col("id") % 1000).alias("low"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("gaps")), "id", hide_row_id=True)
    got = K.sketched_counts(t, [(3, "half", "low"), (5, "half", "gaps"), (6, "low", "low")])
    for number, true in ((3, 40_000), (5, 20_000), (6, 1000)):
        assert abs(got[number] - true) < K.SIGMAS * 0.0163 * true


def test_gap_before_the_newest_sixty_months(spark):
    """A month missing ten years back is found, though the digest shows sixty months."""
    months = [dt.date(2010 + m // 12, m % 12 + 1, d) for m in range(150) if m != 20 for d in (3, 17)]
    sales = table(spark, "sales", "sale_date date, region string, amount double", [(d, "ab"[i % 2], 10.0 + i % 7) for i, d in enumerate(months)])
    facts = Facts(TableSet(spark, [sales]))
    assert facts.digest.filter("section = 'by_month'").count() == 60
    gone = facts.anomalies(dt.date(2024, 6, 30)).filter("kind = 'missing_period'").collect()
    assert [(r["count"], r.examples) for r in gone] == [(1, ["2011-09"])]


def test_row_hashes_are_not_shuffled_by_table(spark):
    from trustframe.operators import changes as H
    frames = [("source_id string, sha256 string", [("s", "x")]),
              ("table_id string, source_id string, table_name string, row_count long, schema_fingerprint string, fingerprint string", [("t", "s", "orders", 2, "f", "g")]),
              ("table_id string, row_hash string, n long", [("t", "h1", 1), ("t", "h2", 1)]),
              ("table_id string, column_name string, distinct_count long, top_k array<struct<value: string, cnt: long>>", []),
              ("pack string, kpi_id string, value string", [])]
    one, two = (H.Snapshot(*[spark.createDataFrame(rows[:keep], schema) for schema, rows in frames]) for keep in (2, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = H.changes(one, two)
        assert "BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString()
        assert [(r.before, r.after) for r in found.filter("kind = 'row'").collect()] == [("removed=1", "added=0")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
