import json
import os

import pytest
from pyspark.sql import functions as F

from trustframe import Table, TableSet
from trustframe.operators import grid as G, regions as R, rules, runlog as L
from trustframe.plans import source_queries as SQ
from trustframe.plans.grid_queries import _blocks, make_workbook
from trustframe.plans.read_api import Reader, TimedOut, envelopes, result
from trustframe.plans.facts import Facts
from trustframe.sources import documents as D, inventory as I, journal as J, workbook as W
from trustframe.sources.publish import NotPublished, RunStore
from trustframe.sources.views import Views
from trustframe.streaming import ingest

N = None


def cells(spark, grids, first_row=1, first_col=1):
    out = []
    for name, grid in grids.items():
        for i, row in enumerate(grid):
            for j, v in enumerate(row):
                if v is not None:
                    kind = "bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "num"
                    out.append(("s", name, first_row + i, first_col + j, kind, None if kind == "text" else float(v), v if kind == "text" else None, N, N))
    return spark.createDataFrame(out, G.CELL)


def test_regions(spark):
    grids = {"stack": [["id", "qty"], [1, 2], [2, 3], [N, N], [N, N], ["region", "total"], ["E", 5]],
             "noheader": [["id", "qty"], [1, 2], [N, N], [N, N], [3, 4], [5, 6]], "single": [["id", "qty"], [1, 2], [N, N], ["code", "desc"], ["x", "y"]],
             "side": [["id", "qty", N, "code", "desc"], [1, 2, N, "x", "y"], [2, 3, N, "z", "w"], [N, N, N, "q", "r"]],
             "spacer": [["id", "qty", N, "code"], [1, 2, N, "x"], [2, 3, N, "z"]], "title": [["Report", N], [N, N], [N, N], ["id", "qty"], [1, 2]]}
    got = {}
    for r in R.regions(cells(spark, grids, 10, 3)).orderBy("region_no").collect():
        got.setdefault(r.sheet, []).append((r.kind, r.first_row, r.first_col, r.last_row, r.last_col, r.header_row))
    assert got == {"stack": [("table", 10, 3, 12, 4, 10), ("table", 15, 3, 16, 4, 15)], "noheader": [("table", 10, 3, 15, 4, 10)],
                   "single": [("table", 10, 3, 14, 4, 10)], "side": [("table", 10, 3, 12, 4, 10), ("table", 10, 6, 13, 7, 10)],
                   "spacer": [("table", 10, 3, 12, 6, 10)], "title": [("note", 10, 3, 10, 3, None), ("table", 13, 3, 14, 4, 13)]}


def test_runs_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 4)
    used = [1, 2, 4, 5, 6, 9, 10, 20, 21, 30]
    frame = spark.createDataFrame([("k", i) for i in used], "k string, row int")
    got = sorted((r.start, r.end) for r in R.runs(frame, ["k"], "row", 2).collect())
    assert got == [(1, 6), (9, 10), (20, 21), (30, 30)]


def test_header_groups(spark):
    grids = {"run": [[N, "Q1", N, "Q2", N], ["item", "Plan", "Actual", "Plan", "Actual"], ["a", 1, 2, 3, 4]],
             "lone": [["Sales report", N, N], ["a", "b", "c"], [1, 2, 3]], "merged": [[N, "Q1", N, N], ["a", "b", "c", "d"], [1, 2, 3, 4]]}
    merged = spark.createDataFrame([("s", "merged", 1, 2, 1, 3)], "source_id string, sheet string, row1 int, col1 int, row2 int, col2 int")
    c = cells(spark, grids)
    got = {(r.sheet, r.col): (r.path, r.method) for r in G.header_groups(c, G.sheets(c), merged).collect()}
    assert got == {("run", 2): (["Q1"], "label_run"), ("run", 3): (["Q1"], "label_run"), ("run", 4): (["Q2"], "label_run"),
                   ("run", 5): (["Q2"], "label_run"), ("merged", 2): (["Q1"], "merged_area"), ("merged", 3): (["Q1"], "merged_area")}


def test_names_are_unique_without_case(spark):
    c = cells(spark, {"t": [["Name", "name", "name_2", N, "a b"], ["x", "y", "z", "q", "r"], ["x", "y", "z", "q", "r"]]})
    names = [r.name for r in G.build(c).columns.orderBy("position").collect()]
    assert names == ["Name", "name_2", "name_2_2", "col_4", "a_b"]


def test_workbook_end_to_end(spark):
    rows = [["Monthly extract"], [], ["order_id", "order_date", "city", "qty", "ok"]]
    rows += [[i, (45000 + i,), ["Cairo", "Giza"][i % 2], "#N/A" if i == 7 else i % 7 + 1, i % 2 == 0] for i in range(1, 41)]
    rows.append([41, (45041.5,), "Cairo", "='Raw Data'!D2*2", True])
    files = spark.createDataFrame([("book", make_workbook(rows, "Raw", ["A1:C1"])), ("broken", b"not a zip")], "source_id string, content binary")
    parts = W.workbook_parts(files)
    c = W.cells(parts).cache()
    b = G.build(c)
    s = b.sheets.first()
    assert (s.header_row, s.data_rows, s.blank_rows) == (3, 41, 0)
    kinds = {r.name: (r.column_kind, r.date_kind, r.error_cells) for r in b.columns.collect()}
    assert kinds == {"order_id": ("int", N, 0), "order_date": ("date", "datetime", 0), "city": ("text", N, 0), "qty": ("int", N, 1), "ok": ("bool", N, 0)}
    assert G.verify(c, b).filter("NOT ok").count() == 0
    assert [(e.row, e.error) for e in b.errors.collect()] == [(10, "#N/A")] and [p.text for p in b.preamble.collect()] == ["Monthly extract"]
    wide = G.wide_table(b, "book", "Raw")
    assert dict(wide.dtypes)["order_id"] == "bigint" and wide.filter("_row_id = 44").first().order_date == "2023-04-25 12:00:00"
    assert [f.formula for f in G.formula_cells(c, b).collect()] == ["='Raw Data'!D2*2"]
    assert [m.col2 for m in W.merged_areas(parts).collect()] == [3]
    assert [(x.source_id, x.kind) for x in W.blind_spots(parts).collect()] == [("broken", "reader_limit")]


def test_dates_of_the_1904_system(spark):
    files = spark.createDataFrame([("b", make_workbook([["when", "n"], [(0,), 1], [(1,), 2]], date1904=True))], "source_id string, content binary")
    values = G.build(W.cells(W.workbook_parts(files)).cache()).values.filter("name = 'when'").orderBy("row").collect()
    assert [v.txt for v in values] == ["1904-01-01", "1904-01-02"]


def test_mail_with_nested_attachments(spark):
    inner = "From: x@example.com\r\nSubject: inner\r\nContent-Type: text/plain\r\n\r\ninner text\r\n"
    outer = ("From: a@example.com\r\nTo: b@example.com\r\nSubject: hi\r\nDate: Tue, 12 Mar 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\n"
             'Content-Type: multipart/mixed; boundary="c"\r\n\r\n--c\r\nContent-Type: text/html\r\n\r\n<h1>T</h1><p>body</p>\r\n--c\r\n'
             'Content-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="in.eml"\r\n\r\n' + inner +
             '--c\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename="t.csv"\r\n\r\na,b\r\n--c--\r\n')
    files = spark.createDataFrame([("m", "", "m.eml", outer.encode())], "source_id string, part string, name string, content binary")
    blocks, attachments = D.read_documents(files)
    got = {(r.part, r.kind, r.text) for r in blocks.collect() if r.kind != "email_header"}
    assert got == {("", "heading", "T"), ("", "email_body", "body"), ("in.eml", "email_body", "inner text")}
    assert {(r.name, r.status) for r in attachments.collect()} == {("in.eml", "read"), ("t.csv", "stored")}
    assert len({r.block_id for r in blocks.collect()}) == blocks.count()


def test_decode_chain(spark):
    data = ["naïve".encode(), "مرحبا".encode("cp1256"), b"\xef\xbb\xbfx"]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary")
    assert [r.t for r in frame.select("i", D.decode("d").alias("t")).orderBy("i").collect()] == ["naïve", "مرحبا", "x"]


def test_csv_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("item;price\nx;1,5\ny;2,5\n")
    (tmp_path / "b.csv").write_text("k\tv\n1\t2\n")
    frames = D.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(tuple(f.columns[:2]) for f in frames) == [("item", "price"), ("k", "v")]


def test_inventory_of_real_files(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"same")
    (tmp_path / "two.txt").write_bytes(b"same")
    (tmp_path / "~$lock.xlsx").write_bytes(b"x")
    (tmp_path / "z.xlsx").write_bytes(b"PK\x03\x04")
    (tmp_path / "locked.xlsx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + "EncryptedPackage".encode("utf-16-le"))
    inv = I.inventory(I.read_files(spark, [str(tmp_path)]))
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.wrapper) for r in inv.collect()}
    assert got == {"one.txt": ("txt", "other"), "two.txt": ("txt", "other"), "z.xlsx": ("xlsx", "zip"), "locked.xlsx": ("xlsx", "encrypted")}
    assert I.identical_content(inv).first().copies == 2 and I.inventory_warnings(inv).count() == 2
    with pytest.raises(Exception):
        I.read_files(spark, [str(tmp_path / "missing")]).count()


def test_packs_are_checked():
    good = {"pack": {"name": "p", "version": "1"}, "rule": [{"id": "r", "sql": "SELECT 1"}]}
    assert rules.Pack.parse(good).rule[0]["id"] == "r"
    for change in ({"pack": {"name": "p"}}, {"rule": [{"id": "r", "sql": "DROP TABLE x"}]}, {"rule": [{"id": "r", "sql": "SELECT 1; SELECT 2"}]},
                   {"rule": [{"id": "r", "sql": "SELECT 1"}] * 2}, {"rule": [{"id": "r", "sql": "SELECT 1", "severity": "bad"}]},
                   {"kpi": [{"id": "k", "sql": "SELECT 1", "extra": 1}]}, {"key": [{"table": "t", "columns": ["a", "a"]}]}):
        with pytest.raises(rules.PackError):
            rules.Pack.parse(good | change)
    with pytest.raises(rules.PackError):
        rules.parse_packs([good, good])


def test_failed_run_never_replaces_the_last_good_one(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.current() is None
    issue = spark.createDataFrame([("AUDIT_ROW_COUNT", "t", 1, 2)], "code string, subject string, expected long, actual long")
    for run, bad in (("r1", None), ("r2", issue), ("r3", None), ("r4", None)):
        store.write(run, "f", spark.createDataFrame([(run,)], "x string"))
        if bad is not None:
            with pytest.raises(NotPublished):
                store.finish(run, bad)
            assert store.current() == "r1"
        else:
            store.finish(run)
    assert (store.current(), store.previous(), store.read("f").first().x) == ("r4", "r3", "r4")
    assert store.prune(1) == ["r1", "r2"] and store.read("f", "r3").count() == 1


def test_rules_over_one_table_share_a_scan(spark):
    data = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, i * 1.5) for i in range(60)], "id long, kind string, amount double")
    views = Views(TableSet(spark, [Table("things", data, "id"), Table("others", spark.range(5).toDF("id"), "id")]))
    t = "{{table:local/things}}"
    shared = {"all": (f"SELECT count(*) FROM {t}", 60), "kinds": (f"SELECT count(DISTINCT kind) AS n FROM {t} x WHERE x.amount > 3", 3), "none": (f"SELECT sum(amount) FROM {t} WHERE id < 0", None),
              "some": (f"SELECT count(*) FROM {t} t WHERE t.kind IN ('a', 'b') AND NOT t.kind LIKE 'b%' AND id BETWEEN 2 AND 40", 12), "top": (f"SELECT max(id) FROM {t} WHERE kind IS NULL", 56),
              "yes": (f"SELECT bool_and(amount >= 0) FROM {t}", True), "bad": (f"SELECT count(missing) FROM {t}", "error"), "ansi": ("SELECT count(*) FROM {{table:local/others}} WHERE CAST('x' AS INT) = id", "error"),
              "fine": ("SELECT count(*) FROM {{table:local/others}} WHERE id > 1", 3)}
    alone = {"join": (f"SELECT count(*) FROM {t} a JOIN {t} b ON a.id = b.id", 60), "grouped": (f"SELECT count(*) FROM {t} GROUP BY kind ORDER BY 1 LIMIT 1", 9),
             "nested": (f"SELECT count(*) FROM {t} WHERE id > (SELECT avg(id) FROM {t})", 30), "twice": (f"SELECT count(*) + 1 FROM {t}", 61), "ratio": (f"SELECT avg(amount) FROM {t} HAVING count(*) > 0", 44.25)}

    def run(items, group):
        pack = rules.Pack.parse({"pack": {"name": "p", "version": "1"}, "rule": [{"id": k, "sql": sql, "expect": "not_null"} for k, (sql, _) in items.items()]})
        spark.sparkContext.setJobGroup(group, group)
        results = rules.run_packs(spark, [pack], views.resolved)[0].collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return {r.rule_id: "error" if r.status == "error" else r.actual for r in results}, jobs

    got, _ = run(shared | alone, "pack-all")
    assert got == {k: v if v == "error" else str(v) for k, (_, v) in (shared | alone).items()}
    good = {k: v for k, v in shared.items() if k not in ("bad", "ansi", "fine")}
    few, one = run({"all": shared["all"]}, "pack-one")
    many, more = run(good | {f"again{i}": shared["all"] for i in range(10)}, "pack-many")
    aliased = {None, "x", "t"}
    assert more <= one * len(aliased) + 3 and len(many) == len(good) + 10


def test_views_and_bounded_reads(spark):
    sales = Table("sales", spark.createDataFrame([(1, "N", 1), (2, "Total", 1)], "i long, r string, v long"), "i", source="a")
    other = Table("orders", spark.createDataFrame([(1,)], "i long"), "i", source="a")
    again = Table("orders", spark.createDataFrame([(1,)], "i long"), "i", source="b")
    facts = Facts(TableSet(spark, [sales, other, again]))
    views = Views(facts.tables, facts.flags)
    assert views.sql("SELECT sum(v) AS s FROM sales").first().s == 1 and views.sql("SELECT sum(v) AS s FROM a__sales").first().s == 2
    with pytest.raises(ValueError, match="a__orders or b__orders"):
        views.sql("SELECT * FROM orders")
    with pytest.raises(ValueError, match="tables to use"):
        views.sql("SELECT * FROM nowhere")
    with pytest.raises(rules.PackError):
        views.sql("SELECT 1; SELECT 2")
    r = result("sample", Reader(facts).sample("sales"), rows=1)
    assert len(r.rows) == 1 and r.truncated
    reader = Reader(facts, views)
    whole, cut = reader.query("SELECT * FROM a__sales ORDER BY i"), reader.query("SELECT i, r FROM a__sales ORDER BY i", rows=1)
    assert (whole.rows, whole.total, whole.truncated) == ([[1, "N", 1], [2, "Total", 1]], 2, False)
    assert (cut.rows, cut.total, cut.truncated) == ([[1, "N"]], 2, True) and "left out of: sales" in cut.hint and "qualify these" in cut.hint
    assert [(e.row_count, e.total_rows, e.truncated, e.rows) for e in envelopes(spark, [cut]).collect()] == [(1, 2, True, ['[1, "N"]'])]
    with pytest.raises(rules.PackError, match="different names"):
        reader.query("SELECT i, i FROM sales")
    with pytest.raises(TimedOut):
        reader.query("SELECT count(*) AS n FROM range(40000000) WHERE sha2(CAST(id AS STRING), 256) = 'x'", seconds=1.0)
    for section in ("quality", "keys", "column_roles", "grain", "row_flags", "table_kind", "definitions", "digest"):
        assert Reader(facts).meta(section).columns
    with pytest.raises(ValueError):
        Reader(facts).meta("nothing")


def test_run_log(spark, tmp_path):
    events = [dict(t=0, kind="run.start"), dict(t=1, kind="stage.start", data={"name": "read"}), dict(t=2, kind="warning", level="warn"),
              dict(t=3, kind="stage.end", data={"name": "read", "status": "passed"}), dict(t=4, kind="stage.start", data={"name": "check"}),
              dict(t=5, kind="error", level="error", message="bad", data={"code": "E1"}),
              dict(t=6, kind="stage.end", data={"name": "check", "status": "failed"}), dict(t=7, kind="run.end", data={"status": "failed"})]
    lines = [json.dumps({"run_id": "r", "wall": 0, "level": "info", "message": "", "scope": {}, "data": {}} | e) for e in events]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + '\n{"run_id": "r", "t": 9, "ki')
    e = J.read_events(spark, str(tmp_path / "log.jsonl"))
    assert e.count() == 8
    assert {(r.stage, r.status, r.seconds) for r in L.stages(e).collect()} == {("read", "passed", 2.0), ("check", "failed", 2.0)}
    assert [(r.stage, r.warnings) for r in L.warnings_by_stage(e).collect()] == [("read", 1)]
    cause = L.root_cause(e).first()
    assert (cause.stage, cause.code, cause.message, cause.downstream) == ("check", "E1", "bad", 0)
    assert [r["back"] for r in L.failure_context(e, 3).orderBy("back").collect()] == [0, 1, 2, 3]


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    df.filter("k < 50").write.parquet(folder)

    def make(d):
        return Table("t", d, "k")

    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    ingest.keep_frequencies(ingest.watch_parquet(spark, folder, df.schema, files_per_batch=1), make, store, mark)
    df.filter("k >= 50").write.mode("append").parquet(folder)
    ingest.keep_frequencies(ingest.watch_parquet(spark, folder, df.schema, files_per_batch=1), make, store, mark)
    from trustframe.operators.frequencies import value_frequencies
    want = {tuple(r) for r in value_frequencies(TableSet(spark, [make(df)])).collect()}
    assert {tuple(r) for r in ingest.stored_frequencies(spark, store).collect()} == want


def test_run_log_stream_keeps_no_state_and_takes_late_files(spark, tmp_path):
    folder, out = tmp_path / "logs", []
    folder.mkdir()

    def put(name, *events):
        base = {"run_id": "r", "level": "info", "message": "", "scope": {}, "data": {}}
        (folder / name).write_text("\n".join(json.dumps(base | e) for e in events))

    def sink(batch, batch_id):
        out.append([tuple(r) for r in batch.orderBy("stage").collect()])

    schema = "run_id string, stage string, started double, ended double, status string, error string"
    put("a.jsonl", dict(t=1, kind="stage.start", data={"name": "read"}), dict(t=2, kind="stage.start", data={"name": "check"}))
    put("b.jsonl", dict(t=9, kind="stage.end", data={"name": "check", "status": "failed", "error": "E1"}))
    query = ingest.follow_runs(J.stream_events(spark, str(folder), files_per_batch=1), sink, str(tmp_path / "mark"))
    assert len(out) == 2 and not query.lastProgress["stateOperators"]
    put("late.jsonl", dict(t=5, kind="stage.end", data={"name": "read", "status": "passed"}), dict(t=0.5, kind="stage.start", data={"name": "read"}))
    ingest.follow_runs(J.stream_events(spark, str(folder), files_per_batch=1), sink, str(tmp_path / "mark"))
    got = ingest.merge_records(spark.createDataFrame([r for b in out for r in b], schema)).orderBy("stage").collect()
    assert [(r.stage, r.started, r.ended, r.seconds, r.status, r.error) for r in got] == [("check", 2.0, 9.0, 7.0, "failed", "E1"), ("read", 0.5, 5.0, 4.5, "passed", None)]


def test_event_numbers_depend_on_the_files_alone(spark, tmp_path):
    for name in ("a.jsonl", "b.jsonl"):
        lines = [json.dumps({"run_id": name, "t": 0, "kind": "note", "message": str(i)}) for i in range(400)]
        (tmp_path / name).write_text("\n".join(lines[:200] + ['{"run_id": "r", "t"'] + lines[200:]))
    numbers = []
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        numbers.append(sorted((r.run_id, r.seq, int(r.message)) for r in J.read_events(spark, str(tmp_path)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers[0] == numbers[1] and len({seq for _, seq, _ in numbers[0]}) == 800
    assert [m for r, _, m in numbers[0] if r == "a.jsonl"] == list(range(400))


def test_runs_that_finish_together_get_two_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    store = RunStore(spark, str(tmp_path / "store"))
    store.finish("r0")
    slow = store.published()
    seen = []

    class Late(RunStore):
        def published(self):
            return slow                                     # what a run sees that looked before the other appended

        def _claim(self, name, frame, run_id):
            seen.append(super()._claim(name, frame, run_id))
            return seen[-1]

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: Late(spark, str(tmp_path / "store")).finish(r), ["r1", "r2"]))
    assert sorted(r.seq for r in store.published().collect()) == [1, 2, 3] and sorted(r.seq for r in store.runs().collect()) == [1, 2, 3]


def test_region_read_back_and_checks_per_region(spark):
    grid = [["city", "sales"], ["Cairo", 30], ["Giza", 12], [N, N], [N, N], ["kind", "number"], ["big", 25], ["small", 17]]
    c = cells(spark, {"rep": grid})
    regions = R.regions(c)
    second = R.region_table(c, regions, "s", "rep", 2).collect()
    assert [(r["_row_id"], r.kind, r.number) for r in second] == [(7, "big", "25.0"), (8, "small", "17.0")]
    assert R.table_regions(regions).first().tables == 2

    report = G.wide_table(G.build(c), "s", "rep")
    data = [(1, "Cairo", "big", 25.0), (2, "Cairo", "small", 5.0), (3, "Giza", "small", 12.0), (4, "Giza", "small", 0.0), (5, "Giza", "big", 0.0),
            (6, "Cairo", "big", 0.0), (7, "Giza", "small", 0.0), (8, "Cairo", "small", 0.0)]
    orders = Table("orders", spark.createDataFrame(data, "order_id long, city string, kind string, amount double"), "order_id", source="data")
    sheet = Table("rep", report, "_row_id", source="s", hide_row_id=True)
    boxes = regions.withColumn("table_id", F.lit(sheet.table_id))
    got = Facts(TableSet(spark, [orders, sheet])).reconciliation(regions=boxes).collect()
    assert {(r.region_no, r.dim, r.matched, r.status) for r in got} == {(1, "city", 2, "reconciled"), (2, "kind", 2, "reconciled")}


def test_lineage_narrows_the_sources(spark):
    rows = [(i, ["x", "y"][i % 2], float(i)) for i in range(10)]
    schema = "order_id long, label string, amount double"
    one = Table("one", spark.createDataFrame(rows, schema), "order_id", source="a")
    two = Table("two", spark.createDataFrame(rows, schema), "order_id", source="b")
    rep = Table("rep", spark.createDataFrame([(1, "x", 20.0), (2, "y", 25.0)], "n long, label string, total double"), "n", source="c", hide_row_id=True)
    facts = Facts(TableSet(spark, [one, two, rep]))
    link = spark.createDataFrame([(rep.table_id, two.table_id)], "table_id string, target_table_id string")
    assert [r.source_id for r in facts.reconciliation(link).collect()] == [two.table_id]


def planted_orders(spark, tmp_path):
    """Orders in four files, and nations, as the queries read them."""
    o = spark.range(1, 201).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus"),
                                   (F.col("id") * 1.5).alias("o_totalprice"), F.to_timestamp(F.lit("2024-01-01")).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    o.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([("EGYPT",)], "n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    return str(tmp_path)


def folders_of(monkeypatch, module):
    made, real = {}, module.new_folder
    monkeypatch.setattr(module, "new_folder", lambda spark, label: made.setdefault(label, real(spark, label)))
    return made


def files_in(folder):
    return [f for f in os.listdir(folder) if f.startswith("part-")]


def test_late_run_logs_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    made = folders_of(monkeypatch, SQ)
    got = SQ.QUERIES["stream_runlog_late"](spark, planted_orders(spark, tmp_path)).collect()
    assert len(files_in(made["journal"])) > 4                     # one file a part was one task a part
    assert {(r.run_id, r.stage, r.started, r.seconds, r.status) for r in got} == {
        (str(k % 9), f"stage-{k}", k * 100.0, 10.0, "failed" if k % 10 == 0 else "passed") for k in range(1, 201)}
    assert len(got) == 200 and len([f for f in os.listdir(made["stages"]) if f.startswith("batch=")]) == 4


def test_arriving_orders_are_counted_by_all_tasks(spark, tmp_path, monkeypatch):
    made = folders_of(monkeypatch, SQ)
    got = SQ.QUERIES["stream_frequencies_all"](spark, planted_orders(spark, tmp_path)).collect()
    assert len(files_in(made["arriving"])) > 3                    # one file a part was counted in one task
    assert len([f for f in os.listdir(made["stream-store"]) if f.startswith("batch=")]) == 3
    assert {(r.value_num, r.cnt, r.first_row) for r in got if r.column_name == "o_custkey"} == {(float(k), len(range(k or 9, 201, 9)), k or 9) for k in range(9)}
    assert sorted((r.value_num, r.cnt) for r in got if r.column_name == "o_orderkey") == [(float(k), 1) for k in range(1, 201)]


def test_regions_are_read_from_row_masks(spark):
    wide = [[f"h{j}" for j in range(70)]] + [list(range(70)) for _ in range(3)] + [[N], [N]] + [["a", "b"], [1, 2]]
    c = cells(spark, {"wide": wide})
    got = [(r.kind, r.first_row, r.first_col, r.last_row, r.last_col, r.header_row, r.cells) for r in R.regions(c).orderBy("region_no").collect()]
    assert got == [("table", 1, 1, 4, 70, 1, 280), ("table", 7, 1, 8, 2, 7, 4)]
    lines = R.row_masks(c, G.S)
    assert lines.count() == 4 * 2 + 2 and lines.agg(F.sum(F.bit_count("mask")).alias("m"), F.sum("n").alias("n")).first() == (284, 284)


def test_column_types_read_formats_once_and_clean_headers_only(spark, monkeypatch, tmp_path):
    rows = [("s", "t", 1, 1, "text", N, "when", N, N), ("s", "t", 1, 2, "text", N, "hour", N, N), ("s", "t", 1, 3, "text", N, "any", N, N)]
    for i in range(2, 5):
        rows += [("s", "t", i, 1, "date", 45000.0 + i + (0.5 if i == 3 else 0), N, "yyyy-mm-dd", N), ("s", "t", i, 2, "date", 0.25, N, ["hh:mm", "h:mm"][i % 2], N),
                 ("s", "t", i, 3, ["num", "text", "error"][i - 2], float(i) if i == 2 else N, N if i == 2 else "x", N, N)]
    plans, stored = {}, G.materialize

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(G, "materialize", noted)
    got = {r.name: (r.column_kind, r.date_kind, r.non_null, r.error_cells) for r in G.build(spark.createDataFrame(rows, G.CELL)).columns.collect()}
    assert got == {"when": ("date", "datetime", 3, 0), "hour": ("date", "time", 3, 0), "any": ("mixed", N, 2, 1)}
    assert "date_format" not in plans["column-types"] and "date_format" in plans["heads"]
    # the cells of a customer table in one file are dealt out by sheet
    spark.range(250).selectExpr("id AS c_custkey", "'n' AS c_name", "1.5D AS c_acctbal", "'m' AS c_mktsegment", "1 AS c_nationkey").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    dealt = _blocks(spark, str(tmp_path))
    assert "RepartitionByExpression [sheet" in dealt._jdf.queryExecution().optimizedPlan().toString() and dealt.count() == 250
