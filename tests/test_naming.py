"""Unique names against a walk through all names in order."""

import random
import re
import time

from trustframe.operators.naming import unique_names, unique_tables


def in_order(bases, reserved=""):
    taken, names = {reserved.lower()}, []
    for base in bases:
        name, k = base, 2
        while name.lower() in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name.lower())
        names.append(name)
    return names


def test_names_equal_a_walk_in_order(spark):
    rng = random.Random(5)
    pool = ["x", "X", "x_2", "x_3", "X_2_2", "x_2_2", "y", "Y 2", "", " - ", "col_3", "col_1_2", "_row_id", "_ROW_ID_2", "a b", "a-b", "A_B", "12", "12.0", None]
    lists = {g: [rng.choice(pool) for _ in range(rng.randint(0, 25))] for g in range(60)}
    rows = [(g if g else None, i * 3, h) for g, hs in lists.items() for i, h in enumerate(hs)]
    got = unique_names(spark.createDataFrame(rows, "g int, col int, header string"), ["g"], "_row_id").collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.g or 0, r.col)):
        found.setdefault(r.g or 0, []).append((r.position, r.name, r.header))
    for g, headers in lists.items():
        cleaned = [re.sub(r"\W+", "_", re.sub(r"^(-?\d+)\.0$", r"\1", (h or "").strip())).strip("_") for h in headers]
        bases = [c or f"col_{i}" for i, c in enumerate(cleaned, 1)]
        assert found.get(g, []) == list(zip(range(1, len(headers) + 1), in_order(bases, "_row_id"), headers))


def test_table_names(spark):
    rows = [("a", 1, "Sheet 1"), ("a", 2, "sheet-1"), ("a", 3, "Sheet_1_2"), ("a", 4, "2024"), ("a", 5, "sqlite_x"), ("a", 6, "!"), ("a", 7, "sheet"), ("b", 1, "SHEET 1")]
    got = unique_tables(spark.createDataFrame(rows, "source string, n int, sheet string"), ["source"], "n").orderBy("source", "n").collect()
    assert [r.table_name for r in got] == ["Sheet_1", "sheet_1_2", "Sheet_1_2_2", "t_2024", "t_sqlite_x", "sheet", "sheet_2", "SHEET_1"]


def test_five_thousand_repeats_take_seconds(spark):
    rows = [(1, i, "value" if i % 2 else f"value_{i}") for i in range(5000)] + [(2, i, "Same") for i in range(5000)] + [(3, i, None) for i in range(5000)]
    frame = spark.createDataFrame(rows, "g int, col int, header string").cache()
    frame.count()
    started = time.time()
    got = {}
    for r in unique_names(frame, ["g"], "_row_id").collect():
        got.setdefault(r.g, {})[r.position] = r.name
    assert time.time() - started < 10
    assert [got[1][i] for i in sorted(got[1])] == in_order(["value" if i % 2 else f"value_{i}" for i in range(5000)])
    assert got[2][1] == "Same" and got[2][5000] == "Same_5000" and got[3][7] == "col_7"


def test_names_of_one_table_are_shuffled_once(spark):
    rows = [(g, i, h) for g in (1, 2, None) for i, h in enumerate(["a", "A", "a_2", "the", "b", "b", None, None, "The", ""])]
    named = unique_names(spark.createDataFrame(rows, "g int, col int, header string"), ["g"], "the")
    exchanges = {line.split("Exchange ")[1].split("#")[0] for line in named._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line}
    assert exchanges == {"hashpartitioning(g"}                    # the same one for the simple and the mixed stems
    expected = in_order(["a", "A", "a_2", "the", "b", "b", "col_7", "col_8", "The", "col_10"], "the")
    assert {(r.g, r.position): r.name for r in named.collect()} == {(g, i): n for g in (1, 2, None) for i, n in enumerate(expected, 1)}
