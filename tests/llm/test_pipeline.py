"""The pipeline's rows on the smallest tables: near-duplicate groups and packing by brute force, verdicts and redaction by their operators."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F
from trustframe.llm import pii, quality, quality_rules, queries

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer
    docs = queries.table(spark, SF, "documents")
    good = quality.score(docs, queries.quality_model(spark, SF)).filter(F.col("score") >= queries.KEEP_SCORE).select(*docs.columns)
    texts = {r.doc_id: r.text for r in quality_rules.judge(good).filter("kept").select("doc.*").collect()}
    sets = {}
    for d, t in texts.items():
        w = [x.decode() for x in t.encode().lower().split()]
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    tok = Tokenizer.from_file(queries.TOKENIZER)
    want = {d: len(tok.encode(pii.redacted(t), add_special_tokens=False).ids) + 1 for d, t in texts.items() if group[d] == d}
    assert want and len(want) < len(texts) < docs.count()
    pieces, sequences = collections.Counter(), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.doc_tokens == want[r.doc_id]
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert dict(pieces) == want
    for held in sequences.values():
        ends = [0, *(o + n for o, n in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= queries.WINDOW


TEXTS = {k: " ".join(f"{k}{i % 37}x{i}" for i in range(60)) for k in "abcde"}


def test_near_duplicates_of_repeated_ids(spark):
    """An id with several texts keeps those of its own: a near copy of a smaller row goes, unrelated texts and one of equal rows stay."""
    rows = [(1, TEXTS["a"]), (5, TEXTS["a"] + " z"), (5, TEXTS["b"]), (7, TEXTS["c"]), (7, TEXTS["c"] + " y"), (9, TEXTS["d"]), (9, TEXTS["d"]), (None, TEXTS["a"]), (3, None), (2, "")]
    docs = spark.createDataFrame([(d, t, "s", 1, 2, "k") for d, t in rows], "doc_id long, text string, score string, first int, _id int, component_id string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    sure = [(1, TEXTS["a"]), (5, TEXTS["b"]), (9, TEXTS["d"]), (None, TEXTS["a"]), (3, None), (2, "")]
    assert len(kept) == len(sure) + 1 and all(x in kept for x in sure)
    assert sum(x in kept for x in ((7, TEXTS["c"]), (7, TEXTS["c"] + " y"))) == 1
    single = docs.filter("doc_id IS NULL OR doc_id IN (1, 2, 3)")
    assert sorted(map(repr, corpus_pipeline.near_duplicates(spark, single, SF).collect())) == sorted(map(repr, single.collect()))


def test_stages_take_clashing_missing_and_empty_columns(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text", "lang", "source", F.lit("x").alias("score"), F.lit(1).alias("label"), F.lit("y").alias("Score_0"))
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    hidden = corpus_pipeline.personal_data(spark, docs.limit(5), SF)
    assert hidden.columns == docs.columns and hidden.count() == 5
    empty = queries.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name


def test_classifiers_train_beside_columns_named_label(spark):
    from trustframe.llm import toxicity
    docs = queries.table(spark, SF, "documents").withColumn("label", F.lit("other"))
    labels = queries.table(spark, SF, "labels")
    assert quality.score(docs.limit(3), quality.train(docs, labels)).count() == 3
    assert toxicity.score(docs.limit(3), toxicity.train(docs, labels)).count() == 3


def test_near_duplicates_leave_no_bulk_behind(spark, tmp_path, monkeypatch):
    """What the join writes for itself goes when it is no longer read, and so do the shuffle files of each write."""
    from trustframe import session
    from trustframe.llm import jaccard

    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path))
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other words of a text"), (4, " ".join(words))], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.groups(docs, 5, 80).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1}
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not left & {"jaccard-signatures", "jaccard-share", "jaccard-lists", "jaccard-facts", "jaccard-sets", "jaccard-across", "jaccard-needed"}


def test_materialize_removes_its_shuffle_files(spark, tmp_path, monkeypatch):
    import pathlib
    import time

    from pyspark.sql import functions as F
    from trustframe import session

    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path))
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {str(f) for top in tops for f in pathlib.Path(top).rglob("shuffle_*")}
    before = files()
    rows = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.25)
    assert files() <= before and rows.count() == 7
