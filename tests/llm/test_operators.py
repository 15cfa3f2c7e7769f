"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, copies and clashing columns."""

import collections
import math
import os
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trustframe import session
from trustframe.llm import bpe, components, jaccard, license_scan, lm_scoring, neighbours, packing, pii, quality, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids int, part int, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture_texts():
    rng = random.Random(4)
    vocab = ["the", "of", "and", *["w" + str(i) for i in range(150)]]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(25, 160))) for _ in range(24)]
    for base in texts[:6]:
        words = base.split()
        for edits in (0, 1, 2, 6):
            other = list(words)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "x" + str(rng.randrange(99))
            texts.append(" ".join(other))
    texts += [None, "", "   \n\t", "one", "one two", "ONE two", "Ünïcödé text here 漢字 🙂 " * 30, "same line\nsame line\n" * 40, " \n" * 50, "long " * 30_000,
              "mail a.b@example.com or 10.0.0.1 and 4111 1111 1111 1111 call +1 (415) 555-0100", texts[0]]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), 0.5, 1, 2, True) for i, t in enumerate(fixture_texts())]
    rows += [(None, "a row without an id " * 5, "en", "s", 3, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bpe_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoder(path, public_tokenizers.PATTERN)
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, piece_chars=500), path, public_tokenizers.PATTERN).collect()
    same_rows([(r.doc_id, list(r.ids), bytes(r.decoded)) for r in got], [(d, enc.full.encode_ordinary(t), t.encode()) for d, t in texts_of(docs)])


def test_bpe_cuts_are_safe():
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, 5)
    rng, pool = random.Random(1), [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "é", "'s", "1", "!", "漢", "The"]
    for _ in range(800):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert enc.encode(text) == enc.full.encode_ordinary(text)
    assert len(enc.encode("a" + " " * 400_000 + "b")) > 1


def test_packing(docs):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, window = Tokenizer.from_file(path), 64
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, window).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in {d: t for d, t in texts_of(docs) if d is not None}.items():
        ids, at = tok.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for seq, held in sequences.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == window or seq == max(sequences)


def test_quality_rules_base(docs):
    got = quality_rules.judge(docs, ["doc_id"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for d, t in texts_of(docs):
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        times = collections.Counter(runs)
        covered = {i + k for i, run in enumerate(runs) if times[run] > 1 for k in range(8)}
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
                     len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    same_rows([tuple(r) for r in got], want)


def test_quality_rules_junk_is_no_reference(spark):
    """A third of all rows and most characters are junk; one junk row is all there is of its language."""
    rng = random.Random(5)
    vocab = [*quality_rules.COMMON_WORDS["en"], *["plain" + chr(97 + i) for i in range(26)]]
    clean = [" ".join(rng.choice(vocab) for _ in range(rng.randint(60, 90))) + "." for _ in range(60)]
    junk = [" ".join(f"word{'$$$' if k % 2 else '###'}{i * 300 + k}" for k in range(300)) for i in range(31)]
    spanish = " ".join(rng.choice(quality_rules.COMMON_WORDS["es"]) for _ in range(80))
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(1000 + i, t, "en") for i, t in enumerate(junk[:30])] + [(2000, junk[30], "xx"), (3000, spanish, "es"), (3001, None, None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).select("doc.doc_id", "base_failed", "word_distance", "kept").collect()}
    assert len(got) == len(rows) and not any(r.base_failed for d, r in got.items() if d != 3001)
    assert all(got[i].kept for i in range(60)) and not any(r.kept for d, r in got.items() if 1000 <= d <= 2000)
    assert got[3000].kept and got[3000].word_distance > 0 and not got[3001].kept


def test_jensen_shannon(spark):
    row = spark.range(1).select(*[quality_rules.jensen_shannon(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias(n) for n, a, b in (
        ("same", [1, 3], [2, 6]), ("apart", [1, 0], [0, 5]), ("none", [0, 0], [1, 1]))]).first()
    assert row.same == pytest.approx(0, abs=1e-9) and row.apart == pytest.approx(1) and row.none is None


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard_groups(docs, words, percent):
    sets = {}
    for d, t in texts_of(docs):
        w = [x.decode() for x in t.encode().lower().split()]
        if d is not None:
            sets[d] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    got = jaccard.groups(docs, words, percent).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(d, len(s), group[d]) for d, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_miss_no_link(percent):
    rng, rule = np.random.default_rng(5), jaccard.Scheme(percent)
    for _ in range(400):
        n = int(np.exp(rng.uniform(0, 7)))
        base = rng.integers(0, 2**64, size=2 * n + 10, dtype=np.uint64)
        gone, new = rng.integers(0, n * (100 - percent) // 100 + 1), rng.integers(0, n * (100 - percent) // percent + 1)
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[gone:n], base[n:n + new]]))
        if len(b) and 100 * (n - gone) >= percent * (n + new):
            assert len(np.intersect1d(rule.signatures(a), rule.signatures(b)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_lists_that_share_a_hub_are_merged(spark):
    """Near texts that share hundreds of lists meet once; lists that share their hub alone stay as they are."""
    near = [(s, d, d) for s in range(300) for d in (1, 2, 3)]
    apart = [(1000 + s, d, d) for s in range(20) for d in (50, *range(100 + 30 * s, 130 + 30 * s))]
    lists = spark.createDataFrame(near + apart, "signature long, doc_id long, part long")
    rows = jaccard.merged(lists).collect()

    def met(entries):
        by = collections.defaultdict(set)
        for signature, doc_id, part in entries:
            assert doc_id == part
            by[signature].add(doc_id)
        return collections.Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    before, after = met(near + apart), met(map(tuple, rows))
    assert set(before) <= set(after) and len(rows) == 3 + len(apart)
    assert before[1, 2] == 300 and after[1, 2] == 1 and sum(after.values()) <= sum(before.values())


def test_components_grow_by_edges(spark):
    known = components.connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    got = components.grown(known, spark.createDataFrame([(3, 8), (20, 21)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 20: 20, 21: 20} and len(got) == 7


def test_joins_without_broadcasts(spark):
    """Many small joins leave no relations with the driver, and the setting is put back."""
    before = {k: spark.conf.get(k, None) for k in session.NO_BROADCASTS}
    small = spark.range(50)
    seen = []

    class Probe:
        def __init__(self, frame):
            self.frame, self.sparkSession, self.schema = frame, frame.sparkSession, frame.schema

        @property
        def write(self):
            seen.append(self.frame.join(small, "id")._jdf.queryExecution().executedPlan().toString())
            return self.frame.write
    assert session.materialize(Probe(small), "probe", broadcasts=False).count() == 50
    assert "BroadcastExchange" not in seen[0] and before == {k: spark.conf.get(k, None) for k in session.NO_BROADCASTS}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, order):
    words = [(d, t.encode().lower().split()) for d, t in texts_of(docs)]
    counts = collections.Counter(tuple(w[i:i + n]) for _, w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def log_s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 2 else math.log(0.4) + log_s(gram[1:])
    want = sorted((d or -1, len(w), round(sum(log_s(tuple(w[max(0, i - order + 1):i + 1])) for i in range(len(w))), 4) + 0.0) for d, w in words)
    got = sorted((r.doc_id or -1, r.n_words, round(r.log_score, 4) + 0.0) for r in lm_scoring.score(docs, order, unit_chars=20_000).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)


def test_count_table_of_units_read_in_parts(docs):
    """Units that many tasks read in pieces give the same count table."""
    tagged = lm_scoring.units(docs, 3_000)
    whole, cut = (lm_scoring.counts(lm_scoring.exploded(t, 3)).collect() for t in (tagged, tagged.repartition(7)))
    assert len(whole) > 100
    same_rows([tuple(r) for r in cut], [tuple(r) for r in whole])


def test_neighbours_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(600)] + [(i, [0.5] * 6) for i in range(600, 900)]
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [None] * 6), (1004, []), (None, [1.0] * 6), (1005, [float("inf")] * 6)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    got = collections.defaultdict(list)
    for r in neighbours.nearest(vectors.filter("vec_id % 20 = 0"), vectors, k=20, shard_rows=200, query_block=15).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in exact if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-float((exact[q] * v).sum()), i) for i, v in exact.items() if i != q)[:20]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
    relaxed = neighbours.nearest(vectors.filter("vec_id % 20 = 0"), vectors, k=20, relax=1.5, shard_rows=200).collect()
    hits = sum(r.vec_id in {i for _, i, _ in got[r.query_id]} for r in relaxed)
    assert hits >= 0.5 * sum(map(len, got.values()))
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_plain_spans_equal_regular_expressions():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng, pool = random.Random(1), [*"a@.1 -+()0", "12", "1.2.3.4", "@b.c", "+1 ", "4111111111111111", "é", "٣", "255"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        want = {}
        for kind, pattern in kinds.items():
            spans = []
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii._luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
                spans += [m.span()] if fine else []
            want[kind] = spans
        assert pii.plain_spans(text) == want


def test_disguised_spans():
    for text, want in (("mail john (at) example (dot) com now", "email:5:32"), ("john at example dot com", "email:0:23"), ("ｊｏｈｎ＠ｅｘ．ｃｏｍ", "email:0:11"),
                       ("call plus one two three four five six seven eight nine zero one", "phone:5:63"), ("one nine two dot one six eight dot zero dot one", "ip:0:47"),
                       ("meet me at home. dot the i", ""), ("nothing here", "")):
        assert pii.listed(pii.spans(text)[1]) == want
    assert pii.redacted("x a@b.co y") == "x <email> y" and pii.redacted(None) is None


@pytest.mark.parametrize("kind, text", [
    ("ip", "192 dot 168 dot 0 dot 17"), ("ip", "10(dot)0(dot)0(dot)5"), ("ip", "10[.]0[.]0[.]5"), ("ip", "192.168.one.17"), ("ip", "zehn 192 punkt 168 punkt null punkt 17"),
    ("phone", "+49 30 1234567 five"), ("phone", "+49 301234567 five"), ("phone", "plus four nine (three zero) one two three four five six seven"),
    ("phone", "plus vier neun drei null eins zwei drei vier fünf sechs"), ("phone", "plus trois trois un deux trois quatre cinq six sept huit"),
    ("phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete"), ("card", "4111 1111 1111 111 one"), ("phone", "+๔๙ ๓๐ ๑๒๓๔๕๖๗"), ("ip", "𝟏𝟎.𝟎.𝟎.𝟓"),
    ("email", "jane.doe at example.com"), ("email", "jane @ example . com"), ("email", "jane @ example.com"), ("email", "jane (punkt) doe (at) example (punkt) de"),
    ("email", "juan arroba ejemplo punto es"), ("email", "jean point dupont arobase exemple point fr")])
def test_disguises(kind, text):
    found = pii.spans(f"so {text}, yes")[1]
    start = 3 + 5 * text.startswith("zehn")
    assert (start, 3 + len(text)) in found[kind], found


def test_prose_is_no_disguise():
    for text in ("at this point in time one of two", "the site is available at example.com now", "3 apples @ 3.50 each", "see you at 10.30 on Sept 12", "from one to nine. dot the i", "one " * 50_000, "1" * 50_000 + "a"):
        assert pii.listed(pii.spans(text)[1]) == "", text[:60]


def test_disguised_addresses_of_any_length():
    for name, host in (("n" * 70, "example (dot) com"), ("n" * 5_000, "h" * 300 + " dot com"), ("jane", " dot ".join("abcdefghijk") + " dot example dot com"),
                       (".".join("abcdefghijklmnop"), "a.b.c.d.e.f.g.h.i.j.k.example.com")):
        text = f"so {name} (at) {host}, yes"
        assert (3, len(text) - 5) in pii.spans(text)[1]["email"], text[:80]
    for text in ("a dot " * 60_000, "a at " * 60_000, "a (dot) " * 40_000 + "(at) b", "x" * 300_000 + " (at) y", "a" + " " * 200_000 + "at b dot c"):
        pii.spans(text)                             # linear: minutes otherwise


def test_pii_keeps_rows(docs):
    assert pii.find(docs).count() == docs.count()
    assert pii.redact(docs).columns == docs.columns


def test_license_scan_by_brute_force(spark):
    """Whole texts and lines against a plain version of the canonical form, over long and repeated rows and clashing columns."""
    def canonical(text):
        text = " " + re.sub(license_scan.PUNCTUATION, " ", re.sub(license_scan.COPYRIGHT_LINE, " ", text or "").lower()) + " "
        tokens = text.split(" ")
        for old, new in license_scan.EQUIVALENT:
            old, out, i = old.split(" "), [], 0
            while i < len(tokens):
                hit = tokens[i:i + len(old)] == old
                out += new.split(" ") if hit else [tokens[i]]
                i += len(old) if hit else 1
            tokens = out
        return " ".join(tokens).strip(" ")
    known = {canonical(t): n for n, t in license_scan.KNOWN}
    rng = random.Random(8)
    parts = [t for _, t in license_scan.KNOWN] + ["MIT licence licence licences", "Copyright (c) 2020 Someone", "prose about a licence", "", "more prose", "SPDX-License-Identifier:  mit"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(120)] + [t.upper() for _, t in license_scan.KNOWN]
    texts += [None, "", "Released under the MIT licence.\n" * 3_000, "word " * 60_000 + "\nLicensed under CC BY 4.0.", texts[0], texts[0]]
    rows = [(i if i % 7 else None, t, "x", 1, "y", 2) for i, t in enumerate(texts)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, digest string, row int, license_id string, t int"), license_scan.known_digests(spark)).collect()
    want = []
    for doc, text, *_ in rows:
        hits = [known[c] for line in (text or "").split("\n") if re.search(license_scan.NOTICE, line) and (c := canonical(line)) in known]
        want.append((doc, known.get(canonical(text)), ",".join(sorted(set(hits))), len(hits)))
    same_rows([(r.doc_id, r.license_id, r.notices, r.n_notice_lines) for r in got], want)
    twice = spark.createDataFrame([("MIT licence licence licences licences",)], "t string").select(license_scan.canonical(F.col("t")).alias("c")).first().c
    assert twice == "mit license license licenses licenses"


def test_license_scan(spark):
    body = license_scan.MIT_BODY.replace('"', "”").upper()
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + body), (2, "prose\nReleased  under the MIT Licence!\nmore"), (3, None), (4, ""), (5, license_scan.MIT_BODY + " extra"), (2, "prose")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_digests(spark)).collect()
    assert sorted((r.doc_id, r.license_id or "", r.notices) for r in got) == [(1, "MIT", ""), (2, "", ""), (2, "", "MIT"), (3, "", ""), (4, "", ""), (5, "", "")]


def test_known_licenses_at_any_width(spark):
    """Each known text, wrapped at several widths below a notice of its own, and each one-line notice among other lines."""
    head = ["", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n", "Copyright The Authors\n\n", "  © 2019 Someone\n"]
    cases = [(name, head[i % 4] + "\n".join(textwrap.fill(part, width, break_long_words=False, break_on_hyphens=False) for part in text.split("\n")))
             for name, text in license_scan.KNOWN for i, width in enumerate([9, 25, 40, 60, 66, 72, 76, 79, 80, 100])]
    for name in ("Apache-2.0", "MPL-2.0", "CC0-1.0"):      # texts of the system, if it has them
        path = f"/usr/share/common-licenses/{name}"
        whole = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
        cases += [(name, "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) if "Copyright [" not in p else p for p in re.split(r"\n[ \t]*\n", whole))) for width in (60, 79, 200) if whole]
    isc = next(t for n, t in license_scan.KNOWN if n == "ISC")
    cases.append(("ISC", isc.replace("that the above copyright", "that the above\ncopyright")))
    lines = [(n, f"prose\n{t}\nmore") for n, t in license_scan.KNOWN if len(t) < 100]
    rows = [(i, t) for i, (_, t) in enumerate(cases + lines)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_digests(spark)).collect()}
    assert [got[i].license_id for i in range(len(cases))] == [n for n, _ in cases]
    assert [got[len(cases) + i].notices for i in range(len(lines))] == [n for n, _ in lines]


def test_classifiers(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "plain", "words", "here"]) for _ in range(60)) + (" *** ### $$$" * 20 if i % 3 == 0 else "") + (" idiot moron" if i % 5 == 0 else ""), 100)
            for i in range(300)] + [(900, None, None), (901, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(0, 300, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(scores) == 302 and all(0 <= s <= 1 for s in scores.values())
    assert sum((scores[i] >= 0.5) == (i % 3 != 0) for i in range(1, 300, 2)) >= 145
    toxic = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert sum(toxic[i].toxic == (i % 5 == 0) for i in range(1, 300, 2)) >= 145
    nothing = labels.limit(0)
    assert all(abs(r.score - 0.5) < 0.2 for r in quality.score(docs.select("doc_id", "text"), quality.train(docs, nothing)).collect())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert jaccard.groups(empty).count() == 0 and lm_scoring.score(empty).count() == 0 and packing.pack(empty, path).count() == 0
    assert quality_rules.judge(empty).count() == 0 and pii.find(empty).count() == 0
    assert license_scan.scan(empty, license_scan.known_digests(spark)).count() == 0


def test_score_identity():
    """The sum-of-squares form equals the sum over pairs."""
    fm = quality.FactorisationMachine(50, 4)
    fm.w = np.linspace(-1, 1, 50)
    ids = np.array([3, 7, 20])
    x = quality._values(ids)
    pairs = sum(float(fm.v[ids[i]] @ fm.v[ids[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    raw = fm.bias + float(fm.w[ids] @ x) + pairs
    assert fm.score([ids])[0] == pytest.approx(1 / (1 + math.exp(-raw)))




def test_packing_holds_one_vocabulary_and_few_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = packing._Tokenizer(path)
    assert tokenizer.ids("plain words") and "library" not in vars(tokenizer)    # the library's copy waits for a text that needs it
    special = tokenizer.special[0]
    assert list(np.frombuffer(tokenizer.ids(f"a {special} b"), np.uint32)) == tokenizer.library.encode(f"a {special} b", add_special_tokens=False).ids
    kept, given = spark.conf.get(session.BATCH, None), {}

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    for rows in (None, 100):
        got = session.materialize(spark.range(3000).coalesce(1).mapInArrow(sizes, "n long"), "batches", rows)
        given[rows] = [r.n for r in got.collect()]
    assert sum(given[100]) == 3000 and max(given[100]) == 100 and len(given[None]) == 1
    assert spark.conf.get(session.BATCH, None) == kept
