"""The registered queries of this subpackage, and the SQL they are checked against where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, jaccard, license_scan, lm_scoring, neighbours, packing, periodic_runs, pii, quality, quality_rules, sharding, toxicity, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 1024
SHARDS = 24
COMPONENTS = 8
KEEP_SCORE = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels.filter(~held_out())))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.FactorisationMachine:
    """Trained on the rows that are not held out."""
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out()))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, WINDOW)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors.filter(F.col("vec_id") % 20 == 0), vectors, k=20)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def listed(name: str) -> F.Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def repeating_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of its words to its end (chosen by the CRC of its id)."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, period), F.ceil((F.col("n") - F.col("a")) / period).cast("int")))
    rebuilt = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return chosen.select("doc_id", F.when(F.col("n") > 0, rebuilt).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(repeating_tails(table(spark, sf_dir, "documents")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    rows = found.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.report(table(spark, sf_dir, "embeddings"), "embedding", COMPONENTS, keep=["vec_id"])
    return rows.select("doc.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.slots(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_quality, op4_bpe, op5_packing, op6_quality_rules, op7_neighbours, op8_pii,
                                   op9_lm_scoring, op10_jaccard, op11_runs, op12_whitening, op13_sharding)}


#: CRC-32 from its table, jumps as a fold over a struct that keeps the last shard below the count.
SHARDING_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t
  FROM (SELECT b, list_reduce(range(0, 8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, b) AS v
        FROM (SELECT unnest(range(0, 256)) AS b))),
measured AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crc_table),
grown AS (
  SELECT *, {jump_now} AS shard, {jump_grown} AS grown_shard
  FROM measured)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, '\\N'), text_crc32::VARCHAR, size::VARCHAR)),
                          doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown_shard
FROM grown
"""
JUMP_SQL = """CAST(list_reduce(range(0, {n}), lambda s, i: CASE WHEN s.done THEN s ELSE
    CASE WHEN floor((s.shard + 1) * (2147483648.0 / (((s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592 + 1)::DOUBLE)) < {n}
         THEN {{'k': (s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT, 'done': false,
               'shard': floor((s.shard + 1) * (2147483648.0 / (((s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592 + 1)::DOUBLE))::BIGINT}}
         ELSE {{'k': s.k, 'done': true, 'shard': s.shard}} END END,
    {{'k': ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 16))::UBIGINT::HUGEINT, 'done': false, 'shard': 0::BIGINT}}).shard AS INTEGER)"""
#: Words of whole texts as lists, A-Z lower-cased; rows are told apart by a number, as ids may repeat.
WORDS_SQL = """listed AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents)"""
LM_SQL = f"""
WITH {WORDS_SQL},
placed AS (SELECT r, unnest(words) AS g1, generate_subscripts(words, 1) AS i FROM listed),
pairs AS (SELECT r, i, g1, lag(g1) OVER x AS before, lag(g1) OVER x || ' ' || g1 AS g2 FROM placed WINDOW x AS (PARTITION BY r ORDER BY i)),
triples AS (SELECT r, i, g1, g2, before, lag(g2) OVER x AS before2, lag(before) OVER x || ' ' || g2 AS g3 FROM pairs WINDOW x AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT g1 AS g, count(*) AS c FROM placed GROUP BY 1),
c2 AS (SELECT g2 AS g, count(*) AS c FROM pairs WHERE g2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT g3 AS g, count(*) AS c FROM triples WHERE g3 IS NOT NULL GROUP BY 1),
scored AS (
  SELECT t.r, CASE WHEN three.c >= 2 THEN ln(three.c / two_before.c)
                   WHEN two.c >= 2 THEN ln(two.c / one_before.c) + CASE WHEN t.g3 IS NOT NULL THEN ln(0.4) ELSE 0 END
                   ELSE ln(one.c / (SELECT count(*) FROM placed)) + CASE WHEN t.g3 IS NOT NULL THEN 2 * ln(0.4) WHEN t.g2 IS NOT NULL THEN ln(0.4) ELSE 0 END
              END AS s
  FROM triples t JOIN c1 one ON one.g = t.g1 LEFT JOIN c2 two ON two.g = t.g2 LEFT JOIN c3 three ON three.g = t.g3
  LEFT JOIN c1 one_before ON one_before.g = t.before LEFT JOIN c2 two_before ON two_before.g = t.before2)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(s, 0), 6) AS log_score
FROM listed LEFT JOIN (SELECT r, fsum(s) AS s FROM scored GROUP BY r) USING (r)
"""
#: Inner products in double precision, summed in the order of the components.
NEIGHBOURS_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
#: Links by an inverted index of the shingles; a pair's size of intersection decides.
JACCARD_SQL = f"""
WITH RECURSIVE {WORDS_SQL},
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                                 ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS s
  FROM listed),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) m ON m.a = d.doc_id
"""
ORACLE: dict[str, str] = {"op7_neighbours": NEIGHBOURS_SQL, "op9_lm_scoring": LM_SQL, "op10_jaccard": JACCARD_SQL,
                          "op13_sharding": SHARDING_SQL.format(jump_now=JUMP_SQL.format(n=SHARDS), jump_grown=JUMP_SQL.format(n=SHARDS + 1))}
