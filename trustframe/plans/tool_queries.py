"""Queries on the read tools, the run store's retention, promotion gates, file containers and Arabic stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes as H, rules as R
from ..operators.packing import pack_hash
from ..session import new_folder
from ..sources.inventory import ENCRYPTED_MARK, OLE_MAGIC, container
from ..sources.publish import NotPublished, RunStore
from ..sources.views import Views
from .facts import Facts
from .inputs import load, renamed_orders, star
from .number_queries import RENAMED_SQL, _digest_sql, _orders_facts, _shown
from .read_api import Reader
from .run_queries import PACK, _two_runs


def _containers(spark, sf):
    """Documents as files of five kinds: archive, wrapped by rights management, encrypted office file, old office file, plain."""
    head = F.element_at(F.array(F.lit("504B0304"), F.lit("CAFE01"), F.lit(OLE_MAGIC), F.lit(OLE_MAGIC), F.lit("00")), (F.col("doc_id") % 5 + 1).cast("int"))
    mark = F.when(F.col("doc_id") % 10 < 5, F.unhex(F.lit(ENCRYPTED_MARK))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.unhex(head), F.coalesce(F.col("text"), F.lit("")).cast("binary"), mark)
    path = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 3, ".XLS").otherwise(".xlsx"))
    return load(spark, sf, "documents").select("doc_id", container(path, content, [b"\xca\xfe"]).alias("container"))


CONTAINERS_SQL = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'zip' WHEN doc_id % 5 = 1 THEN 'drm' WHEN doc_id % 10 = 2 THEN 'encrypted' ELSE 'other' END AS container
FROM documents"""


def _retention(spark, sf):
    """Six runs of which the last two fail; the newest two runs, the published one and the one before it keep their facts."""
    store = RunStore(spark, new_folder(spark, "kept-runs"))
    orders = load(spark, sf, "orders")
    for i in range(1, 7):
        store.write(f"r{i}", "counts", orders.filter(f"o_orderkey % 7 <> {i}").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))
        problem = orders.select(F.lit("late").alias("rule_id"), F.lit("fail").alias("status")).limit(1) if i > 4 else None
        try:
            store.finish(f"r{i}", blockers=problem)
        except NotPublished:
            pass
    store.prune(2)
    return spark.read.parquet(f"{store.root}/facts/counts").select("run_id", "o_orderstatus", "n", F.lit(store.current()).alias("published"))


RETENTION_SQL = """SELECT run_id, o_orderstatus, count(*) AS n, 'r4' AS published FROM orders, (VALUES ('r3', 3), ('r4', 4), ('r5', 5), ('r6', 6)) AS r(run_id, i)
WHERE o_orderkey % 7 <> i GROUP BY run_id, o_orderstatus"""


def _traced_rows(spark, sf):
    """The rows with the smallest and the largest key, with their table, file and sheet."""
    origins = load(spark, sf, "orders").select(F.lit("local").alias("source_id"), F.lit("orders").alias("table_name"), F.col("_metadata.file_name").alias("path"),
                                               F.lit("Sheet1").alias("sheet")).distinct()
    reader = Reader(Facts(star(spark, sf, ["orders"])), origins=origins)
    ends = load(spark, sf, "orders").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).first()
    return reader.trace("orders", ends["a"]).unionByName(reader.trace("orders", ends["b"])).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                                                                   "_source", "_table_id", "_path", "_sheet")


TRACED_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'local' AS _source, 'local/sheet-' || sha256('orders')[1:12] AS _table_id,
  'orders.parquet' AS _path, 'Sheet1' AS _sheet FROM orders WHERE o_orderkey IN (SELECT unnest([min(o_orderkey), max(o_orderkey)]) FROM orders)"""


def _sample_tool(spark, sf):
    """A table with fewer rows than the tool shows is shown whole."""
    return Reader(Facts(star(spark, sf, ["nation"]))).sample("nation", 200)


def _digest_tool(spark, sf):
    """The groups of one table, as the digest tool shows them."""
    return _shown(Reader(_orders_facts(spark, renamed_orders(spark, sf))).digest("orders", "by_group"))


DIGEST_TOOL_SQL = f"SELECT * FROM ({_digest_sql(RENAMED_SQL, [('amount', True)], ['status', 'priority'], 'order_date', 'amount')}) WHERE section = 'by_group'"


def _compare_tool(spark, sf):
    """The row changes of two runs."""
    reader = Reader(Facts(star(spark, sf, ["orders"])))
    return reader.compare(H.changes(*_two_runs(spark, sf)), "row").select("kind", "severity", "subject", "before", "after")


COMPARE_SQL = """SELECT 'row' AS kind, 'info' AS severity, 'local/orders' AS subject, 'removed=' || (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 1) AS before,
  'added=' || (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS after
UNION ALL SELECT 'row', 'info', 'local/supplier', 'removed=' || (SELECT count(*) FROM supplier), 'added=' || (SELECT count(*) FROM supplier)"""


def _pack_hashes(spark, sf):
    """One digest per conversation over its turns in order."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    return pack_hash(turns, ["conv_id"], ["turn"], "digest")


PACK_HASHES_SQL = """SELECT conv_id, sha256('[' || string_agg('"' || sha256(text) || '"', ',' ORDER BY turn) || ']')[1:16] AS hash, count(*) AS items
FROM conversations GROUP BY conv_id"""


def _stems(spark, sf):
    """The index tokens of a document's language behind Arabic words with prefixes."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("والكتاب", "بالقلم", "فالولد", "الباب", "للبيت", "كتاب")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return load(spark, sf, "documents").select("doc_id", F.array_join(X.index_tokens(F.concat_ws(" ", word, F.lower("lang"))), "|").alias("tokens"))


STEMS_SQL = """SELECT doc_id, array_to_string(list_filter([['والكتاب', 'بالقلم', 'فالولد', 'الباب', 'للبيت', 'كتاب'][doc_id % 6 + 1], lower(lang),
  ['كتاب', 'قلم', 'ولد', 'باب', 'بيت', NULL][doc_id % 6 + 1]], lambda x: x IS NOT NULL), '|') AS tokens FROM documents"""


def _promotion_gate(spark, sf):
    """The rules that keep a run from being published: errors, and failures of severity error."""
    tables = star(spark, sf, ["orders", "customer", "lineitem"])
    results, _ = R.run_packs(spark, R.parse_packs([PACK]), Views(tables).resolved)
    return R.promotion_blockers(results).select("rule_id", "status", "severity")


GATE_SQL = """SELECT 'broken' AS rule_id, 'error' AS status, 'warn' AS severity
UNION ALL SELECT 'no_small_orders', 'fail', 'error' FROM orders WHERE o_totalprice < 5000 HAVING count(*) > 0"""

QUERIES = {
    "container_kinds_documents": _containers, "store_retention": _retention, "traced_rows": _traced_rows, "sample_tool": _sample_tool, "digest_tool": _digest_tool,
    "compare_tool": _compare_tool, "pack_hashes_conversations": _pack_hashes, "arabic_index_tokens": _stems, "promotion_gate": _promotion_gate,
}
ORACLE = {
    "container_kinds_documents": CONTAINERS_SQL, "store_retention": RETENTION_SQL, "traced_rows": TRACED_SQL, "sample_tool": "SELECT * FROM nation",
    "digest_tool": DIGEST_TOOL_SQL, "compare_tool": COMPARE_SQL, "pack_hashes_conversations": PACK_HASHES_SQL, "arabic_index_tokens": STEMS_SQL, "promotion_gate": GATE_SQL,
}
