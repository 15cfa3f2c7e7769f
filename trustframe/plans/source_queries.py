"""Queries on files, e-mails, run logs and streams, all derived from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import runlog as L
from ..operators.frequencies import value_number, value_text
from ..session import new_folder
from ..sources import documents as D, inventory as I, journal as J
from ..streaming import ingest
from ..tables import Table, TableSet
from .inputs import load


# ---- files ------------------------------------------------------------------------------------------------------
def document_files(spark, sf):
    """Documents as files (path, length, modificationTime, content)."""
    d = load(spark, sf, "documents")
    content = F.encode(F.col("text"), "UTF-8")
    return d.select("doc_id", F.concat(F.lit("/data/"), "source", F.lit("/Note "), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"),
                    F.octet_length("text").cast("long").alias("length"), F.to_timestamp(F.lit("2024-01-01")).alias("modificationTime"), content.alias("content"))


PATH = "('/data/' || source || '/Note ' || doc_id || '.TXT')"
FILES_SQL = f"(SELECT doc_id, {PATH} AS path, 'note-' || doc_id || '-' || substr(sha1({PATH}), 1, 8) AS source_id, strlen(text) AS size, sha256(text) AS sha256 FROM documents)"


def _inventory(spark, sf):
    return I.inventory(document_files(spark, sf)).select("source_id", "path", "kind", "size", "sha256", "hash_mode", "wrapper")


INVENTORY_SQL = f"SELECT source_id, path, 'txt' AS kind, CAST(size AS BIGINT) AS size, sha256, 'full' AS hash_mode, 'other' AS wrapper FROM {FILES_SQL}"


def _identical(spark, sf):
    return I.identical_content(I.inventory(document_files(spark, sf)))


IDENTICAL_SQL = f"SELECT sha256, count(*) AS copies, min(path) AS first_path FROM {FILES_SQL} GROUP BY 1 HAVING count(*) > 1"


def _two_inventories(spark, sf):
    """The last run missed every fifth file and held another content for every seventh."""
    files = document_files(spark, sf)
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    return I.inventory(files.filter("doc_id % 5 <> 0").withColumn("content", changed)), I.inventory(files)


def _incremental(spark, sf):
    before, now = _two_inventories(spark, sf)
    todo = I.to_process(now, before, "settings-1", "settings-1").select("path", F.lit("process").alias("decision"))
    return todo.unionByName(I.reusable(now, before).select("path", F.lit("reuse").alias("decision")))


INCREMENTAL_SQL = f"SELECT path, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'process' ELSE 'reuse' END AS decision FROM {FILES_SQL}"


def _freshness(spark, sf):
    before, now = _two_inventories(spark, sf)
    return I.freshness(before, now.filter(~F.col("path").endswith("3.TXT")), deep=True)


FRESHNESS_SQL = f"""SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'added' ELSE 'content_changed_same_metadata' END AS reason FROM {FILES_SQL}
  WHERE (doc_id % 10 = 3 AND doc_id % 5 <> 0) OR (doc_id % 10 <> 3 AND (doc_id % 5 = 0 OR doc_id % 7 = 0))"""


def _decode(spark, sf):
    return document_files(spark, sf).select("doc_id", F.sha2(D.decode("content"), 256).alias("text"))


DECODE_SQL = "SELECT doc_id, sha256(text) AS text FROM documents"


def _csv(spark, sf):
    """Orders written with one delimiter and customers with another, told apart by their first lines."""
    folder = new_folder(spark, "csv")
    load(spark, sf, "orders").select("o_orderkey", "o_totalprice").write.option("sep", ";").option("header", "true").csv(f"{folder}/orders")
    load(spark, sf, "customer").select("c_custkey", "c_name").write.option("sep", "|").option("header", "true").csv(f"{folder}/customers")
    frames = D.read_csv(spark, [f"{folder}/orders", f"{folder}/customers"])
    parts = None
    for f in frames:
        first, second = f.columns[0], f.columns[1]
        one = f.agg(F.lit(first).alias("key_column"), F.lit(second).alias("value_column"), F.count(F.lit(1)).alias("n"),
                    F.sum(F.col(first).cast("long")).alias("key_sum"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


CSV_SQL = """SELECT 'o_orderkey' AS key_column, 'o_totalprice' AS value_column, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
UNION ALL SELECT 'c_custkey', 'c_name', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer"""


def _mail(spark, sf):
    """Each turn as an e-mail with a text attachment; the attachment is opened, an image is not."""
    c = load(spark, sf, "conversations")
    raw = F.concat(F.lit("From: "), "role", F.lit("@example.com\r\nTo: desk@example.com\r\nSubject: Conversation "), F.col("conv_id").cast("string"),
                   F.lit("\r\nDate: Tue, 12 Mar 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"cut\"\r\n\r\n--cut\r\n"
                         "Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
                   F.base64(F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8")),
                   F.lit("\r\n--cut\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Disposition: attachment; filename=\"note.txt\"\r\n\r\nturn "),
                   F.col("turn").cast("string"),
                   F.lit("\r\n--cut\r\nContent-Type: image/png\r\nContent-Disposition: attachment; filename=\"logo.png\"\r\n\r\nxx\r\n--cut--\r\n"))
    files = c.select(F.concat_ws("-", "conv_id", "turn").alias("source_id"), F.lit("").alias("part"), F.lit("mail.eml").alias("name"),
                     F.encode(raw, "UTF-8").alias("content"))
    return D.read_documents(files)


def _mail_blocks(spark, sf):
    blocks, _ = _mail(spark, sf)
    return blocks.groupBy("source_id", "part", "kind").agg(F.count(F.lit(1)).alias("blocks"))


MAIL_SQL = """WITH c AS (SELECT conv_id || '-' || turn AS source_id, len(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'),
  lambda x: trim(x)), lambda x: x <> '')) AS n FROM conversations)
SELECT source_id, '' AS part, 'email_header' AS kind, CAST(1 AS BIGINT) AS blocks FROM c UNION ALL SELECT source_id, '', 'email_body', n FROM c WHERE n > 0
UNION ALL SELECT source_id, 'note.txt', 'paragraph', 1 FROM c"""


def _attachments(spark, sf):
    _, attachments = _mail(spark, sf)
    return attachments.groupBy("name", "kind", "status", "note").agg(F.count(F.lit(1)).alias("n"))


ATTACHMENTS_SQL = """SELECT 'note.txt' AS name, 'txt' AS kind, 'read' AS status, '' AS note, count(*) AS n FROM conversations
UNION ALL SELECT 'logo.png', 'png', 'skipped', 'not a readable kind', count(*) FROM conversations"""


# ---- run logs ---------------------------------------------------------------------------------------------------
def run_events(spark, sf):
    """One run per customer, one stage per order: it ends ten seconds after it starts, and fails for status F."""
    o = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    run, name = F.col("o_custkey").cast("string"), F.concat(F.lit("stage-"), key.cast("string"))
    failed = (F.col("o_orderstatus") == "F") & (key % 10 == 0)

    def event(offset, kind, level, message, **data):
        pairs = [x for k, v in data.items() for x in (F.lit(k), v)]
        return F.struct(run.alias("run_id"), (key * 100 + offset).cast("double").alias("t"), F.lit(kind).alias("kind"),
                        (F.lit(level) if isinstance(level, str) else level).alias("level"), message.alias("message"),
                        F.create_map(F.lit("stage"), name).alias("scope"),
                        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("data"))

    events = [event(0, "stage.start", "info", name, name=name),
              F.when(failed, event(5, "error", "error", F.concat(F.lit("broke "), name), code=F.lit("E_DATA"))),
              F.when(key % 4 == 0, event(6, "warning", "warn", F.lit("slow"), name=name)),
              event(8, "sheet.end", "info", F.lit(""), name=name, source_id=F.lit("s1"), rows=(key % 50).cast("string")),
              event(10, "stage.end", "info", name, name=name, status=F.when(failed, "failed").otherwise("passed"))]
    return o.select(F.explode(F.array_compact(F.array(*events))).alias("e")).select("e.*")


def _written_events(spark, sf):
    """The events as JSON lines, with damaged lines in between."""
    folder = new_folder(spark, "journal")
    lines = run_events(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    broken = load(spark, sf, "nation").select(F.concat(F.lit('{"run_id": "'), "n_name", F.lit('", "t": 1.0, "kind"')).alias("value"))
    lines.unionByName(broken).write.text(folder)
    return folder


def _stages(spark, sf):
    s = L.stages(J.read_events(spark, _written_events(spark, sf)))
    return s.select("run_id", "stage", "started", "seconds", "status")


STAGES_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS run_id, 'stage-' || o_orderkey AS stage, CAST(o_orderkey * 100 AS DOUBLE) AS started, CAST(10 AS DOUBLE) AS seconds,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'failed' ELSE 'passed' END AS status FROM orders"""


def _run_totals(spark, sf):
    e = run_events(spark, sf).withColumn("seq", F.monotonically_increasing_id())
    warned = L.warnings_by_stage(e).groupBy("run_id").agg(F.count(F.lit(1)).alias("warned_stages"))
    return L.totals(e).join(warned, "run_id", "left").select("run_id", "events", "errors", "warnings", "elapsed", "rows",
                                                             F.coalesce("warned_stages", F.lit(0)).alias("warned_stages"))


TOTALS_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS run_id, 3 * count(*) + count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 10 = 0) + count(*) FILTER (o_orderkey % 4 = 0) AS events,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 10 = 0) AS errors, count(*) FILTER (o_orderkey % 4 = 0) AS warnings, CAST(max(o_orderkey) * 100 + 10 AS DOUBLE) AS elapsed,
  CAST(sum(o_orderkey % 50) AS BIGINT) AS rows, count(*) FILTER (o_orderkey % 4 = 0) AS warned_stages FROM orders GROUP BY o_custkey"""


def _root_cause(spark, sf):
    e = run_events(spark, sf).withColumn("seq", F.monotonically_increasing_id())
    return L.root_cause(e).select("run_id", "stage", "message", "code", "downstream")


ROOT_CAUSE_SQL = """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0)
SELECT CAST(o_custkey AS VARCHAR) AS run_id, 'stage-' || min(o_orderkey) AS stage, 'broke stage-' || min(o_orderkey) AS message, 'E_DATA' AS code, count(*) - 1 AS downstream FROM f GROUP BY o_custkey"""


def _context(spark, sf):
    e = run_events(spark, sf).withColumn("seq", F.monotonically_increasing_id())
    return L.failure_context(e).groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("t").alias("last"))


CONTEXT_SQL = """WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0 GROUP BY 1)
SELECT CAST(o.o_custkey AS VARCHAR) AS run_id, CAST(least(13, sum(CASE WHEN o_orderkey = k THEN 2 WHEN o_orderkey < k THEN 3 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END ELSE 0 END)) AS BIGINT) AS events,
  CAST(max(k) * 100 + 5 AS DOUBLE) AS last FROM orders o JOIN f ON o.o_custkey = f.o_custkey GROUP BY o.o_custkey"""


# ---- streams ----------------------------------------------------------------------------------------------------
def _stream_frequencies(spark, sf):
    """Frequencies of orders kept by a stream over its file: equal to one batch pass."""
    schema = load(spark, sf, "orders").schema
    store, checkpoint = new_folder(spark, "stream-store"), new_folder(spark, "stream-checkpoint")

    def make(df):
        return Table("orders", df, "o_orderkey")

    ingest.keep_frequencies(ingest.watch_parquet(spark, sf, schema, "orders.parquet"), make, store, checkpoint)
    tables = TableSet(spark, [make(load(spark, sf, "orders"))])
    named = tables.columns().select("column_no", "column_name", "kind")
    f = ingest.stored_frequencies(spark, store).join(named, "column_no").filter("column_name IN ('o_custkey', 'o_orderstatus', 'o_orderpriority')")
    return f.select("column_name", value_number(F.col("kind")).alias("value_num"),
                    F.when(F.col("kind") == "text", value_text(F.col("kind"))).alias("value_text"), "cnt", "first_row")


STREAM_SQL = """SELECT 'o_custkey' AS column_name, CAST(o_custkey AS DOUBLE) AS value_num, NULL AS value_text, count(*) AS cnt, min(o_orderkey) AS first_row FROM orders GROUP BY o_custkey
UNION ALL SELECT 'o_orderstatus', NULL, o_orderstatus, count(*), min(o_orderkey) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority', NULL, o_orderpriority, count(*), min(o_orderkey) FROM orders GROUP BY o_orderpriority"""


def _stream_stages(spark, sf):
    folder, checkpoint, out = _written_events(spark, sf), new_folder(spark, "stream-checkpoint"), new_folder(spark, "stages")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    ingest.follow_runs(J.stream_events(spark, folder), sink, checkpoint)
    return ingest.merge_records(spark.read.parquet(out)).select("run_id", "stage", "started", "seconds", "status")


def _stream_late_files(spark, sf):
    """Run logs in four parts, a batch each; the last one, which holds the ends of every seventh stage, comes when the stream has
    long read the others. The merged records equal those of one batch."""
    folder, checkpoint, out = new_folder(spark, "journal"), new_folder(spark, "stream-checkpoint"), new_folder(spark, "stages")
    order = F.floor(F.col("t") / 100)
    part = F.when((F.col("kind") == "stage.end") & (order % 7 == 0), 3).otherwise(F.floor(order / 1000) % 3)
    events = run_events(spark, sf).withColumn("part", part)

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    for n in range(4):
        events.filter(F.col("part") == n).drop("part").select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)
        ingest.follow_runs(J.stream_events(spark, folder), sink, checkpoint)
    return ingest.merge_records(spark.read.parquet(out)).select("run_id", "stage", "started", "seconds", "status")


def _stream_all_columns(spark, sf):
    """Frequencies of all columns of orders, kept over three parts that arrive one after another, a batch each: equal to one pass."""
    folder, store, checkpoint = new_folder(spark, "arriving"), new_folder(spark, "stream-store"), new_folder(spark, "stream-checkpoint")
    orders = load(spark, sf, "orders")

    def make(df):
        return Table("orders", df, "o_orderkey")

    for n in range(3):
        orders.filter(F.col("o_orderkey") % 3 == n).write.mode("append").parquet(folder)
        ingest.keep_frequencies(ingest.watch_parquet(spark, folder, orders.schema), make, store, checkpoint)
    named = TableSet(spark, [make(orders)]).columns().select("column_no", "column_name", "kind")
    f = ingest.stored_frequencies(spark, store).join(named, "column_no")
    day = F.when(F.col("kind").isin("date", "datetime"), F.substring(value_text(F.col("kind")), 1, 10))
    return f.select("column_name", value_number(F.col("kind")).alias("value_num"), F.when(F.col("kind") == "text", value_text(F.col("kind"))).otherwise(day).alias("value_text"), "cnt", "first_row")


STREAM_ALL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {number} AS value_num, {text} AS value_text, count(*) AS cnt, min(o_orderkey) AS first_row FROM orders GROUP BY {c}"
    for c, number, text in [(c, f"CAST({c} AS DOUBLE)", "CAST(NULL AS VARCHAR)") for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [(c, "CAST(NULL AS DOUBLE)", c) for c in ("o_orderstatus", "o_orderpriority")] + [("o_orderdate", "CAST(NULL AS DOUBLE)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)")])


QUERIES = {
    "inventory_documents": _inventory, "identical_content": _identical, "incremental_reuse": _incremental, "freshness": _freshness,
    "decode_documents": _decode, "csv_scan": _csv, "mail_blocks": _mail_blocks, "mail_attachments": _attachments, "runlog_stages": _stages,
    "runlog_totals": _run_totals, "runlog_root_cause": _root_cause, "runlog_context": _context, "stream_frequencies": _stream_frequencies,
    "stream_runlog_stages": _stream_stages, "stream_runlog_late": _stream_late_files, "stream_frequencies_all": _stream_all_columns,
}
ORACLE = {
    "inventory_documents": INVENTORY_SQL, "identical_content": IDENTICAL_SQL, "incremental_reuse": INCREMENTAL_SQL, "freshness": FRESHNESS_SQL,
    "decode_documents": DECODE_SQL, "csv_scan": CSV_SQL, "mail_blocks": MAIL_SQL, "mail_attachments": ATTACHMENTS_SQL, "runlog_stages": STAGES_SQL,
    "runlog_totals": TOTALS_SQL, "runlog_root_cause": ROOT_CAUSE_SQL, "runlog_context": CONTEXT_SQL, "stream_frequencies": STREAM_SQL,
    "stream_runlog_stages": STAGES_SQL, "stream_runlog_late": STAGES_SQL, "stream_frequencies_all": STREAM_ALL_SQL,
}
