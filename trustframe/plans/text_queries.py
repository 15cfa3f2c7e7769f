"""Queries on text: normal forms, blocks, entities, search, reading, linking, proof and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V, names as N, text as X
from ..functions.dates import month_key, serial_to_iso
from ..functions.numbers import display_number, parse_number
from ..operators import blocks as B, find as W, grounding as G, links as L, packing as P, search as S, search_index as XI
from ..operators.frequencies import value_frequencies
from ..session import new_folder
from ..tables import Table, TableSet
from .facts import Facts
from .inputs import load, star


# ---- normal forms -----------------------------------------------------------------------------------------------
def _text_forms(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded"), X.token_estimate(F.col("text")).alias("tokens"),
                    F.size(X.index_tokens(F.col("text"))).cast("long").alias("words"))


# whitespace as Unicode sees it
WS = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _fold_sql(c):
    return (f"trim(regexp_replace(translate(regexp_replace(replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ'), "
            f"'[\\x{{64B}}-\\x{{652}}\\x{{670}}]', '', 'g'), 'أإآٱةىؤئ_-ـ', 'ااااهيوي  '), '{WS}', ' ', 'g'))")


def _tokens_sql(c):
    return f"list_filter(regexp_split_to_array(strip_accents({_fold_sql(c)}), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"


ASCII = "length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))"
TEXT_FORMS_SQL = f"""SELECT doc_id, sha256({_fold_sql('text')}) AS folded,
  CAST(ceil((2 * {ASCII} + 7 * (length(text) - {ASCII})) / 7.0) AS BIGINT) AS tokens, CAST(len({_tokens_sql('text')}) AS BIGINT) AS words FROM documents"""


def _scalars(spark, sf):
    o = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    shown = F.when(key % 3 == 0, F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))).when(
        key % 3 == 1, F.concat((key % 500).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("P-"), key.cast("string")))
    return o.select(
        "o_orderkey", F.round(parse_number(shown), 6).alias("parsed"), N.column_letters(key + 1).alias("letters"),
        N.column_number(N.column_letters(key + 1)).cast("long").alias("number"), month_key(F.col("o_orderdate")).alias("month"),
        display_number(F.col("o_totalprice")).alias("display"),
        serial_to_iso((key + 61).cast("double"), F.lit("date"), F.lit(False)).alias("serial_date"),
        N.clean_identifier(F.col("o_orderpriority")).alias("identifier"),
        X.is_totals_label(F.concat("o_orderpriority", F.lit(" Total"))).alias("is_total"))


SCALARS_SQL = """SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN -o_totalprice WHEN 1 THEN (o_orderkey % 500) / 100 END, 6) AS parsed,
  CASE WHEN o_orderkey >= 702 THEN chr(CAST(65 + ((o_orderkey // 26 - 1) // 26 - 1) % 26 AS INT)) ELSE '' END ||
  CASE WHEN o_orderkey >= 26 THEN chr(CAST(65 + (o_orderkey // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + o_orderkey % 26 AS INT)) AS letters,
  o_orderkey + 1 AS number, strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN format('{:,}', CAST(o_totalprice AS BIGINT)) ELSE format('{:,.2f}', o_totalprice) END AS display,
  strftime(DATE '1899-12-30' + CAST(o_orderkey + 61 AS INT), '%Y-%m-%d') AS serial_date,
  trim(regexp_replace(trim(o_orderpriority), '\\W+', '_', 'g'), '_') AS identifier, true AS is_total FROM orders"""


# ---- blocks -----------------------------------------------------------------------------------------------------
def line_blocks(spark, sf):
    """One block per non-empty line of a document."""
    d = load(spark, sf, "documents")
    return B.text_blocks(d, F.col("doc_id"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


def _paragraphs(spark, sf):
    return line_blocks(spark, sf).select("source_id", F.col("ord").cast("long").alias("ord"), F.sha2("text", 256).alias("text"))


LINES = f"""SELECT CAST(doc_id AS VARCHAR) AS source_id, generate_subscripts(l, 1) AS ord, unnest(l) AS text FROM
  (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}]*\\n'),
   lambda x: regexp_replace(regexp_replace(x, '^{WS}', ''), '{WS}$', '')), lambda x: x <> '') AS l FROM documents)"""
PARAGRAPHS_SQL = f"SELECT source_id, CAST(ord AS BIGINT) AS ord, sha256(text) AS text FROM ({LINES})"


def _markdown(spark, sf):
    """Conversations as Markdown: the conversation is the title, each turn a section, each line a paragraph."""
    c = load(spark, sf, "conversations").withColumn("body", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    doc = c.select("conv_id", "turn", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n## Turn "),
                                               F.col("turn").cast("string"), F.lit("\n"), F.col("role"), F.lit("\n\n| role | turn |\n|---|---|\n| "),
                                               F.col("role"), F.lit(" | "), F.col("turn").cast("string"), F.lit(" |\n\n"), F.col("body")).alias("md"))
    return doc, F.concat_ws("/", "conv_id", "turn")


def _markdown_blocks(spark, sf):
    doc, sid = _markdown(spark, sf)
    return B.markdown_blocks(doc, sid, F.col("md")).select("source_id", F.col("ord").cast("long").alias("ord"), "kind", "section",
                                                           F.col("level").cast("long").alias("level"), F.sha2("text", 256).alias("text"))


MARKDOWN_SQL = f"""WITH l AS (SELECT conv_id || '/' || turn AS source_id, conv_id, turn, role, list_filter(list_transform(
    regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(regexp_replace(x, '^{WS}', ''), '{WS}$', '')), lambda x: x <> '') AS p
    FROM conversations)
SELECT source_id, CAST(1 AS BIGINT) AS ord, 'heading' AS kind, '' AS section, CAST(1 AS BIGINT) AS level, sha256('Conversation ' || conv_id) AS text FROM l
UNION ALL SELECT source_id, 2, 'heading', 'Conversation ' || conv_id, 2, sha256('Turn ' || turn) FROM l
UNION ALL SELECT source_id, 3, 'paragraph', 'Conversation ' || conv_id || ' > Turn ' || turn, NULL, sha256(role) FROM l
UNION ALL SELECT source_id, 3 + i, 'paragraph', 'Conversation ' || conv_id || ' > Turn ' || turn, NULL, sha256(x) FROM
  (SELECT source_id, conv_id, turn, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM l)"""


def _markdown_tables(spark, sf):
    doc, sid = _markdown(spark, sf)
    values = B.typed_document_values(B.document_tables(B.markdown_cells(doc, sid, F.col("md"))))
    return values.select("source_id", F.col("row").cast("long").alias("row"), "header", "kind", "num", "txt")


MARKDOWN_TABLES_SQL = """SELECT conv_id || '/' || turn AS source_id, CAST(2 AS BIGINT) AS row, 'role' AS header, 'text' AS kind, CAST(NULL AS DOUBLE) AS num, role AS txt FROM conversations
UNION ALL SELECT conv_id || '/' || turn, 2, 'turn', 'int', CAST(turn AS DOUBLE), NULL FROM conversations"""


def _html(spark, sf):
    parts = B.html_parts(load(spark, sf, "pages"), F.col("page_id"), F.col("html"))
    return B.html_blocks(parts).filter("kind = 'heading'").select(F.col("source_id").cast("long").alias("page_id"),
                                                                  F.col("level").cast("long").alias("level"), "section", "text")


HTML_SQL = """SELECT page_id, CAST(1 AS BIGINT) AS level, '' AS section,
  trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages"""


def _html_kinds(spark, sf):
    parts = B.html_parts(load(spark, sf, "pages"), F.col("page_id"), F.col("html"))
    return B.html_blocks(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


HTML_BREAKS = "p|div|li|h[1-6]|br|tr|section|article|blockquote"
HTML_KINDS_SQL = rf"""WITH seen AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head[ >].*?</head>|<script[ >].*?</script>|<style[ >].*?</style>', '', 'gs') AS h FROM pages),
marked AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(h, '<({HTML_BREAKS})( [^>]*)?/?>', chr(1) || '\1' || chr(2), 'g'),
  '</({HTML_BREAKS})>', chr(1) || chr(2), 'g'), '<[^>]*>', '', 'g'), '&quot;', '"') AS m FROM seen),
named AS (SELECT page_id, regexp_replace(m, '(\x01\w*\x02\s*)*\x01(\w+)\x02\s*(\x01\x02\s*)*', chr(1) || '\2' || chr(2), 'g') AS m FROM marked),
pieces AS (SELECT unnest(string_split(replace(replace(replace(m, '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(1))) AS p FROM named),
texts AS (SELECT CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 1) ELSE '' END AS tag,
  trim(regexp_replace(CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 2) ELSE p END, '\s+', ' ', 'g')) AS text FROM pieces)
SELECT CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'li' THEN 'list_item' ELSE 'paragraph' END AS kind, count(*) AS blocks,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM texts WHERE text <> '' GROUP BY 1"""


# ---- entities ---------------------------------------------------------------------------------------------------
def _document_blocks(spark, sf):
    d = load(spark, sf, "documents")
    return B.with_block_id(d.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("").alias("part"), F.lit("text").alias("kind"),
                                    F.lit(None).cast("int").alias("page"), F.lit("").alias("section"), F.lit(None).cast("int").alias("level"),
                                    F.lit(1).alias("ord"), "text"))


def _emails(spark, sf):
    e = B.entities(_document_blocks(spark, sf)).filter("kind = 'email'")
    return e.groupBy("source_id", "normalized").agg(F.count(F.lit(1)).alias("n"))


EMAILS_SQL = """SELECT source_id, normalized, count(*) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS source_id,
  lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+(?:\\.[\\p{L}\\p{N}_-]+)+'))) AS normalized FROM documents) GROUP BY 1, 2"""


def _entity_kinds(spark, sf):
    return L.entity_counts(B.entities(_document_blocks(spark, sf)))


def invoice_text(spark, sf):
    """A sentence per order that holds one entity of each kind."""
    o = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key, "o_orderdate", "o_totalprice", "o_custkey",
        F.concat(F.format_string("Invoice INV-%06d of ", key), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": "),
                 F.format_number("o_totalprice", 2), F.lit(" EGP, rebate "), (key % 100).cast("string"), F.lit("%, call 010"),
                 F.lpad((key % 100000000).cast("string"), 8, "0"), F.lit(" or write to Client"), F.col("o_custkey").cast("string"),
                 F.lit("@Example.com.")).alias("text"))


INVOICE_TEXT = """format('Invoice INV-{:06d} of ', o_orderkey) || strftime(o_orderdate, '%Y-%m-%d') || ': ' || format('{:,.2f}', o_totalprice)
  || ' EGP, rebate ' || (o_orderkey % 100) || '%, call 010' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') || ' or write to Client' || o_custkey || '@Example.com.'"""


def _entities_planted(spark, sf):
    blocks = invoice_text(spark, sf).select(F.col("o_orderkey").cast("string").alias("source_id"),
                                            F.concat(F.col("o_orderkey").cast("string"), F.lit("#1")).alias("block_id"), "text")
    return B.entities(blocks).select("block_id", "kind", "normalized", F.col("start").cast("long").alias("start"),
                                     F.col("end").cast("long").alias("end"))


def _entities_sql():
    found = [("code", "format('INV-{:06d}', o_orderkey)", "format('INV-{:06d}', o_orderkey)"),
             ("date", "strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y-%m-%d')"),
             ("money", "format('{:,.2f}', o_totalprice) || ' EGP'", "format('{:.2f}', o_totalprice) || ' EGP'"),
             ("percent", "(o_orderkey % 100) || '%'", "(o_orderkey % 100) || '%'"),
             ("phone", "'010' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0')", "'010' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0')"),
             ("email", "'Client' || o_custkey || '@Example.com'", "lower('Client' || o_custkey || '@Example.com')")]
    anchor = {"percent": "'rebate ' || ", "phone": "'call ' || "}
    parts = []
    for kind, raw, norm in found:
        pre = anchor.get(kind, "'' || ")
        start = f"instr(t, {pre}{raw}) - 1 + length({pre}'')"
        parts.append(f"SELECT o_orderkey || '#1' AS block_id, '{kind}' AS kind, {norm} AS normalized, {start} AS start, {start} + length({raw}) AS \"end\" FROM s")
    return f"WITH s AS (SELECT *, {INVOICE_TEXT} AS t FROM orders) " + " UNION ALL ".join(parts)


# ---- search and reading -----------------------------------------------------------------------------------------
def _postings(spark, sf):
    p = S.postings(_document_blocks(spark, sf))
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("blocks"), F.sum("tf").alias("tf"))


POSTINGS_SQL = f"""SELECT token, count(DISTINCT doc_id) AS blocks, count(*) AS tf FROM
  (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) GROUP BY token"""

SEARCH_WORDS = ["license", "then"]


def _search(spark, sf):
    hits = S.search(_document_blocks(spark, sf), " ".join(SEARCH_WORDS), limit=10 ** 6)
    return hits.select("block_id", F.round("score", 6).alias("score"), "location")


def _search_sql():
    tf = ", ".join(f"len(list_filter(toks, lambda x: starts_with(x, '{w}'))) AS f{i}" for i, w in enumerate(SEARCH_WORDS))
    dfs = ", ".join(f"(SELECT count(*) FROM t WHERE f{i} > 0) AS n{i}" for i in range(len(SEARCH_WORDS)))
    idf = [f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END" for i in range(len(SEARCH_WORDS))]
    score = " + ".join(f"({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(SEARCH_WORDS)))
    need = " AND ".join(f"f{i} > 0" for i in range(len(SEARCH_WORDS)))
    return (f"WITH d AS (SELECT doc_id, {_tokens_sql('text')} AS toks FROM documents), t AS (SELECT doc_id, len(toks) AS len, {tf} FROM d), "
            f"g AS (SELECT count(*) AS n, avg(len) AS mean FROM t), w AS (SELECT {dfs}) "
            f"SELECT doc_id || '#1' AS block_id, round({score}, 6) AS score, 'text' AS location FROM t, g, w WHERE {need}")


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, sf):
    """The stored index of all documents, built when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        path = new_folder(spark, "search-index")
        d = load(spark, sf, "documents")
        blocks = B.with_block_id(d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_id"), F.lit("").alias("part"), F.col("lang").alias("kind"),
                                          F.lit(None).cast("int").alias("page"), F.lit("").alias("section"), F.lit(None).cast("int").alias("level"), F.lit(1).alias("ord"), "text"))
        XI.build_index(blocks, path)
        _INDEXES[key] = path
    return _INDEXES[key]


def _search_stored(spark, sf):
    """The fifty best hits of the stored index over all documents, and the ten best English ones, in order, with what they show."""
    every = XI.search_index(spark, _index(spark, sf), " ".join(SEARCH_WORDS), 50).withColumn("asked", F.lit("all"))
    english = XI.search_index(spark, _index(spark, sf), " ".join(SEARCH_WORDS), 10, kind="en").withColumn("asked", F.lit("en"))
    return every.unionByName(english).select("asked", F.col("rank").cast("long").alias("rank"), "block_id", "kind", F.round("score", 6).alias("score"),
                                             F.lower("snippet").rlike("|".join(SEARCH_WORDS)).alias("shows_word"), (F.size(F.split("snippet", " ")) <= V.SNIPPET_WORDS + 2).alias("short"))


def _search_stored_sql():
    base = _search_sql().replace("documents)", "documents)", 1).replace("SELECT doc_id || '#1' AS block_id, round(", "SELECT doc_id, (", 1).replace(", 6) AS score", ") AS score", 1).replace(", 'text' AS location", "", 1)
    shown = f"regexp_matches(lower(text), '{'|'.join(SEARCH_WORDS)}')"
    return (f"WITH hits AS ({base}), named AS (SELECT source || '/' || h.doc_id || '#1' AS block_id, lang AS kind, score, {shown} AS shows_word FROM hits h JOIN documents d ON h.doc_id = d.doc_id), "
            "r AS (SELECT 'all' AS asked, row_number() OVER (ORDER BY round(score, 12) DESC, block_id) AS rank, * FROM named UNION ALL "
            "SELECT 'en', row_number() OVER (ORDER BY round(score, 12) DESC, block_id), * FROM named WHERE kind = 'en') "
            "SELECT asked, rank, block_id, kind, round(score, 6) AS score, shows_word, true AS short FROM r WHERE rank <= CASE WHEN asked = 'all' THEN 50 ELSE 10 END")


def _scan(spark, sf):
    return S.scan_search(_document_blocks(spark, sf), " ".join(SEARCH_WORDS)).select("block_id")


SCAN_SQL = f"""SELECT doc_id || '#1' AS block_id FROM documents WHERE {' AND '.join(f"contains(strip_accents({_fold_sql('text')}), '{w}')" for w in SEARCH_WORDS)}"""


def _read(spark, sf):
    return S.read(line_blocks(spark, sf), max_chars=400).select("source_id", F.col("ord").cast("long").alias("ord"), "location",
                                                                F.sha2("text", 256).alias("text"))


READ_SQL = f"""SELECT source_id, CAST(ord AS BIGINT) AS ord, 'paragraph' AS location, sha256(text) AS text FROM
  (SELECT *, sum(length(text)) OVER (PARTITION BY source_id ORDER BY ord) AS upto FROM ({LINES})) WHERE upto <= 400 OR ord = 1"""


def _around(spark, sf):
    blocks = line_blocks(spark, sf)
    hits = blocks.filter(F.contains(F.col("text"), F.lit("license"))).select("block_id")
    return S.around_hits(blocks, hits, 1).select("hit_id", "block_id")


AROUND_SQL = f"""WITH l AS ({LINES}) SELECT h.source_id || '#' || h.ord AS hit_id, b.source_id || '#' || b.ord AS block_id
  FROM l h JOIN l b ON h.source_id = b.source_id AND abs(h.ord - b.ord) <= 1 WHERE contains(h.text, 'license')"""


# ---- budgets ----------------------------------------------------------------------------------------------------
def _budget(spark, sf):
    taken = P.pack_texts(load(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", 300)
    return taken.select("conv_id", "turn")


UNITS = "2 * length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 7 * (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))"
BUDGET_SQL = f"""WITH RECURSIVE s AS (SELECT conv_id, turn, {UNITS} AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g AS (SELECT conv_id, turn, i, size <= 2100 AS ok, CASE WHEN size <= 2100 THEN 2100 - size ELSE 2100 END AS left_over FROM s WHERE i = 1
  UNION ALL SELECT s.conv_id, s.turn, s.i, s.size <= g.left_over, CASE WHEN s.size <= g.left_over THEN g.left_over - s.size ELSE g.left_over END
  FROM g JOIN s ON s.conv_id = g.conv_id AND s.i = g.i + 1)
SELECT conv_id, turn FROM g WHERE ok"""


def _budget_sources(spark, sf):
    """One pack per source of documents, with what was left out per language."""
    d = load(spark, sf, "documents")
    taken = P.pack_texts(d, ["source"], ["doc_id"], "text", 4000)
    return P.omissions(d, taken, ["source"], ["doc_id"], "lang")


BUDGET_SOURCES_SQL = f"""WITH RECURSIVE s AS (SELECT source, lang, doc_id, {UNITS} AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT source, lang, i, size <= 28000 AS ok, CASE WHEN size <= 28000 THEN 28000 - size ELSE 28000 END AS left_over FROM s WHERE i = 1
  UNION ALL SELECT s.source, s.lang, s.i, s.size <= g.left_over, CASE WHEN s.size <= g.left_over THEN g.left_over - s.size ELSE g.left_over END
  FROM g JOIN s ON s.source = g.source AND s.i = g.i + 1)
SELECT source, lang, count(*) AS omitted FROM g WHERE NOT ok GROUP BY 1, 2"""


# ---- proof and links --------------------------------------------------------------------------------------------
def _fields(spark, sf):
    """Two fields per invoice; every seventh amount is wrong, every eleventh quote altered, every thirteenth without source."""
    i = invoice_text(spark, sf)
    key = F.col("o_orderkey")
    block = F.concat(key.cast("string"), F.lit("#1"))
    blocks = i.select(key.cast("string").alias("source_id"), block.alias("block_id"), "text")
    amount = F.when(key % 7 == 0, F.lit("999999999.25")).otherwise(F.regexp_replace(F.format_number("o_totalprice", 2), ",", ""))
    quote = F.when(key % 11 == 0, F.concat(F.lit("never written "), "text")).otherwise(F.col("text"))
    first = i.select(key.alias("record_no"), F.lit("amount").alias("field"), amount.alias("value"), block.alias("block_id"), quote.alias("quote"))
    second = i.select(key.alias("record_no"), F.lit("day").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"),
                      F.when(key % 13 != 0, block).alias("block_id"), F.col("text").alias("quote"))
    return first.unionByName(second), blocks


def _grounded(spark, sf):
    fields, blocks = _fields(spark, sf)
    return G.rejected(G.check_fields(fields, blocks))


GROUNDED_SQL = """SELECT o_orderkey AS record_no, 'amount' AS field, CASE WHEN o_orderkey % 11 = 0 THEN 'quote not found in that block'
  ELSE 'value does not appear in the quote' END AS reason FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'day', 'missing source: every value needs a block and a quote' FROM orders WHERE o_orderkey % 13 = 0"""


def _grounded_records(spark, sf):
    """Proven records replace the stored ones with the same day and amount key."""
    fields, blocks = _fields(spark, sf)
    fresh = G.as_records(G.accepted(G.check_fields(fields, blocks)), ["amount", "day"]).select(F.col("record_no").alias("order_id"), "amount", "day")
    stored = load(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit("old").alias("note"))
    return G.upsert(stored, fresh, "order_id").select("order_id", "amount", "day", "note")


GROUNDED_RECORDS_SQL = """SELECT o_orderkey AS order_id, format('{:.2f}', o_totalprice) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, NULL AS note
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, 'old' FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0"""


def _mention_inputs(spark, sf):
    """Turns that quote an order code, and a table whose codes come in two spellings."""
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.format_string("ord-%06d ", "o_orderkey"))
        .otherwise(F.format_string("ORD-%06d", "o_orderkey")).alias("order_code"), "o_orderstatus")
    c = load(spark, sf, "conversations")
    text = F.concat(F.lit("Please check "), F.format_string("ORD-%06d", F.col("conv_id") * 7 + F.col("turn") * 1000), F.lit(" today. "), "text")
    blocks = c.select(F.col("conv_id").cast("string").alias("source_id"), F.concat_ws("#", "conv_id", "turn").alias("block_id"), text.alias("text"))
    return TableSet(spark, [Table("orders", o, "o_orderkey")]), blocks


def _mentions(spark, sf):
    tables, blocks = _mention_inputs(spark, sf)
    found = L.mentions(tables, B.entities(blocks), value_frequencies(tables)).filter(F.col("value").startswith("ORD-"))
    return found.select("value", "kind", "source_id", "block_id", "table_name", "column_name", "rows", "first_row")


MENTIONS_SQL = """SELECT format('ORD-{:06d}', conv_id * 7 + turn * 1000) AS value, 'code' AS kind, CAST(conv_id AS VARCHAR) AS source_id,
  conv_id || '#' || turn AS block_id, 'orders' AS table_name, 'order_code' AS column_name, CAST(1 AS BIGINT) AS rows, o_orderkey AS first_row
  FROM conversations JOIN orders ON o_orderkey = conv_id * 7 + turn * 1000"""


def _summary(spark, sf):
    tables, blocks = _mention_inputs(spark, sf)
    e = B.entities(blocks).filter(F.col("normalized").startswith("ORD-"))
    return L.document_summary(blocks, e, L.mentions(tables, e, value_frequencies(tables))).select("source_id", "blocks", "entities", "linked_values")


SUMMARY_SQL = """SELECT CAST(conv_id AS VARCHAR) AS source_id, count(*) AS blocks, count(DISTINCT conv_id * 7 + turn * 1000) AS entities,
  count(DISTINCT o_orderkey) AS linked_values FROM conversations LEFT JOIN orders ON o_orderkey = conv_id * 7 + turn * 1000 GROUP BY conv_id"""


def _find(spark, sf):
    tables = star(spark, sf, ["region", "nation", "customer", "orders", "documents"])
    return W.find(tables, "ORDER", values=True).select("kind", "column_name", "matched", "exact")


FIND_SQL = f"""SELECT 'table' AS kind, NULL AS column_name, 'orders' AS matched, false AS exact
UNION ALL SELECT 'column', c, c, false FROM (VALUES ('o_orderkey'), ('o_orderstatus'), ('o_orderdate'), ('o_orderpriority')) v(c)
UNION ALL SELECT 'data', 'text', min(text), {_fold_sql('min(text)')} = 'order' FROM documents WHERE contains({_fold_sql('text')}, 'order') HAVING count(*) > 0"""


def _find_value(spark, sf):
    facts = Facts(star(spark, sf, ["nation", "customer", "part"]))
    from ..operators.profile import profile_with_examples
    p = profile_with_examples(facts.tables, frequencies=facts.frequencies)
    hits = W.find(facts.tables, "machinery", p, facts.definitions, values=True)
    return hits.select("kind", "column_name", "matched", "exact")


FIND_VALUE_SQL = """SELECT 'value' AS kind, 'c_mktsegment' AS column_name, 'MACHINERY' AS matched, true AS exact
UNION ALL SELECT 'data', 'c_mktsegment', min(c_mktsegment), true FROM customer WHERE c_mktsegment = 'MACHINERY'"""

QUERIES = {
    "text_forms_documents": _text_forms, "scalars_orders": _scalars, "line_blocks_documents": _paragraphs,
    "markdown_blocks": _markdown_blocks, "markdown_tables": _markdown_tables, "html_headings_pages": _html, "html_kinds_pages": _html_kinds,
    "emails_documents": _emails, "entity_kinds_documents": _entity_kinds, "entities_planted": _entities_planted,
    "postings_documents": _postings, "search_bm25": _search, "search_stored_index": _search_stored, "search_scan": _scan, "read_window": _read, "read_around_hits": _around,
    "budgeted_conversations": _budget, "budgeted_sources": _budget_sources, "grounded_rejects_planted": _grounded,
    "grounded_records_planted": _grounded_records, "mentions_planted": _mentions, "document_summary": _summary,
    "find_term": _find, "find_value": _find_value,
}
ORACLE = {
    "text_forms_documents": TEXT_FORMS_SQL, "scalars_orders": SCALARS_SQL, "line_blocks_documents": PARAGRAPHS_SQL,
    "markdown_blocks": MARKDOWN_SQL, "markdown_tables": MARKDOWN_TABLES_SQL, "html_headings_pages": HTML_SQL, "html_kinds_pages": HTML_KINDS_SQL, "emails_documents": EMAILS_SQL,
    "entities_planted": _entities_sql(), "postings_documents": POSTINGS_SQL, "search_bm25": _search_sql(), "search_stored_index": _search_stored_sql(), "search_scan": SCAN_SQL,
    "read_window": READ_SQL, "read_around_hits": AROUND_SQL, "budgeted_conversations": BUDGET_SQL, "budgeted_sources": BUDGET_SOURCES_SQL,
    "grounded_rejects_planted": GROUNDED_SQL, "grounded_records_planted": GROUNDED_RECORDS_SQL, "mentions_planted": MENTIONS_SQL,
    "document_summary": SUMMARY_SQL, "find_term": FIND_SQL, "find_value": FIND_VALUE_SQL,
}
