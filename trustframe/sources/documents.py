"""Text files, CSV files and e-mails as blocks, tables and attachments."""

from __future__ import annotations

import email
import email.policy
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as V
from ..functions.names import file_extension
from ..operators.blocks import html_blocks, html_parts, markdown_blocks, text_blocks, with_block_id
from ..session import materialize

SNIFF_CHARS = 20_000
DELIMITERS = [",", ";", "\t", "|"]
TEXT_KINDS = ["txt", "md", "html", "htm"]


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """Bytes to text: UTF-8 first, then the Arabic Windows code page, then Latin-1 (which never fails)."""
    def one(data):
        for name in V.TEXT_ENCODINGS:
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("utf-8", "replace")

    return content.map(one, na_action="ignore")


# ---- CSV --------------------------------------------------------------------------------------------------------
def best_delimiter(head: Column) -> Column:
    """The delimiter that splits the most lines of the head into the same number (at least two) of fields."""
    lines = F.filter(F.slice(F.split(F.substring(head, 1, SNIFF_CHARS), r"\r\n|\n|\r"), 1, 100), lambda x: x != "")
    scored = []
    for at, d in enumerate(DELIMITERS):
        fields = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        same = F.size(F.filter(fields, lambda n: (n >= 1) & (n == fields[0])))
        scored.append(F.struct(same.alias("lines"), F.lit(-at).alias("order"), F.lit(d).alias("d")))
    best = F.array_max(F.array(*scored))
    return F.when(best["lines"] > 0, best["d"]).otherwise(F.lit(","))


def sniff_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sep, header): read from the first lines of each file, not from whole files."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    head = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id())
    first = head.groupBy("path").agg(F.min("n").alias("n0"))
    top = head.join(first, "path").filter(F.col("n") - F.col("n0") < 100)
    text = top.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("head"))
    return text.select("path", best_delimiter(F.col("head")).alias("sep"), F.split_part(F.col("head"), F.lit("\n"), F.lit(1)).alias("header"))


def read_csv(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One frame per delimiter and header, each over all files that share them (plus `_path`). Files may be split."""
    groups: dict[tuple[str, str], list[str]] = {}
    for r in sniff_csv(spark, paths).collect():                      # one row per file: metadata
        groups.setdefault((r.sep, r.header), []).append(r.path)
    return [spark.read.option("header", "true").option("sep", sep).csv(files).select("*", F.col("_metadata.file_path").alias("_path"))
            for (sep, _), files in sorted(groups.items())]


# ---- e-mail -----------------------------------------------------------------------------------------------------
#: Headers that are kept, by their names in the result.
HEADERS = ["from", "to", "cc", "subject", "date", "message_id"]
PARTS = "array<struct<at: int, type: string, inline: boolean, name: string, text: string, data: binary>>"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _leaves(message, depth: int = 0):
    """The parts of a message that hold something, with their depth: its containers are left out, messages in it are not opened."""
    if message.get_content_maintype() != "multipart":
        yield depth, message
        return
    for part in message.iter_parts():
        yield from _leaves(part, depth + 1)


def _part(depth: int, part) -> dict:
    kind = part.get_content_type()
    whole = kind == "message/rfc822"
    data = part.get_content().as_bytes() if whole else part.get_payload(decode=True)
    text = part.get_content() if kind in ("text/plain", "text/html") else None
    return {"at": depth, "type": kind, "inline": not part.is_attachment(), "name": part.get_filename() or ("attachment.eml" if whole else None), "text": text, "data": data}


def mail_parts(files: DataFrame) -> DataFrame:
    """files(source_id, part, content) -> source_id, part, headers, parts: Python only takes the MIME envelope apart."""
    def read(batches):
        for batch in batches:
            rows = []
            for sid, part, data in zip(batch["source_id"], batch["part"], batch["content"]):
                message = email.message_from_bytes(data, policy=email.policy.default)
                headers = {h: str(value) for h in HEADERS if (value := message[h.replace("_", "-")])}      # each look parses anew
                rows.append((sid, part, headers, [_part(*leaf) for leaf in _leaves(message)]))
            yield pd.DataFrame(rows, columns=["source_id", "part", "headers", "parts"])

    return files.select("source_id", "part", "content").mapInPandas(read, f"source_id string, part string, headers map<string,string>, parts {PARTS}")


def iso_time(header: Column) -> Column:
    """A date header in ISO form with its offset; null where it is none."""
    pattern = r"(?i)(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2})(:\d{2})?\s*([+-]\d{4}|gmt|utc?|z)?"
    day, month, year, clock, second, zone = [F.regexp_extract(header, pattern, i) for i in range(1, 7)]
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month))
    offset = F.when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).when(zone != "", "+00:00").otherwise("")
    text = F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), F.lpad(clock, 5, "0"),
                    F.when(second == "", ":00").otherwise(second), F.when(zone == "-0000", "").otherwise(offset))
    real = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    return F.when((number > 0) & real, text)


def read_mail(files: DataFrame) -> DataFrame:
    """files(source_id, part, content) -> one row per message: headers, plain, html (only without plain) and attachments.

    The body is the first text shown inline, plain before HTML. What stands beside it at the top is attached, but for the first
    inline text of either kind.
    """
    rows = mail_parts(files)

    def first(kind: str) -> Column:
        return F.get(F.filter("parts", lambda p: (p["type"] == kind) & p["inline"]), F.lit(0))

    def first_at(kind: str) -> Column:
        return F.array_position(F.transform("parts", lambda p: (p["type"] == kind) & p["inline"] & (p["at"] == 1)), True)

    plain, html = first("text/plain")["text"], first("text/html")["text"]
    beside = F.filter(F.transform("parts", lambda p, i: F.struct(
        (p["at"] == 1).alias("top"), ((i + 1 == first_at("text/plain")) | (i + 1 == first_at("text/html"))).alias("body"), p["name"].alias("name"), p["data"].alias("data"))),
        lambda p: p["top"] & ~p["body"] & (F.coalesce(F.octet_length(p["data"]), F.lit(0)) > 0))
    attached = F.transform(beside, lambda p: F.struct(F.element_at(F.split(F.coalesce(p["name"], F.lit("attachment")), r"[\\/]"), -1).alias("name"), p["data"].alias("data")))
    sent = iso_time(F.try_element_at("headers", F.lit("date")))
    headers = F.when(sent.isNotNull(), F.map_concat("headers", F.create_map(F.lit("sent"), sent))).otherwise(F.col("headers"))
    return rows.select("source_id", "part", headers.alias("headers"), plain.alias("plain"), F.when(plain.isNull(), html).alias("html"), attached.alias("attachments"))


def mail_blocks(messages: DataFrame) -> DataFrame:
    """Header block, then the body as paragraphs (or as HTML blocks when there is no plain body)."""
    key = F.concat_ws("\x1f", "source_id", "part")
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{h}: "), F.try_element_at("headers", F.lit(h)))
                                      for h in ("from", "to", "cc", "date", "subject")]))
    head = messages.filter(F.size(lines) > 0).select(key.alias("source_id"), F.lit("").alias("part"), F.lit("email_header").alias("kind"),
                                                     F.lit(None).cast("int").alias("page"), F.lit("").alias("section"),
                                                     F.lit(None).cast("int").alias("level"), F.lit(0).alias("ord"), F.array_join(lines, "\n").alias("text"))
    plain = text_blocks(messages.filter("plain IS NOT NULL"), key, F.regexp_replace("plain", "\r\n", "\n"), "email_body")
    html = html_blocks(html_parts(messages.filter("html IS NOT NULL"), key, F.col("html")))
    html = html.withColumn("kind", F.when(F.col("kind") == "paragraph", "email_body").otherwise(F.col("kind")))
    return _restore(with_block_id(head).unionByName(plain).unionByName(html))


def _restore(blocks: DataFrame) -> DataFrame:
    """Split the combined key of source and part again and give every block its id."""
    key = F.split("source_id", "\x1f")
    rows = blocks.withColumn("part", F.coalesce(F.get(key, F.lit(1)), F.lit(""))).withColumn("source_id", F.get(key, F.lit(0)))
    return rows.withColumn("block_id", F.concat(F.col("source_id"), F.when(F.col("part") != "", F.concat(F.lit("/"), "part")).otherwise(""),
                                                F.lit("#"), F.col("ord").cast("string")))


def read_documents(files: DataFrame, depth: int = V.ATTACHMENT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(blocks, attachments) of files(source_id, part, name, content), attachments opened up to three levels deep.

    Each level is one pass over what the level above attached; parts are labelled `a > b`, and everything that is not
    read keeps a row with its reason.
    """
    blocks, listed, level = [], [], files.withColumn("kind", file_extension(F.col("name")))
    for at in range(depth + 1):
        texts = level.filter(F.col("kind").isin(TEXT_KINDS)).withColumn("text", decode("content"))
        key = F.concat_ws("\x1f", "source_id", "part")
        blocks += [_restore(text_blocks(texts.filter("kind = 'txt'"), key, F.col("text"))),
                   _restore(markdown_blocks(texts.filter("kind = 'md'"), key, F.col("text"))),
                   _restore(html_blocks(html_parts(texts.filter("kind IN ('html', 'htm')"), key, F.col("text"))))]
        messages = materialize(read_mail(level.filter("kind = 'eml'")), "messages")
        blocks.append(mail_blocks(messages))
        label = F.concat(F.when(F.col("part") != "", F.concat("part", F.lit(" > "))).otherwise(""), "a.name")
        found = messages.select("source_id", "part", F.explode("attachments").alias("a")).select(
            "source_id", label.alias("part"), "a.name", F.col("a.data").alias("content"), file_extension(F.col("a.name")).alias("kind"))
        status = F.when(F.lit(at >= depth), "skipped").when(F.col("kind").isin(*TEXT_KINDS, "eml"), "read").when(
            F.col("kind").isin("xlsx", "xlsm", "csv"), "stored").otherwise("skipped")
        note = F.when(F.lit(at >= depth), "nested too deep").when(status == "skipped", "not a readable kind").when(
            status == "stored", "a table: read it with the workbook or CSV scan").otherwise("")
        listed.append(found.select("source_id", "part", "name", "kind", F.length("content").alias("size"), status.alias("status"), note.alias("note")))
        level = found
        if messages.isEmpty():
            break
    return reduce(DataFrame.unionByName, blocks), reduce(DataFrame.unionByName, listed)
