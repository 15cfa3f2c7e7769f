"""Files as rows: identity, content fingerprint, container type, reuse and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import file_extension, slug

MEGABYTE = 1 << 20
OLE_MAGIC = "D0CF11E0A1B11AE1"
ENCRYPTED_MARK = "EncryptedPackage".encode("utf-16-le").hex()


def read_files(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files, folders and globs; a missing path is an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def content_hash(content: Column, length: Column, quick_above: int | None = None) -> Column:
    """SHA-256 of the whole content; optionally, for larger files, of the size and the first and last megabyte."""
    full = F.sha2(content, 256)
    if quick_above is None:
        return full
    ends = F.concat(length.cast("string").cast("binary"), F.substring(content, 1, MEGABYTE),
                    F.substring(content, F.greatest(F.lit(1), length - MEGABYTE + 1).cast("int"), F.lit(MEGABYTE)))
    return F.when(length <= quick_above, full).otherwise(F.sha2(ends, 256))


def container(path: Column, content: Column, wrapper_prefixes: list[bytes] = ()) -> Column:
    """zip, drm (a configured prefix), encrypted (an OLE file that holds an encrypted package) or other."""
    head = F.hex(F.substring(content, 1, 16))
    wrapped = F.lit(False)
    for prefix in wrapper_prefixes:
        wrapped = wrapped | head.startswith(prefix.hex().upper())
    ole = head.startswith(OLE_MAGIC) & ~F.lower(path).endswith(".xls")
    return (F.when(head.startswith("504B"), "zip").when(wrapped, "drm")
            .when(ole & F.contains(content, F.unhex(F.lit(ENCRYPTED_MARK))), "encrypted").otherwise("other"))


def source_id(path: Column, alias: Column | None = None) -> Column:
    """A readable name and eight hex digits of the path, or the given alias."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    own = F.concat(slug(stem), F.lit("-"), F.substring(F.sha1(path), 1, 8))
    return own if alias is None else F.coalesce(slug(alias, 60), own)


def inventory(files: DataFrame, wrapper_prefixes: list[bytes] = (), quick_above: int | None = None,
              aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per source file; office lock files (~$...) are not sources. Contents are hashed where they are read."""
    path, content = F.col("path"), F.col("content")
    alias = None
    if aliases:
        alias = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), path)
    kept = files.filter(~file_name(path).startswith("~$"))
    return kept.select(source_id(path, alias).alias("source_id"), "path", file_extension(path).alias("kind"), F.col("length").alias("size"),
                       F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("mtime"),
                       content_hash(content, F.col("length"), quick_above).alias("sha256"),
                       (F.lit("full") if quick_above is None else F.when(F.col("length") <= quick_above, "full").otherwise("quick")).alias("hash_mode"),
                       container(path, content, list(wrapper_prefixes)).alias("wrapper"))


def identical_content(sources: DataFrame) -> DataFrame:
    """(sha256, copies, first_path): contents stored more than once. Paths stay in the inventory, one row each."""
    return sources.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def inventory_warnings(sources: DataFrame) -> DataFrame:
    same = sources.join(identical_content(sources).drop("copies"), "sha256").select(
        "path", F.concat(F.lit("same content as "), "first_path").alias("warning")).filter(F.col("warning") != F.concat(F.lit("same content as "), F.col("path")))
    locked = sources.filter("wrapper = 'encrypted'").select("path", F.lit("password-protected: cannot be read").alias("warning"))
    return same.unionByName(locked)


REUSE_KEY = ["source_id", "path", "sha256", "size", "mtime"]


def to_process(current: DataFrame, previous: DataFrame | None, settings: str, previous_settings: str | None = None,
               previous_verified: bool = True) -> DataFrame:
    """Sources that differ from the last trusted run; everything when its settings differ or it was not verified."""
    if previous is None or not previous_verified or settings != previous_settings:
        return current
    return current.join(previous.select(*REUSE_KEY), REUSE_KEY, "left_anti")


def reusable(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select(*REUSE_KEY), REUSE_KEY, "left_semi")


def freshness(manifest: DataFrame, current: DataFrame, deep: bool = False) -> DataFrame:
    """(path, reason) for sources that are missing, modified, new, or changed behind unchanged metadata."""
    old = manifest.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha256").alias("old_sha"))
    new = current.select("path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"), F.col("sha256").alias("new_sha"))
    both = old.join(new, "path", "full_outer")
    reason = (F.when(F.col("new_size").isNull(), "missing").when(F.col("old_size").isNull(), "added")
              .when((F.col("old_size") != F.col("new_size")) | (F.col("old_mtime") != F.col("new_mtime")), "modified"))
    if deep:
        reason = reason.when(F.col("old_sha") != F.col("new_sha"), "content_changed_same_metadata")
    return both.select("path", reason.alias("reason")).filter("reason IS NOT NULL")
