"""Run logs: one JSON event per line; damaged lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EVENT = ("run_id string, t double, wall double, kind string, level string, message string, scope map<string,string>, "
         "data map<string,string>")


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of many runs; lines that are no JSON object (a truncated tail) are dropped. Order is time, then `seq`.

    `seq` is the number of the line among the readable ones of its file, above 20 bits of the file's name: it depends on the
    files alone. Lines are counted within the blocks that Spark reads, and blocks by a prefix sum, so no file is one task.
    """
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(paths).filter("kind IS NOT NULL")
    block = ["_file", "_start"]
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    counts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_lines"))
    earlier = F.sum("_lines").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(*block, F.coalesce(earlier, F.lit(0)).alias("_base"))
    line = F.col("_base") + F.row_number().over(Window.partitionBy(*block).orderBy("_at"))
    name = F.crc32(F.element_at(F.split("_file", "/"), -1).cast("binary")) % (1 << 20)
    return placed.join(bases, block).select(*rows.columns, (F.shiftleft(line, 20) + name).alias("seq"))


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path).filter("kind IS NOT NULL")
