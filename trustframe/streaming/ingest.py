"""Streams: value frequencies kept up to date as files arrive, and run logs folded while they grow."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import runlog
from ..operators.frequencies import merge_frequencies, value_frequencies
from ..session import new_folder
from ..tables import Table, TableSet


def watch_parquet(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream; each file is seen once."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def keep_frequencies(stream: DataFrame, make_table: Callable[[DataFrame], Table], store: str, checkpoint: str) -> None:
    """Process everything that is available, then stop. Each batch writes its own part under its batch id, so a batch
    that is repeated after a failure replaces its part instead of counting twice."""
    def one(batch: DataFrame, batch_id: int) -> None:
        part = value_frequencies(TableSet(batch.sparkSession, [make_table(batch)]))
        part.write.mode("overwrite").parquet(os.path.join(store, f"batch={batch_id}"))

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stored_frequencies(spark: SparkSession, store: str) -> DataFrame:
    """The merged frequencies of all batches so far."""
    return merge_frequencies(spark.read.parquet(store).drop("batch"))


def compact(spark: SparkSession, store: str) -> str:
    """Merge all parts into one new folder, so that reads stay cheap after many batches."""
    target = new_folder(spark, "frequencies")
    stored_frequencies(spark, store).write.parquet(os.path.join(target, "batch=0"))
    return target


def merge_records(records: DataFrame) -> DataFrame:
    """(run_id, stage, started, ended, seconds, status, error) from all records of a stage, in whatever order they were made."""
    folded = records.groupBy("run_id", "stage").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.max_by("status", "ended").alias("status"),
                                                    F.max("error").alias("error"))
    return runlog.stage_columns(folded)


def follow_runs(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """What each batch of growing run logs says of its stages: (run_id, stage, started, ended, status, error).

    The stream keeps no state, so nothing grows and nothing comes too late: a stage whose end arrives in a later batch, or in
    a file found days after, has a record there, and merge_records puts the records of a stage together. Returns the ended query.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        sink(runlog.stage_parts(batch), batch_id)

    query = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
