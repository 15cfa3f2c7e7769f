"""What a run did, read from its events: stages, sources, sheets, totals, and the first real cause of a failure.

Events are (run_id, seq, t, kind, level, message, scope, data); t is seconds since the run started.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as V

FAILED = ["failed", "aborted", "interrupted"]


def data(key: str) -> Column:
    return F.try_element_at("data", F.lit(key))


def _stage_name() -> Column:
    return F.coalesce(data("name"), F.col("message"))


def stages(events: DataFrame) -> DataFrame:
    """(run_id, stage, started, ended, seconds, status, error): one aggregate."""
    return stage_columns(stage_parts(events))


def stage_parts(events: DataFrame) -> DataFrame:
    """(run_id, stage, started, ended, status, error) as these events tell it; parts of a stage can be merged."""
    rows = events.filter(F.col("kind").isin("stage.start", "stage.end")).withColumn("stage", _stage_name())
    end = F.col("kind") == "stage.end"
    return rows.groupBy("run_id", "stage").agg(
        F.min(F.when(~end, F.col("t"))).alias("started"), F.max(F.when(end, F.col("t"))).alias("ended"),
        F.max_by(F.when(end, F.coalesce(data("status"), F.lit("passed"))), F.when(end, F.col("t"))).alias("status"),
        F.max(F.when(end, data("error"))).alias("error"))


def stage_columns(folded: DataFrame) -> DataFrame:
    """Duration and state of folded stages; a stage whose start was not seen starts at its end."""
    started = F.coalesce("started", "ended")
    return folded.select("run_id", "stage", started.alias("started"), "ended",
                         F.when(F.col("ended").isNotNull(), F.greatest(F.lit(0.0), F.col("ended") - started)).alias("seconds"),
                         F.coalesce("status", F.lit("running")).alias("status"), "error")


def sources(events: DataFrame) -> DataFrame:
    """(run_id, source_id, path, size, status, seconds): the last word of each source event wins."""
    rows = events.filter(F.col("kind").startswith("source.")).withColumn("source_id", F.coalesce(data("source_id"), F.lit("?")))
    status = (F.when(F.col("kind") == "source.reused", "reused").when(F.col("kind") == "source.extract.start", "running")
              .when(F.col("kind") == "source.extract.end", F.coalesce(data("status"), F.lit("extracted"))))
    at = F.struct("t", "seq")
    return rows.groupBy("run_id", "source_id").agg(
        F.max_by(data("path"), F.when(data("path").isNotNull(), at)).alias("path"),
        F.max_by(data("size"), F.when(data("size").isNotNull(), at)).cast("long").alias("size"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), at)), F.lit("pending")).alias("status"),
        F.max(data("seconds").cast("double")).alias("seconds"))


def sheets(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("kind").isin("sheet.start", "sheet.end")).withColumn(
        "source_id", F.coalesce(F.try_element_at("scope", F.lit("source_id")), data("source_id"), F.lit("?")))
    end = F.col("kind") == "sheet.end"
    return rows.groupBy("run_id", "source_id", F.coalesce(data("name"), F.lit("?")).alias("sheet")).agg(
        F.coalesce(F.max(F.when(end, F.coalesce(data("status"), F.lit("extracted")))), F.lit("running")).alias("status"),
        F.coalesce(F.max(F.when(end, data("rows").cast("long"))), F.lit(0)).alias("rows"),
        F.coalesce(F.max(F.when(end, data("columns").cast("int"))), F.lit(0)).alias("columns"))


def warnings_by_stage(events: DataFrame) -> DataFrame:
    """(run_id, stage, warnings): a warning belongs to the last stage begun before it.

    Stage starts are few per run and travel as one array, so a run with very many warnings is never sorted as a whole.
    """
    begun = events.filter("kind = 'stage.start'").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "seq", _stage_name().alias("stage")))).alias("begun"))
    rows = events.filter("kind = 'warning'").join(begun, "run_id", "left")
    before = F.filter("begun", lambda s: (s["t"] < F.col("t")) | ((s["t"] == F.col("t")) & (s["seq"] < F.col("seq"))))
    stage = F.when(F.size(before) > 0, F.element_at(before, -1)["stage"])
    return rows.groupBy("run_id", stage.alias("stage")).agg(F.count(F.lit(1)).alias("warnings"))


def totals(events: DataFrame) -> DataFrame:
    """(run_id, status, promoted, events, errors, warnings, elapsed, rows)."""
    at = F.struct("t", "seq")
    end = F.col("kind") == "run.end"
    base = events.groupBy("run_id").agg(
        F.max_by(F.when(end, data("status")), F.when(end, at)).alias("status"),
        F.max_by(F.when(end, data("promoted")), F.when(end, at)).alias("promoted"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"),
        F.max("t").alias("elapsed"))
    rows = sheets(events).groupBy("run_id").agg(F.sum("rows").alias("rows"))
    return base.join(rows, "run_id", "left").fillna(0, ["rows"])


def root_cause(events: DataFrame) -> DataFrame:
    """(run_id, error_t, error_seq, message, code, stage, downstream): the first failed stage and the first error.

    What fails after the first failure is noise; it is only counted.
    """
    at = F.struct("t", "seq")
    error = F.col("level") == "error"
    first = events.filter(error).groupBy("run_id").agg(
        F.min_by(F.struct("t", "seq", "message", data("code").alias("code")), at).alias("e"))
    failed = stages(events).filter(F.col("status").isin(FAILED))
    stage = failed.groupBy("run_id").agg(F.min_by(F.struct("stage", "error"), F.struct("started", "stage")).alias("s"),
                                         (F.count(F.lit(1)) - 1).alias("downstream"))
    both = first.join(stage, "run_id", "full_outer")
    return both.select("run_id", F.col("e.t").alias("error_t"), F.col("e.seq").alias("error_seq"), F.col("e.message").alias("message"),
                       F.coalesce("e.code", "s.error").alias("code"), F.col("s.stage").alias("stage"),
                       F.coalesce("downstream", F.lit(0)).alias("downstream"))


def failure_context(events: DataFrame, before: int = V.FAILURE_CONTEXT) -> DataFrame:
    """The first error of each run and the events before it. The rank filter limits every task to a few rows per run."""
    pivot = root_cause(events).filter("error_t IS NOT NULL").select("run_id", "error_t", "error_seq")
    rows = events.join(pivot, "run_id").filter("t < error_t OR (t = error_t AND seq <= error_seq)")
    latest = Window.partitionBy("run_id").orderBy(F.desc("t"), F.desc("seq"))
    last = rows.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= before + 1)
    return last.withColumn("back", F.col("place") - 1).drop("place", "error_t", "error_seq")
