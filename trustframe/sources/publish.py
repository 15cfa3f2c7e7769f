"""Write, audit, publish: facts of a run become visible only when the run passed.

Layout below one shared folder: `facts/<name>/run_id=<id>/` holds parquet, `runs/` the run log, `published/` one small
record per publication, `claims/` a file per sequence number given out. The newest record is the current run, so publishing
is one atomic append and readers never see a half-written run.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.errors import AnalysisException

from ..session import create_once, local_frame

POINTER = "seq long, run_id string, previous string, published_at string"
RUN = "seq long, run_id string, status string, started string"


class NotPublished(RuntimeError):
    """The run failed its audit or its rules; the last good run stays current."""


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.root}/{name}")
        except AnalysisException:
            return local_frame(self.spark, [], schema)

    def _append(self, name: str, row: tuple, schema: str) -> None:
        local_frame(self.spark, [row], schema).coalesce(1).write.mode("append").json(f"{self.root}/{name}")

    def _claim(self, name: str, frame: DataFrame, run_id: str) -> int:
        """The next sequence number, owned by this run: one claim file per number, so two runs that finish together get two."""
        seq = (frame.agg(F.max("seq")).first()[0] or 0) + 1
        while not create_once(self.spark, f"{self.root}/claims/{name}-{seq:012d}", run_id):
            seq += 1
        return seq

    # ---- writing ------------------------------------------------------------------------------------------------
    def write(self, run_id: str, name: str, facts: DataFrame, partitions: list[str] | None = None) -> DataFrame:
        """Store one fact table of a run; a repeated write of the same run replaces only that run's folder."""
        path = f"{self.root}/facts/{name}/run_id={run_id}"
        facts.write.mode("overwrite").partitionBy(*(partitions or [])).parquet(path)
        return self.spark.read.schema(facts.schema).parquet(path)

    def finish(self, run_id: str, issues: DataFrame | None = None, blockers: DataFrame | None = None) -> None:
        """Publish the run, or record it as failed and say why."""
        problems = [f"audit: {r.code} {r.subject}" for r in issues.limit(5).collect()] if issues is not None else []
        problems += [f"rule: {r.rule_id} {r.status}" for r in blockers.limit(5).collect()] if blockers is not None else []
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        self._append("runs", (self._claim("runs", self.runs(), run_id), run_id, "failed" if problems else "passed", now), RUN)
        if problems:
            raise NotPublished("; ".join(problems))
        self._append("published", (self._claim("published", self.published(), run_id), run_id, self.current(), now), POINTER)

    # ---- reading ------------------------------------------------------------------------------------------------
    def runs(self) -> DataFrame:
        return self._log("runs", RUN)

    def published(self) -> DataFrame:
        return self._log("published", POINTER)

    def current(self) -> str | None:
        return self.published().agg(F.max_by("run_id", "seq")).first()[0]

    def previous(self) -> str | None:
        return self.published().agg(F.max_by("previous", "seq")).first()[0]

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        run_id = run_id or self.current()
        if run_id is None:
            raise LookupError("no run has been published yet")
        return self.spark.read.parquet(f"{self.root}/facts/{name}/run_id={run_id}")

    # ---- retention ----------------------------------------------------------------------------------------------
    def expired(self, keep: int) -> DataFrame:
        """Runs beyond the newest `keep`; the published run and the one before it never expire."""
        ranked = self.runs().withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("seq"))))
        safe = [r for r in (self.current(), self.previous()) if r]
        return ranked.filter((F.col("at") > keep) & ~F.col("run_id").isin(safe or [""])).select("run_id").distinct()

    def prune(self, keep: int) -> list[str]:
        """Delete the fact folders of expired runs through the file system that holds them."""
        runs = sorted(r.run_id for r in self.expired(keep).collect())
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        facts = jvm.org.apache.hadoop.fs.Path(f"{self.root}/facts")
        fs = facts.getFileSystem(conf)
        if fs.exists(facts):
            for status in fs.listStatus(facts):
                for run in runs:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(status.getPath(), f"run_id={run}"), True)
        return runs
