"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def build_session(app: str = "trustframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join handling; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: on a cluster that would live on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="trustframe-")
    return _LOCAL[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (never reused, so a retried job cannot read half-written data)."""
    return os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: Shuffle files of an execution go when it ends; else they lie on disk until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that Spark hands to Python at a time; its default makes batches of tens of MB out of texts, in both processes.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000


#: Each broadcast is built, stored and served by the driver, until its garbage is collected.
NO_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def materialize(df: DataFrame, label: str, batch_rows: int | None = None, broadcasts: bool = True) -> DataFrame:
    """Write a frame once and read it back: lineage is cut and the rows survive lost executors. `batch_rows` bounds the rows that
    Python functions of the frame get at a time; without `broadcasts`, joins meet by shuffles only, which spares the driver of a
    job with very many small joins."""
    path = new_folder(df.sparkSession, label)
    store(df, path, ({BATCH: str(batch_rows)} if batch_rows else {}) | ({} if broadcasts else NO_BROADCASTS))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, path: str, settings: dict[str, str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """Write a frame, under session settings that hold for this write. The shuffle files of the write are removed with its end:
    nothing reads them again. Compression is of the lowest level, whose native buffers are small."""
    conf, wanted = df.sparkSession.conf, {CLEANUP: "true"} | (settings or {})
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"} | options
        df.write.mode(mode).options(**options).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


_CLAIMS = threading.Lock()


def create_once(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file; False if it is there already. Who gets True owns what the name stands for.

    The file system decides (create without overwrite); local folders check and create in two steps, so within one process
    claims also take turns.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    with _CLAIMS:
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
    return True


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """Driver-side metadata as a frame whose size Catalyst knows, so joins to it broadcast only while it is small."""
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)


def spread(df: DataFrame, small_bytes: int = 256 << 20) -> DataFrame:
    """Use all cores for costly per-row work on a small input, which often sits in one file split.

    Only inputs that Catalyst estimates below `small_bytes` are redistributed; larger ones already come in many splits
    and are never shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small_bytes else df
