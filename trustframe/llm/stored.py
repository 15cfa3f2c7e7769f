"""Deleting what a job wrote to the shared folder once nothing reads it any more."""

from __future__ import annotations

from pyspark.sql import DataFrame


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that `materialize` wrote. Frames made from it must be written before."""
    jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
    for folder in sorted({f.rsplit("/", 1)[0] for f in frame.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
