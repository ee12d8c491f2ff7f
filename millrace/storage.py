"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The lists of the ``intermediates`` blocks that are open.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context. A local session that
    names neither (tests) gets a folder of its own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get()
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive the loss of any executor and
    the plan so far runs once."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._millrace_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_saved(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote, once no later stage reads it."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """At its end, deletes all that ``saved`` wrote inside. The caller writes an operator's result inside the block, by any means but
    ``saved``, and is then rid of every table that the result was computed from. The list holds the paths."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for path in made:
            _delete(spark, path)
