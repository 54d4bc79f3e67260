"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the job that is open, below the shared one.
_job: ContextVar[str] = ContextVar("job", default="")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session that runs in one process (``local[n]``) gets a temporary folder; any
    other must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fieldglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path under :func:`shared_dir`, in the folder of the open job."""
    return f"{shared_dir(spark)}/{_job.get()}{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at files that every executor can reread, so the loss of an
    executor costs no recomputation of what stands before.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def job(spark: SparkSession, what: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored tables go when it ends.

    Gives a function that stores the block's result beside the block's folder.
    """
    outer, inner = _job.get(), f"{_job.get()}{what}-job-{uuid.uuid4().hex}/"

    def result(df: DataFrame) -> DataFrame:
        _job.set(outer)
        try:
            return stored(df, what)
        finally:
            _job.set(inner)

    _job.set(inner)
    try:
        yield result
    finally:
        _job.set(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{inner}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
