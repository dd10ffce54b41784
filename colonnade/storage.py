"""Tables that a computation writes for itself, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ledgers: list[list[str]] = []
_tops: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, in local tests a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    base = tempfile.mkdtemp(prefix="colonnade-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; an application's paths go when its driver ends."""
    top = f"{shared_folder(spark).rstrip('/')}/colonnade/{spark.sparkContext.applicationId}"
    if top not in _tops:
        _tops.add(top)
        atexit.register(_delete_at_exit, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    for ledger in _ledgers:
        ledger.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped before
        with contextlib.suppress(Exception):  # the JVM may be gone
            delete(spark, path)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are written in the block are deleted at its end, but for those taken off the list (:func:`keep`)."""
    ledger: list[str] = []
    _ledgers.append(ledger)
    try:
        yield ledger
    finally:
        _ledgers[:] = [x for x in _ledgers if x is not ledger]
        for path in ledger:
            delete(spark, path)


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write as Parquet in the shared folder and read back.

    ``rows``: about how many there are, of cheap rows that need no more than a file for each
    half a million; otherwise each partition has its file.
    """
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // 500_000)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._colonnade_path = path
    return back


def keep(df: DataFrame, ledger: list[str]) -> DataFrame:
    ledger.remove(df._colonnade_path)
    return df


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    path = getattr(df, "_colonnade_path", None)
    if path:
        delete(df.sparkSession, path)
