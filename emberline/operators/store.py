"""Tables that are written on the way: in the folder that all executors share, so that lost executors don't matter."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the write that needed them is done, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Only a local session may do without one; a folder of its own is then set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-ck-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: The tables written so far by the steps of :func:`settled` that are under way.
_under_way: list[list[DataFrame]] = []


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read back: what follows doesn't repeat what came before.

    The shuffle files of the write are deleted after it; nothing else reads them.
    """
    path = shared_path(df.sparkSession, label)
    with _cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _under_way:
        _under_way[-1].append(out)
    return out


def settled(step: Callable[[], DataFrame], label: str) -> DataFrame:
    """What the step gives, written; the tables that it wrote on the way are deleted."""
    _under_way.append([])
    try:
        out = written(step(), label)
    finally:
        made = _under_way.pop()
    removed(*made[:-1])
    if _under_way:
        _under_way[-1].append(out)
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables of :func:`written` that nothing needs any more."""
    for df in tables:
        files = df.inputFiles()
        if not files:
            continue
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
