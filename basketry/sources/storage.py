"""Staged intermediate tables in the folder all executors share.

Some jobs need an intermediate result exactly once and then read it several times (global
ranks, cluster sums). Writing it as Parquet cuts the lineage, survives lost executors and gives
the next job true size statistics and column pruning.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Lists of staged folders, one for each open ``staging`` block; the innermost comes last.
_open: list[list[str]] = []
_chosen: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that a ``staging`` block names, else ``spark.checkpoint.dir``.

    Only a session whose tasks run inside the driver may leave both unset; its staged tables go
    below its warehouse. Any other session must name a folder that all executors reach.
    """
    configured = _chosen[-1] if _chosen else spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        configured = spark.conf.get("spark.sql.warehouse.dir") + "/_staged"
    return configured.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the application's part of the shared folder."""
    application = spark.conf.get("spark.app.id", "session")
    target = f"{shared_folder(spark)}/{application}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(target)
    return target


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once and return it read back from the shared folder."""
    spark = frame.sparkSession
    target = new_folder(spark, label)
    frame.write.parquet(target)
    return spark.read.schema(frame.schema).parquet(target)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession, folder: str | None = None) -> Iterator[list[str]]:
    """Stage below ``folder`` and delete at the end what was staged inside the block.

    Frames that read a staged table must be written out before the block ends.
    """
    staged: list[str] = []
    _open.append(staged)
    if folder:
        _chosen.append(folder)
    try:
        yield staged
    finally:
        _open.pop()
        if folder:
            _chosen.pop()
        for target in staged:
            remove_folder(spark, target)
