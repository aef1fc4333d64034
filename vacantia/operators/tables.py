"""Stored relations: written once in a folder that driver and executors share, and read as often as they are searched."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="tables-")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a relation as Parquet and read it back: predicates on it then meet columns, not the work behind them."""
    path = path or f"{shared_folder(df.sparkSession)}/relation-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` on all cores, where its files give fewer partitions than there are: a few large row groups would keep them idle.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


_KNOWN: dict[tuple[str, ...], str] = {}


def stored_once(spark: SparkSession, name: str, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written once in an application for each state of the files that `source` reads, and reread after.

    Where the folder has gone meanwhile, it is written again.
    """

    def on(path: str) -> tuple:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(spark._jsc.hadoopConfiguration())

    state = []
    for file in sorted(source.inputFiles()):
        at, files = on(file)
        found = files.getFileStatus(at)
        state.append(f"{file} {found.getLen()} {found.getModificationTime()}")
    key = (spark.sparkContext.applicationId, name, *state)
    if key in _KNOWN:
        mark, files = on(f"{_KNOWN[key]}/_SUCCESS")
        if files.exists(mark):
            return spark.read.parquet(_KNOWN[key])
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    make().write.parquet(path)
    _KNOWN[key] = path
    return spark.read.parquet(path)
