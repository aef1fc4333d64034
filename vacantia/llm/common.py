"""Small helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import inspect
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rule `[^\x20\x09-\x0D]+` leaves it out.
WHITE = " \t\n\x0b\f\r"


#: A key with more than this part of all rows is hot.
HOT_SHARE = 1000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only where it is unset (tests)."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Hand Python workers few rows at once while an action runs: idle workers keep the memory of their largest batch."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def checkpointed(df: DataFrame, batch: int = 2000) -> DataFrame:
    """Cut the lineage with reliable files, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession, batch):
        return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as the cluster's own readers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete the table under `path` and its manifest."""
    for name in (path, f"{path}{MANIFEST}"):
        at, files = _file(spark, name)
        files.delete(at, True)


def input_print(df: DataFrame) -> str:
    """What tells a table's files from others: their names, lengths and times of change, hashed."""
    held = []
    for name in sorted(df.inputFiles()):
        at, files = _file(df.sparkSession, name)
        state = files.getFileStatus(at)
        held.append(f"{name} {state.getLen()} {state.getModificationTime()}")
    return hashlib.sha256("\n".join(held).encode()).hexdigest()


def code_print(*modules: ModuleType) -> str:
    """What tells these modules' source from another state of it."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


#: A table's manifest stands beside its folder.
MANIFEST = ".manifest"


def is_complete(spark: SparkSession, path: str, manifest: str) -> bool:
    """Whether a table has been written under `path` to its end, and for the same manifest."""
    at, files = _file(spark, f"{path}{MANIFEST}")
    return files.exists(at) and spark.sparkContext.wholeTextFiles(at.toString()).first()[1] == manifest


def complete(spark: SparkSession, path: str, manifest: str) -> None:
    """Note that the table under `path` is complete, and what it was made of."""
    at, files = _file(spark, f"{path}{MANIFEST}")
    out = files.create(at, True)
    out.write(bytearray(manifest.encode()))
    out.close()


def stored(df: DataFrame) -> DataFrame:
    """Like `checkpointed`, as a compressed table: for texts."""
    path = shared_path(df.sparkSession, "table")
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def looked_up(rows: DataFrame, table: DataFrame, key: str, rows_of: str, total: int, nulls: bool = True) -> DataFrame:
    """`rows` with the columns of `table` (one row for each key; `rows_of` says how many of the `total` rows have it).

    Keys that hold over a thousandth of all rows are fewer than a thousand, so they are broadcast; all others are joined
    by a shuffle in which no key is hot. Null keys stay where they are, and find nothing, like keys that aren't there;
    nulls=False says that there are none.
    """
    values = [c for c in table.columns if c not in (key, rows_of)]
    hot = F.col(rows_of) * HOT_SHARE > total
    often = table.where(hot).select(key, F.struct(*values).alias("_hit"))
    near = rows.where(F.col(key).isNotNull()).join(F.broadcast(often), key, "left")
    columns = [*rows.columns, *values]
    found = near.where("_hit IS NOT NULL").select(*rows.columns, "_hit.*").select(*columns)
    other = near.where("_hit IS NULL").drop("_hit").join(table.where(~hot).select(key, *values), key, "left").select(*columns)
    if not nulls:
        return found.union(other)
    keyless = rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values))
    return found.union(other).union(keyless)


def bucket_bits(rows: int) -> int:
    """Bits of a hash so that its buckets hold about as many rows as there are buckets: both grow as the square root."""
    return min(24, max(4, (max(rows, 1).bit_length() + 1) // 2))


def hash_bucket(hashed: Column, bits: int) -> Column:
    """The highest bits of a 64-bit hash: buckets keep the hash's unsigned order."""
    return F.shiftrightunsigned(hashed, 64 - bits)
