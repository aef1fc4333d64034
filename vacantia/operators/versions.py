"""Relations written under older schemas, read as today's, and written back for readers that still need those.

A migration leads from one version to the next and back, as a table of columns for either way. What a relation was written
under is a stamp beside its files; reading applies the migrations between, as columns in one projection after the other,
so nothing is rewritten and predicates still reach the files where a column is carried over as it is.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "_schema_version"


@dataclass(frozen=True)
class Migration:
    """To `version` from the one before: columns that are made anew or added, and columns that go; and the way back.

    `check` is what must hold of every row once it is there; rows of which it doesn't are refused when they are written.
    """

    version: int
    up: Mapping[str, Column] = field(default_factory=dict)
    up_drops: tuple[str, ...] = ()
    down: Mapping[str, Column] = field(default_factory=dict)
    down_drops: tuple[str, ...] = ()
    check: Column | None = None


def posting_migrations() -> tuple[Migration, ...]:
    """The postings' own history: 2 has seniorities as an array, 3 adds the region of a source's host, none or `eu`."""
    none = F.array().cast("array<string>")
    return (
        Migration(
            2,
            up={"seniorities": F.when(F.col("seniority").isNull(), none).otherwise(F.array("seniority"))},
            up_drops=("seniority",),
            # An older reader sees the first level.
            down={"seniority": F.get("seniorities", F.lit(0))},
            down_drops=("seniorities",),
        ),
        Migration(3, up={"api_region": F.lit(None).cast("string")}, down_drops=("api_region",), check=F.col("api_region").isNull() | (F.col("api_region") == "eu")),
    )


def migrated(rows: DataFrame, migrations: tuple[Migration, ...], written: int, wanted: int) -> DataFrame:
    """`rows` of version `written` as `wanted` has them, later or earlier."""
    known = {m.version: m for m in migrations}
    missing = set(range(min(written, wanted) + 1, max(written, wanted) + 1)) - set(known)
    if missing:
        raise ValueError(f"no migration leads to {sorted(missing)}")
    for v in range(written + 1, wanted + 1):
        rows = rows.withColumns(dict(known[v].up)).drop(*known[v].up_drops)
    for v in range(written, wanted, -1):
        rows = rows.withColumns(dict(known[v].down)).drop(*known[v].down_drops)
    return rows


def _stamp(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{STAMP}")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written_version(spark: SparkSession, path: str) -> int:
    """The version a relation was written under; 1 for those from before there were stamps."""
    at, files = _stamp(spark, path)
    if not files.exists(at):
        return 1
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["version"]
    finally:
        stream.close()


def write_at(rows: DataFrame, path: str, migrations: tuple[Migration, ...], version: int) -> None:
    """Write rows of a version, with its stamp. Raises ValueError, and writes nothing, where a check up to it fails."""
    for m in migrations:
        if m.version <= version and m.check is not None and rows.where(~F.coalesce(m.check, F.lit(False))).limit(1).count():
            raise ValueError(f"rows that version {m.version} doesn't allow")
    rows.write.mode("overwrite").parquet(path)
    at, files = _stamp(rows.sparkSession, path)
    out = files.create(at, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()


def read_at(spark: SparkSession, path: str, migrations: tuple[Migration, ...], version: int | None = None) -> DataFrame:
    """A relation as a version has it, the newest by default, whatever it was written under."""
    newest = max((m.version for m in migrations), default=1)
    return migrated(spark.read.parquet(path), migrations, written_version(spark, path), newest if version is None else version)


def rewritten_at(spark: SparkSession, path: str, to: str, migrations: tuple[Migration, ...], version: int) -> None:
    """Write a relation once more under another version."""
    write_at(read_at(spark, path, migrations, version), to, migrations, version)
