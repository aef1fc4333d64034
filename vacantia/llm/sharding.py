"""Proportional stratified interleaving: every shard gets the mixture of sources.

Rows are shuffled by a seeded hash within their source; row r of n gets the fraction (r + phase) / n, where the phase
is a hash of the source, so that sources of one row spread out too. Rows sorted by fraction are cut into equal runs:
shard counts differ by one at most, and each source's share of a shard differs from its share of the whole by a row
or so. Law: `rows`.

No sort goes through one task. Ranks come from counts: hashes (then fractions) fall into about sqrt(rows) buckets, a
window over the small table of counts gives each bucket's first rank, and a window inside the bucket gives the rest.
A hot source is spread over all buckets.

Hashes are MD5 digests, which any other engine can repeat.

Defined cases: a null source is a stratum of its own; a null text has size 1 and the CRC of no bytes; ties in the
shuffle are broken by id, text size and CRC, after which rows are alike; an empty table gives an empty result; a very
long text goes no further than its size and checksum in the query, and is carried along by `interleave`; other columns
are carried along unless their names are among the result's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_bits, checkpointed, hash_bucket, named

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def ranked(rows: DataFrame, within: list[str], bucket: str, order: list[str], to: str, counted: str | None = None) -> DataFrame:
    """Rank from 0 within `within`, ordered by `bucket` and then `order`; `counted` names the number of rows there."""
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if counted:
        offsets = offsets.withColumn(counted, F.sum("_n").over(Window.partitionBy(*within)))
    inside = Window.partitionBy(*within, bucket).orderBy(*order)
    ranked = rows.join(offsets.drop("_n"), [*within, bucket]).withColumn(to, F.col("_before") + F.row_number().over(inside) - 1)
    return ranked.drop("_before")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with size and text_crc32, under these names whatever else bore them."""
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary"))})


def _digest(digits: int, *parts: str | Column) -> Column:
    """The first hexadecimal digits (15 at most) of the MD5 of the parts, as a number."""
    text = F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(digits)), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, source: str = "source", id: str = "doc_id", text: str | None = "text") -> DataFrame:
    """`docs` with size, text_crc32, law, shard (from 0), slot (gapless from 0 in each shard) and grown_shard (null).

    With text=None, `docs` holds size and text_crc32 already and no text has to be shuffled.
    """
    docs = docs if text is None else measured(docs, text)
    rows = docs.select(
        F.struct(*(named(c) for c in docs.columns if c not in ADDED)).alias("_row"),
        F.coalesce(F.concat(F.lit("="), named(source).cast("string")), F.lit("null")).alias("_stratum"),
        named(id).alias("_id"),
        "size",
        "text_crc32",
    )
    total = docs.count()
    bits = bucket_bits(total)
    rows = rows.withColumn("_hash", _digest(15, F.lit(seed), "_stratum", "_id", "size", "text_crc32"))
    rows = rows.withColumn("_bucket", hash_bucket(F.shiftleft("_hash", 4), bits))
    ties = ["_hash", "_id", "size", "text_crc32"]
    rows = ranked(rows, ["_stratum"], "_bucket", ties, "_rank", "_of").drop("_bucket")
    phase = _digest(13, F.lit(seed), "_stratum") / F.lit(float(1 << 52))
    rows = rows.withColumn("_fraction", (F.col("_rank") + phase) / F.col("_of"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_fraction") * (1 << bits))).withColumn("_all", F.lit(0))
    rows = ranked(rows, ["_all"], "_bucket", ["_fraction", "_stratum", *ties], "_place")
    rows = rows.withColumn("shard", F.expr(f"CAST((_place * {shards}) DIV {max(total, 1)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return rows.select("_row.*", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # Texts are read once, for their sizes and checksums; slim rows are counted and ranked.
    return interleave(checkpointed(measured(docs).drop("text")), text=None)


def _crc_of(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
    return byte


_CRC = "xor(c >> 8, 0)"
for _bit in range(8):
    _CRC = f"xor({_CRC}, {_crc_of(1 << _bit)} * ((xor(c, x) >> {_bit}) & 1))"
#: The law by plain windows over the whole table. DuckDB has no CRC-32, so it is summed byte by byte.
OP2_SQL = f"""
WITH bytes AS (SELECT doc_id, source, encode(coalesce("text", '')) AS b FROM documents),
d AS (
  SELECT doc_id, source, octet_length(b) + 1 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(b), '..'),
      lambda h: CAST('0x' || h AS BIGINT))), lambda c, x: {_CRC}), 4294967295) AS text_crc32
  FROM bytes),
h AS (
  SELECT doc_id, source, size, text_crc32, coalesce('=' || source, 'null') AS stratum,
    CAST('0x' || left(md5(concat_ws('|', '17', coalesce('=' || source, 'null'), coalesce(CAST(doc_id AS VARCHAR), 'null'), size, text_crc32)), 15) AS BIGINT) AS hash
  FROM d),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY hash, doc_id, size, text_crc32) - 1
    + CAST('0x' || left(md5(concat_ws('|', '17', stratum)), 13) AS BIGINT) / 4503599627370496.0) / count(*) OVER (PARTITION BY stratum) AS fraction
  FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, hash, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM f),
s AS (SELECT *, place * 8 // total AS shard FROM p)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
