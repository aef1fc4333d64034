"""WARC archives: writing records with Spark's text writer, reading them back, and putting segmented records together.

Writing. Every record is one line of a text file whose line separator is the blank line that ends a record
(CRLF CRLF), so the archives are plain WARC/1.1 in whatever store Spark writes to. Payloads are framed as HTTP
responses with chunked transfer coding; blocks longer than `segment` bytes are split into a first record and
continuations. Equal payloads are stored once: of a digest's pages the one with the least id is a response, the others
revisit it. Digests are counted before anything is joined; those that many pages share are broadcast, so that no task
gets all pages with one payload.

Reading. Gzipped archives (one member for each record, or a stream of many) are decompressed as a stream: a task holds one
record and a buffer. Plain ones are split, and their lines sorted by place, so a task holds as much of them. Segments are grouped by their origin's record id in a shuffle, ordered by
number, and accepted where the numbers run from 1 without gaps and the lengths add up to the stated total. Then the HTTP
head is cut off and the chunks are joined. Archives written here have at most RECORDS_PER_FILE records of at most
`segment` bytes; Spark's writer makes one gzip stream of a file.

Defined cases: a null html is an empty payload; a very long one is cut into segments, and held whole by a task when it is
joined again; records that can't be read (a head without a version line or a length,
an archive that ends too soon, broken chunks, stated numbers that are none) are left out, reading goes on at the next
record, and `rejects` lists them; a null url gets a URI made from the page id; null page ids stay null and never serve as the original of a
revisit while their digest has a page with an id; rows that repeat the original's id and payload are responses too; an
empty table gives empty archives and an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, looked_up, shared_path

CHUNK = 4096
SEGMENT = 16384
RECORDS_PER_FILE = 4000
CRLF = b"\r\n"
# Base-32 digits, as the digits of base 32 that count from 0 to V.
COUNTING, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: four times 40 bits, each as eight digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), COUNTING, BASE32)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to: the least id with the same payload, null for responses.

    Payloads of fewer than `least_bytes` bytes are always responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    counted = rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("least_id"))
    twice = checkpointed(counted.where("n > 1 AND least_id IS NOT NULL"))
    joined = looked_up(rows, twice, "payload_digest", "n", pages.count(), nulls=False)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk doesn't end where it says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records(rows: DataFrame, date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT) -> DataFrame:
    """A row `record` (binary, without the closing blank line) for each record or segment of `with_revisits` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, page, url, payload, digest, refers in batch.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                uri = f"urn:x-page:{page}" if url is None else "".join(url.split())
                # Rows may repeat a page id, so the row's number is part of the record's.
                own = f"<urn:x-record:{page}:{row}>"
                fields = [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page), ("Content-Type", "application/http;msgtype=response")]
                if not pd.isna(refers):
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", f"urn:x-page:{int(refers)}"), ("X-Refers-To-Page-ID", int(refers)), *fields], b"HTTP/1.1 200 OK\r\n\r\n"))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                if len(block) <= segment:
                    out.append(_record([("WARC-Type", "response"), *fields], block))
                    continue
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                out.append(_record([("WARC-Type", "response"), ("WARC-Segment-Number", 1), *fields], parts[0]))
                for k, part in enumerate(parts[1:], 2):
                    total = len(block) if k == len(parts) else None
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-record:{page}:{row}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
            yield pd.DataFrame({"record": pd.Series(out, dtype=object)})

    return rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload", "payload_digest", "refers_to").mapInPandas(run, "record binary")


def write_warc(recs: DataFrame, path: str) -> None:
    """Gzipped archives under `path`."""
    lines = recs.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parsed(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields by lower-case name, block, fault) of each record of an archive that comes in parts of any size.

    Where a record can't be told from what follows, its fault is given and the next version line is looked for.
    """
    held, more = bytearray(), iter(parts)

    def filled(enough: Callable[[], bool]) -> bool:
        while not enough():
            if (part := next(more, None)) is None:
                return False
            held.extend(part)
        return True

    def skip() -> None:
        """Drop what is held up to the next version line behind a blank one; everything, if there is none."""
        mark = b"\r\n\r\nWARC/"
        while (found := held.find(mark)) < 0:
            del held[: max(0, len(held) - len(mark) + 1)]
            if not filled(lambda least=len(held): len(held) > least):
                held.clear()
                return
        del held[: found + 4]

    while filled(lambda: bool(held.lstrip(b"\r\n"))):
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not filled(lambda: b"\r\n\r\n" in held):
            yield {}, b"", "the archive ends inside a head"
            return
        end = held.index(b"\r\n\r\n")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        fault = None if lines[0].startswith("WARC/") else "no version line"
        length = head.get("content-length", "")
        if fault is None and not (length.isascii() and length.isdigit()):
            fault = "no length"
        if fault:
            yield head, b"", fault
            skip()
            continue
        size = end + 4 + int(length)
        if not filled(lambda: len(held) >= size):
            yield head, b"", "the archive ends inside a record"
            skip()
            continue
        yield head, bytes(held[end + 4 : size]), None
        del held[:size]


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


FIELDS = "record_id string, record_type string, page_id long, digest string, refers_to long, number int, total long, block binary, fault string"


def _number(text: str | None, bits: int) -> int | None:
    """A stated whole number of so many bits; None for anything else."""
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return n if -(1 << bits - 1) <= (n := int(text)) < 1 << bits - 1 else None


def _records(parts: Iterable[bytes]) -> Iterator[pd.DataFrame]:
    """The records of one archive, a few at once."""
    rows, held = [], 0
    for head, block, fault in parsed(parts):
        kind = head.get("warc-type")
        if fault is None and kind is not None and kind not in ("response", "revisit", "continuation"):
            continue
        origin = head.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id")
        stated = [head.get(x) for x in ("x-page-id", "x-refers-to-page-id", "warc-segment-number", "warc-segment-total-length")]
        numbers = [_number(x, bits) for x, bits in zip(stated, (64, 64, 32, 64), strict=True)]
        if fault is None:
            fault = "no type" if kind is None else "no record id" if origin is None else None
        if fault is None and any(n is None and x not in (None, "None") for n, x in zip(numbers, stated, strict=True)):
            fault = "a number that is none"
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        rows.append((origin, kind, numbers[0], digest, *numbers[1:], block, fault))
        held += len(block)
        if held > 1 << 24:
            yield _frame(rows)
            rows, held = [], 0
    yield _frame(rows)


SEPARATOR = "\r\n\r\n"


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of archives, in order, cut at SEPARATOR: a line and the separator behind it are a part of the stream."""

    def lines() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for path, line in zip(batch["path"], batch["line"], strict=True):
                yield path, bytes(line) + SEPARATOR.encode()

    for _, parts in groupby(lines(), key=itemgetter(0)):
        yield from _records(part for _, part in parts)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record and segment of the archives under `path`; record_id is the origin's for continuations.

    Files that end in .gz can't be split, so that a task gets their lines in order. Parts of others are brought together
    and sorted by their place in the file, which spills to disk where it must.
    """
    zipped = spark.read.option("lineSep", SEPARATOR).option("pathGlobFilter", "*.gz").text(path)
    zipped = zipped.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    plain = spark.read.option("lineSep", SEPARATOR).option("pathGlobFilter", "*.warc").text(path)
    place = [F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line_number")]
    plain = plain.select(F.col("_metadata.file_path").alias("path"), *place, F.col("value").cast("binary").alias("line"))
    plain = plain.repartition("path").sortWithinPartitions("path", "start", "line_number").select("path", "line")
    return zipped.mapInPandas(_streamed, FIELDS).union(plain.mapInPandas(_streamed, FIELDS))


def rejects(recs: DataFrame) -> DataFrame:
    """record_id, record_type and fault of the records that can't be read: their heads, lengths or chunks are broken."""
    heads = recs.where("fault IS NOT NULL").select("record_id", "record_type", "fault")
    bodies = with_payloads(reassembled(recs)).where("fault IS NOT NULL")
    return heads.union(bodies.select("record_id", "record_type", "fault"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    out = pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "number": "Int32", "total": "Int64"})


def reassembled(recs: DataFrame) -> DataFrame:
    """Whole records: segments in order of their numbers, as one block; those with gaps or another length are left out.

    Only segments are shuffled, and a group is one record's block.
    """
    recs = recs.where("fault IS NULL")
    whole = recs.where("number IS NULL").select("record_id", "record_type", "page_id", "digest", "refers_to", "block")
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    rows = recs.where("number IS NOT NULL").groupBy("record_id").agg(parts.alias("_parts"), F.max("total").alias("total"), *(first(c) for c in ("record_type", "page_id", "digest", "refers_to")))
    rows = rows.where(F.transform("_parts.number", lambda x: x.cast("int")) == F.sequence(F.lit(1), F.size("_parts")))
    rows = rows.withColumn("block", F.aggregate(F.col("_parts.block"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)))
    rows = rows.where(F.octet_length("block") == F.col("total"))
    return whole.union(rows.select(*whole.columns))


def with_payloads(whole: DataFrame) -> DataFrame:
    """record_id, page_id, record_type, refers_to, stated_digest, the decoded payload (null for revisits) and fault, where
    the chunks are broken."""

    def read(kind: str, block: bytes) -> tuple[bytes | None, str | None]:
        try:
            return (_payload(block) if kind == "response" else None), None
        except ValueError:
            return None, "broken chunks"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(k, b) for k, b in zip(batch["record_type"], batch["block"], strict=True)]
            payload, fault = (pd.Series([x[k] for x in found], dtype=object) for k in (0, 1))
            yield batch.drop(columns="block").assign(payload=payload, fault=fault)

    rows = whole.select("record_id", "page_id", "record_type", "refers_to", F.col("digest").alias("stated_digest"), "block")
    return rows.mapInPandas(run, "record_id string, page_id long, record_type string, refers_to long, stated_digest string, payload binary, fault string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page of the archives: payload_bytes and payload_digest as found in the payload itself; for revisits
    those of the response they refer to. Payloads whose digest isn't the stated one are left out."""
    rows = with_payloads(reassembled(read_records(spark, path))).where("fault IS NULL")
    # The archives are read once; what goes on is as small as the digests.
    rows = checkpointed(rows.select("page_id", "record_type", "refers_to", "stated_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")))
    good = rows.where("record_type = 'response' AND payload_digest = stated_digest")
    # What many revisits refer to is broadcast.
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").withColumn("_key", F.concat_ws(":", "refers_to", "stated_digest"))
    asked = revisits.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    found = good.groupBy(F.concat_ws(":", "page_id", "payload_digest").alias("_key")).agg(F.min("payload_bytes").alias("payload_bytes"))
    again = looked_up(revisits, asked.join(found, "_key"), "_key", "_n", revisits.count(), nulls=False).where("payload_bytes IS NOT NULL")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return good.select(*columns).union(again.withColumn("payload_digest", F.col("stated_digest")).select(*columns))


def archived(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write `pages` to archives under `path` and read them back."""
    write_warc(records(with_revisits(pages, least_bytes)), path)
    return read_pages(pages.sparkSession, path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "archives"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
least_ids AS (SELECT t, min(page_id) AS least_id FROM p GROUP BY t),
h AS (
  SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, least_id,
         list_transform(generate_series(0, 31), lambda k: list_sum(list_transform(generate_series(0, 4), lambda j:
           CAST(substr(bits, k * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))) AS fives
  FROM (SELECT page_id, t, array_to_string(list_transform(string_split(sha1(t), ''), lambda c:
          right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS bits FROM p) q
  JOIN p USING (page_id, t) JOIN least_ids USING (t)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least_id THEN least_id END AS refers_to
FROM h
"""
