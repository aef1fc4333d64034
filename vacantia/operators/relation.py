"""Relations that grow by batches: what a batch adds and takes away is written, not the relation.

A relation lies in parts, by provider and a hash of the company. A batch writes the rows it puts and the ids that are gone
(in folders of the parts they touch) and then a manifest, the list of all folders that make the relation. A row is live
unless its id is gone at a later version than the row's own. Readers merge that part by part: parts without gone ids are
plain scans, only the others are joined.

Manifests are renamed into place, so a version is there as a whole or not at all, and a version that is there is not
written again: a batch that comes twice changes nothing. One writer at a time is assumed, as a streaming query is one.

`compact` writes parts anew that have gone ids or many folders; `expire` deletes what the last manifests don't name, so
that readers of those, and no others, go on undisturbed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from vacantia.operators.ingest import new_only
from vacantia.operators.tables import stored

AT, PROVIDER, BUCKET = "_at", "_provider", "_bucket"
PUT, GONE = "put", "gone"


@dataclass(frozen=True)
class Folder:
    """Rows that one version put, or ids that were gone with it, in these parts."""

    kind: str
    at: int
    path: str
    parts: tuple[str, ...]


class Relation:
    """Rows of `schema`, with a unique `key` among the live ones; of new rows that share one, the first by `order` comes.

    Null providers and companies have parts of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, company: str = "company", buckets: int = 16, key: str = "id", order: tuple[str, ...] = ("posted_at", "id")):
        self.spark, self.path, self.schema, self.company, self.buckets, self.key = spark, path.rstrip("/"), schema, company, buckets, key
        self.order = list(order)

    # Manifests.

    def _files(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list:
        at, files = self._files(path)
        return list(files.listStatus(at)) if files.exists(at) else []

    def manifests(self) -> list[tuple[int, int]]:
        """(version, revision) of each manifest, in order; compacting makes a new revision."""
        names = (f.getPath().getName() for f in self._listed(f"{self.path}/log"))
        return sorted(tuple(map(int, n.removesuffix(".json").split("-"))) for n in names if n.endswith(".json"))

    def version(self) -> int | None:
        found = self.manifests()
        return found[-1][0] if found else None

    def has(self, version: int) -> bool:
        """Whether this version, or a later one, is there."""
        last = self.version()
        return last is not None and last >= version

    def folders(self, below: int | None = None) -> list[Folder]:
        """The folders of the last manifest, or of the last one below a version."""
        found = [m for m in self.manifests() if below is None or m[0] < below]
        return self._read(found[-1]) if found else []

    def _read(self, manifest: tuple[int, int]) -> list[Folder]:
        at, files = self._files(self._name(manifest))
        stream = files.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [Folder(f["kind"], f["at"], f["path"], tuple(f["parts"])) for f in json.loads(text)]

    def _name(self, manifest: tuple[int, int]) -> str:
        return f"{self.path}/log/{manifest[0]:020d}-{manifest[1]:06d}.json"

    def _publish(self, manifest: tuple[int, int], folders: list[Folder]) -> None:
        text = json.dumps([f.__dict__ for f in folders])
        draft, files = self._files(f"{self.path}/log/draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(draft, self._files(self._name(manifest))[0]):
            files.delete(draft, False)
            raise RuntimeError(f"another writer has published {manifest}")

    # Reading.

    def part_columns(self) -> dict[str, Column]:
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(self.company).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")
        return {PROVIDER: F.coalesce(F.col("provider").cast("string"), F.lit("")), BUCKET: bucket}

    def parts_of(self, rows: DataFrame) -> set[tuple[str, int]]:
        """The parts that rows (with provider and company) fall in: providers times buckets at most."""
        made = rows.select(*(c.alias(n) for n, c in self.part_columns().items())).distinct()
        return {tuple(r) for r in made.collect()}

    def _scan(self, folders: list[Folder], kind: str, parts: set[str], schema: StructType) -> DataFrame:
        paths = [f"{f.path}/{p}" for f in folders if f.kind == kind for p in f.parts if p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, parts: set[tuple[str, int]] | None = None, below: int | None = None) -> DataFrame:
        """Live rows, of some parts or of all, as of the last version or the last one below a version."""
        folders = self.folders(below)
        wanted = {p for f in folders for p in f.parts}
        if parts is not None:
            wanted &= {self._folder_name(*p) for p in parts}
        mixed = {p for f in folders if f.kind == GONE for p in f.parts} & wanted
        stamped = StructType([*self.schema.fields]).add(AT, LongType())
        plain = self._scan(folders, PUT, wanted - mixed, stamped).select(*self.schema.names)
        if not mixed:
            return plain
        gone = self._scan(folders, GONE, mixed, StructType([self.schema[self.key]]).add(AT, LongType()))
        gone = gone.groupBy(self.key).agg(F.max(AT).alias("_gone_at"))
        rows = self._scan(folders, PUT, mixed, stamped).join(gone, self.key, "left")
        return plain.union(rows.where(f"_gone_at IS NULL OR _gone_at <= {AT}").select(*self.schema.names))

    # Writing.

    def _write(self, rows: DataFrame, kind: str, version: int) -> Folder | None:
        path = f"{self.path}/data/{version}-{kind}-{uuid.uuid4().hex}"
        rows = rows.withColumns({**self.part_columns(), AT: F.lit(version).cast("long")})
        if kind == GONE:
            rows = rows.select(self.key, AT, PROVIDER, BUCKET)
        # One file for a part, or several of a large one: Spark splits and joins the shuffle's partitions by size.
        rows.hint("rebalance", PROVIDER, BUCKET).write.partitionBy(PROVIDER, BUCKET).parquet(path)
        parts = [f"{p.getPath().getName()}/{b.getPath().getName()}" for p in self._listed(path) if p.isDirectory() for b in self._listed(p.getPath().toString())]
        return Folder(kind, version, path, tuple(sorted(parts))) if parts else None

    def commit(self, version: int, put: DataFrame | None, gone: DataFrame | None) -> bool:
        """Make a version of the last one, rows to put and rows (key, provider, company) that are gone. False if it is there."""
        if self.has(version):
            return False
        last = self.manifests()
        new = [self._write(rows, kind, version) for rows, kind in ((put, PUT), (gone, GONE)) if rows is not None]
        self._publish((version, 0), [*(self._read(last[-1]) if last else []), *(f for f in new if f)])
        return True

    def poll(self, version: int, answered: DataFrame, fetched: DataFrame) -> bool:
        """Take in complete snapshots: of `answered` (provider, company) what is new in `fetched` comes, what is missing goes.

        Snapshots are written as they have landed, since they are met three times. Of the relation, ids and hashes meet them;
        companies only in the parts of those that answer.
        """
        if self.has(version):
            return False
        fetched = stored(fetched, f"{self.path}/landed/{version}-{uuid.uuid4().hex}")
        scope = answered.select("provider", self.company).distinct()
        held = self.read(self.parts_of(scope)).select("id", "provider", self.company)
        gone = held.join(scope, ["provider", self.company], "left_semi").join(fetched.select("id"), "id", "left_anti")
        done = self.commit(version, new_only(fetched, self.read(), self.order), gone)
        at, files = self._files(f"{self.path}/landed")
        files.delete(at, True)
        return done

    def add(self, version: int, rows: DataFrame) -> bool:
        """Take in what is new of `rows`; nothing goes."""
        return False if self.has(version) else self.commit(version, new_only(rows, self.read(), self.order), None)

    def update(self, version: int, changes: DataFrame, columns: list[str]) -> bool:
        """Give rows new values: `changes` has the key and new_<column> for each of `columns`. What isn't changed isn't written."""
        if self.has(version):
            return False
        picked = [F.col(f"new_{c}").alias(c) if c in columns else F.col(c) for c in self.schema.names]
        rows = self.read().join(changes, self.key).select(*picked)
        return self.commit(version, rows, rows.select(self.key, "provider", self.company))

    # Upkeep.

    def compact(self, most_folders: int = 8) -> int:
        """Write parts anew that have gone ids or more than `most_folders` folders; how many parts there were."""
        last = self.manifests()
        folders = self._read(last[-1]) if last else []
        count: dict[str, int] = {}
        for f in folders:
            for p in f.parts:
                count[p] = count.get(p, 0) + (most_folders + 1 if f.kind == GONE else 1)
        full = {p for p, n in count.items() if n > most_folders}
        if not full:
            return 0
        rows = self.read({self._part_of(p) for p in full})
        made = self._write(rows, PUT, last[-1][0])
        kept = [Folder(f.kind, f.at, f.path, rest) for f in folders if (rest := tuple(p for p in f.parts if p not in full))]
        self._publish((last[-1][0], last[-1][1] + 1), [*kept, *([made] if made else [])])
        return len(full)

    def expire(self, keep: int = 3) -> int:
        """Delete all manifests but the last `keep`, and the folders that those don't name; how many folders there were."""
        known = self.manifests()
        named = {f.path for m in known[-keep:] for f in self._read(m)}
        names = {p.rsplit("/", 1)[1] for p in named}
        for m in known[:-keep]:
            at, files = self._files(self._name(m))
            files.delete(at, False)
        old = [f.getPath() for f in self._listed(f"{self.path}/data") if f.getPath().getName() not in names]
        for at in old:
            self._files(at.toString())[1].delete(at, True)
        return len(old)

    # Names of parts.

    def _names(self):
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    def _folder_name(self, provider: str, bucket: int) -> str:
        names = self._names()
        return f"{PROVIDER}={names.escapePathName(provider) if provider else names.DEFAULT_PARTITION_NAME()}/{BUCKET}={bucket}"

    def _part_of(self, folder: str) -> tuple[str, int]:
        provider, bucket = (x.split("=", 1)[1] for x in folder.split("/"))
        return ("" if provider == self._names().DEFAULT_PARTITION_NAME() else self._names().unescapePathName(provider)), int(bucket)
