"""The feed's layout with keyset pages, schema versions, and top-k reports without a sort of whole groups."""

import datetime as dt
import random
from itertools import islice

import pytest
from pyspark.sql import functions as F

from vacantia.operators import audits, feedstore, search, versions
from vacantia.operators.feedstore import Cursor, FeedStore, cursor_behind

POSTING = "id string, title string, role string, stack array<string>, seniorities array<string>, posted_at timestamp"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(f"p:{k:04d}", "t", rng.choice(("backend", "data", None)), [rng.choice(("python", "java", "go"))], [], dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(100))) for k in range(1500)]
    rows += [(f"q:{k:04d}", "t", "designer", [], [], dt.datetime(2023, 1, 1)) for k in range(200)]
    jobs = spark.createDataFrame(rows, POSTING).persist()
    held = FeedStore(spark, str(tmp_path_factory.mktemp("feed")))
    held.write(jobs, 12)
    return held, jobs


def test_pages_follow_each_other(store):
    held, jobs = store
    request = search.Request(limit=170)
    want = [r.id for r in jobs.orderBy(F.desc("posted_at"), "id").collect()]
    got, after, opened = [], None, []
    while True:
        page, files = held.page(request, after)
        got += [r.id for r in page.collect()]
        opened.append(len(files))
        if (after := cursor_behind(page)) is None:
            break
    assert got == want and max(opened) <= 4 < held.spark.read.parquet(f"{held.path}/files").count()


def test_files_without_hits_stay_closed(store):
    held, jobs = store
    assert held.spark.read.parquet(f"{held.path}/files").agg(F.sum("n")).first()[0] == jobs.count()
    wanted = search.Request(role="backend", stack=("python",), seniority="senior", locations=("remote",))
    old = [r.file for r in held.candidates(search.Request()).collect() if r.roles == ["designer"]]
    assert old and not set(old) & {r.file for r in held.candidates(wanted).collect()}
    last = jobs.where("posted_at < '2023-06-01'").orderBy("id").first()
    cursor = Cursor(-int(last.posted_at.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000, last.id)
    page, files = held.page(search.Request(limit=50), cursor)
    assert set(files) <= set(old) | {r.file for r in held.candidates(search.Request()).collect() if "designer" in r.roles}
    assert [r.id for r in page.collect()] == [f"q:{k:04d}" for k in range(1, 51)]


def test_versions_lead_up_and_down(spark, tmp_path):
    steps = versions.posting_migrations()
    old = spark.createDataFrame([("a", "senior"), ("b", None)], "id string, seniority string")
    versions.write_at(old, str(tmp_path / "1"), steps, 1)
    old.write.parquet(str(tmp_path / "0"))  # from before there were stamps
    for name in "01":
        now = versions.read_at(spark, str(tmp_path / name), steps)
        assert {tuple(r) for r in now.select("id", "api_region").collect()} == {("a", None), ("b", None)} and {r.id: r.seniorities for r in now.collect()} == {"a": ["senior"], "b": []}
    now = versions.read_at(spark, str(tmp_path / "1"), steps).withColumn("api_region", F.when(F.col("id") == "a", "eu")).withColumn("seniorities", F.when(F.col("id") == "a", F.array(F.lit("lead"), F.lit("senior"))).otherwise(F.col("seniorities")))
    versions.write_at(now, str(tmp_path / "3"), steps, 3)
    assert versions.written_version(spark, str(tmp_path / "3")) == 3
    assert {tuple(r) for r in versions.read_at(spark, str(tmp_path / "3"), steps, 1).select("id", "seniority").collect()} == {("a", "lead"), ("b", None)}
    assert "api_region" not in versions.read_at(spark, str(tmp_path / "3"), steps, 2).columns
    with pytest.raises(ValueError):
        versions.write_at(now.withColumn("api_region", F.lit("us")), str(tmp_path / "x"), steps, 3)
    with pytest.raises(ValueError):
        versions.read_at(spark, str(tmp_path / "3"), steps, 4)


def test_samples_are_limited_before_the_shuffle(spark):
    flags = ", ".join(f"{k} boolean" for k in audits.SAMPLES if k not in ("description_enriched", "true_drift"))
    audit = spark.createDataFrame([(f"i{k}", "c", f"t{k:05d}", None, True, False, True, False) for k in range(3000)], f"id string, company string, title string, stack_mismatch string, {flags}")
    rows = audits.samples(audit)
    assert rows._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert counts == {k: audits.SAMPLES[k] for k in ("role_differs", "facets_differ")}


def test_pages_are_read_as_they_are_asked_for(store, monkeypatch):
    held, jobs = store
    want = [r.id for r in jobs.orderBy(F.desc("posted_at"), "id").limit(15).collect()]
    read = []
    monkeypatch.setattr(FeedStore, "page", lambda self, *given, _page=FeedStore.page: read.append(given) or _page(self, *given))
    pages = list(islice(held.pages(search.Request(limit=5)), 3))
    assert [r.id for p in pages for r in p.collect()] == want and len(read) == 3
    # What a page holds is at hand: it is not searched again.
    assert not any(p.inputFiles() for p in pages)


def test_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feedstore, "FILE_ROWS", 100)
    rows = [(f"p:{k}", "t", None, [], [], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)) for k in range(1000)]
    held = FeedStore(spark, str(tmp_path / "feed"))
    held.write(spark.createDataFrame(rows, POSTING))
    files = [r.n for r in held.spark.read.parquet(f"{held.path}/files").collect()]
    assert len(files) >= 8 and sum(files) == 1000 and max(files) <= 300
