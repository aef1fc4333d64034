"""Ingest, search, audits, boards, links and streams on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions import places
from vacantia.operators import audits, ingest, search
from vacantia.operators.relation import Relation
from vacantia.operators.tables import stored
from vacantia.sources import boards, links
from vacantia.streaming import state
from vacantia.streaming.ingest import start_ingest

RAW = "provider string, external_id string, title string, company string, location_raw string, posted_at string, is_flagged_remote boolean, url string"


def classified(spark, rows):
    df = spark.createDataFrame(rows, RAW).withColumn("posted_at", F.to_timestamp("posted_at"))
    return stored(ingest.classified(df, places.gazetteer(spark)))


ROWS = [
    ("ashby", "1", "Senior Backend Engineer (Python)", "Acme", "Acme - Berlin, DE", "2024-01-05 00:00:00", False, "u1"),
    ("lever", "2", "Backend Developer Python", "Acme", "Remote", "2024-01-04 00:00:00", True, "u2"),
    ("lever", "3", "US Remote Python Backend Engineer", "Beta", "Remote", "2024-01-03 00:00:00", True, "u3"),
    ("workable", "4", "Accountant", "Beta", "Paris, France", "2024-01-02 00:00:00", False, "u4"),
    ("workable", "5", "Java Backend Engineer", "Beta", None, None, False, "u5"),
    ("greenhouse", "6", "Python Backend Engineer", "Gamma", "Hybrid - remote", "2024-01-01 00:00:00", True, "u6"),
]


def test_classified(spark):
    rows = {r.id: r for r in classified(spark, ROWS).collect()}
    assert set(rows) == {"ashby:1", "lever:2", "lever:3", "workable:4", "greenhouse:6"}  # no date, no posting
    a = rows["ashby:1"]
    assert (a.title, a.location, a.role, a.seniorities, a.location_countries) == ("Senior Backend Engineer", "Berlin, DE", "backend", ["senior"], ["germany"])
    assert rows["lever:2"].location == "Remote" and rows["lever:2"].location_tokens == ["remote"]
    assert rows["lever:3"].location_countries == ["united states"]
    assert rows["workable:4"].role is None and len(a.hash) == 64


def test_feed_and_preview(spark):
    jobs = classified(spark, ROWS)
    as_of = F.lit("2024-01-05 12:00:00").cast("timestamp")
    ids = lambda **kw: [r.id for r in search.feed(jobs, search.Request.of(**kw), as_of).collect()]
    assert ids() == ["ashby:1", "lever:2", "lever:3", "workable:4", "greenhouse:6"]
    assert ids(limit=2, page=2) == ["lever:3", "workable:4"]
    base = {"role": "backend", "stack": ["python"], "seniority": "senior"}
    assert ids(**base, location=["germany"]) == []  # the title strip took "(Python)"
    assert ids(**base, location=["remote"]) == ["lever:2", "lever:3", "greenhouse:6"]
    assert ids(**base, location=["fully-remote"]) == ["lever:2"]
    assert ids(**base, location=["US", "fully-remote"]) == ["lever:2", "lever:3"]
    assert [r.is_new for r in search.feed(jobs, search.Request.of(limit=2), as_of).collect()] == [True, False]
    assert [r.id for r in search.preview(jobs, "DE", as_of).collect()] == ["ashby:1", "lever:2", "lever:3", "greenhouse:6"]
    assert [r.id for r in search.preview(jobs, None, as_of, 1).collect()] == ["ashby:1"]
    (t,) = search.totals(jobs, search.Request.of(limit=2)).collect()
    assert (t.total, t.total_pages) == (5, 3) and search.total_pages(0, 50) == 1


@pytest.mark.parametrize("bad", [{"role": "poet"}, {"role": "backend"}, {"role": "qa", "seniority": "mid"}, {"stack": ["objc"]}, {"x": 1}, {"seniority": "boss"}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        search.Request.of(**bad)


def test_request_values():
    assert search.as_strings(["a", 1, None, " ", {"x": 1}, True]) == ("a", "1", "true")
    assert search.as_strings(None) is None and search.as_strings("") is None
    assert search.Request.of(limit=900, page=-3).limit == 200 and search.Request.of(page=-3).page == 1
    assert search.preview_country("de") == "germany" and search.preview_country("zz") is None and search.preview_country(" USA ") == "united states"


def test_new_only(spark):
    jobs = classified(spark, ROWS)
    stored = jobs.where("id = 'ashby:1'")
    again = jobs.union(jobs.withColumn("id", F.concat("id", F.lit("x"))))  # other ids, same hashes
    assert sorted(r.id for r in ingest.new_only(again, stored).collect()) == ["greenhouse:6", "lever:2", "lever:3", "workable:4"]
    assert ingest.new_only(again, jobs).count() == 0


def test_reconcile_upsert_and_updates(spark):
    jobs = classified(spark, ROWS)
    scope = jobs.where("provider = 'lever' AND company = 'Beta'")
    assert "lever:3" not in {r.id for r in ingest.reconciled(jobs, scope, jobs.limit(0)).collect()}
    assert ingest.reconciled(jobs, scope, scope).count() == jobs.count()
    cat = spark.createDataFrame([("a", "x", False, "old"), ("a", "y", True, "old")], "provider string, external_id string, is_active boolean, name string")
    new = spark.createDataFrame([("a", "x", False, "1", 1), ("a", "x", False, "2", 2), ("b", "z", False, "3", 1)], "provider string, external_id string, is_active boolean, name string, seq int")
    got = sorted(tuple(r) for r in ingest.upserted(cat, new, ["provider", "external_id"], {"is_active": F.lit(True)}, "seq").collect())
    assert got == [("a", "x", True, "2"), ("a", "y", True, "old"), ("b", "z", True, "3")]
    changes = ingest.changed_only(jobs, jobs.withColumn("location", F.when(F.col("id") == "lever:2", None).otherwise(F.col("location"))), ["location"])
    assert [r.id for r in changes.collect()] == ["lever:2"]
    assert ingest.updated(jobs, changes, ["location"]).where("location IS NULL").count() == 1


def test_audits(spark):
    jobs = classified(spark, ROWS).withColumn("location_raw", F.col("location_raw"))
    odd = jobs.withColumn("location_countries", F.when(F.col("id") == "workable:4", F.array(F.lit("spain"), F.lit("france"))).otherwise(F.col("location_countries")))
    found = {r.id: (r.reason, r.category) for r in audits.mismatches(odd, places.gazetteer(spark)).collect()}
    assert found["workable:4"] == ("countries", "hint_delta_or_stale")
    counts = {r.category: r.n for r in audits.category_counts(audits.mismatches(odd, places.gazetteer(spark))).collect()}
    assert set(counts) == set(audits.CATEGORIES) and sum(counts.values()) == len(found)
    assert [r.id for r in audits.empty_geography(jobs).collect()] == ["greenhouse:6"]
    (c,) = audits.conditional_counts(jobs).collect()
    assert (c.scanned, c.no_role, c.role_differs, c.seniority_differs) == (5, 1, 0, 0)


def extracted(spark, provider, jobs):
    payload = json.dumps({"jobs": jobs} if provider in boards.WRAPPED else jobs)
    landed = spark.createDataFrame([("acme", "Acme", payload), ("bad", "Bad", "{not json"), ("none", "None", None)], "slug string, company string, payload string")
    return boards.extract(landed, provider, F.lit("2020-01-01").cast("timestamp")).orderBy("external_id").collect()


def test_ashby(spark):
    place = lambda c: {"postalAddress": {"addressCountry": c}}
    jobs = [
        {"id": "1", "title": " A ", "location": "Remote", "address": place("Spain"), "secondaryLocations": [{"location": "Rome", "address": place("Italy")}, {"location": "rome"}], "jobUrl": "", "applyUrl": "u", "publishedAt": "2024-01-02T00:00:00Z"},
        {"title": "B", "jobUrl": "u", "publishedAt": "nonsense", "workplaceType": "Remote", "address": place("European  Union")},
        {"id": "3", "title": "C", "jobUrl": "u", "isListed": False}, {"id": "4", "title": "", "jobUrl": "u"}, {"id": "5", "title": "E"},
    ]
    a, b = extracted(spark, "ashby", jobs)
    assert (a.external_id, a.title, a.location_raw, a.location_hints, a.is_flagged_remote) == ("1", "A", "Remote, Spain | Rome", ["Spain", "Italy"], False)
    assert (b.external_id, b.location_raw, b.location_hints, b.is_flagged_remote, b.posted_at.year) == ("acme:B:nonsense", "Unknown", [], True, 2020)


def test_greenhouse(spark):
    meta = lambda v: [{"id": 1, "name": "Job Posting Location", "value": v}]
    base = {"title": "A", "absolute_url": "u"}
    jobs = [{**base, "id": 1, "location": {"name": "Hybrid"}, "metadata": meta(["Oslo", " ", "Bergen"])}, {**base, "id": 2, "location": {"name": "Rome"}, "metadata": meta("Oslo")}, {**base, "id": 3, "location": {"name": "Remote or Anywhere"}, "metadata": meta(None)}, {**base, "id": 0}, {"id": 5, "title": "B"}]
    assert [(r.external_id, r.location_raw, r.is_flagged_remote) for r in extracted(spark, "greenhouse", jobs)] == [("1", "Oslo, Bergen", False), ("2", "Rome", False), ("3", "Remote or Anywhere", True)]


def test_workable(spark):
    base = {"title": "A", "url": "u", "published_on": "2024-01-01"}
    jobs = [{**base, "id": "1", "locations": [{"city": "Oslo", "country": "Norway"}, {"country_name": "Spain"}, {"city": "Rome", "state_code": "RM", "country": "Italy", "telecommuting": True}]}, {**base, "shortcode": "2", "description": "<p>Work from home</p>"}, {**base, "id": "3", "published_on": "", "state": "draft"}, {**base, "id": "4", "url": "", "shortlink": "s", "location": {"location_str": " Oslo "}}]
    assert [(r.external_id, r.location_raw, r.is_flagged_remote, r.url) for r in extracted(spark, "workable", jobs)] == [("1", "Oslo, Norway / Spain / Rome, RM, Italy", True, "u"), ("2", "Unknown", True, "u"), ("4", "Oslo", False, "s")]


def test_lever(spark):
    jobs = [{"id": "1", "text": " A ", "hostedUrl": " u ", "createdAt": 1704067200000, "country": "ES", "workplaceType": "remote", "categories": {"location": "Oslo", "allLocations": ["oslo", "Rome", "Rome"]}, "descriptionPlain": "x", "lists": [{"text": "T", "content": "<li>y</li>"}, {"content": "z"}]}, {"id": "2", "text": " ", "hostedUrl": "u"}, {"id": "3", "text": "C"}]
    (a,) = extracted(spark, "lever", jobs)
    assert (a.title, a.url, a.location_raw, a.location_hints, a.is_flagged_remote, a.description, a.posted_at.year) == ("A", "u", "Oslo | Rome", ["ES"], True, "x\n\nT\ny\n\nz", 2024)


def test_links(spark):
    html = '<a href="https://boards.greenhouse.io/Acme/jobs/1">x</a><A class=b HREF=\'https://foo.workable.com/,\'></a><a href="https://jobs.ashbyhq.com/beta"><a href="#x"><a href="https://boards.greenhouse.io/embed"><a href="https://jobs.ashbyhq.com/beta">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = [(r.position, r.b and tuple(r.b)) for r in links.first_links(pages).select("position", links.board_of(F.col("href")).alias("b")).orderBy("position").collect()]
    assert got == [(1, ("greenhouse", "acme")), (2, ("workable", "foo")), (3, ("ashby", "beta")), (4, None), (5, None)]
    cat = lambda rows: spark.createDataFrame(rows, "provider string, external_id string, name string")
    merged = links.merged_catalog(cat([("lever", "a", "1"), ("ashby", "b", "1")]), cat([("lever", "A", "2")])).collect()
    assert [tuple(r) for r in merged] == [("ashby", "b", "1"), ("lever", "A", "2")]


def test_probe_and_host(spark):
    rows = spark.createDataFrame([(200, False), (404, False), (500, False), (None, True)], "status int, failed boolean")
    assert [r[0] for r in rows.select(boards.probe_result(F.col("status"), F.col("failed"))).collect()] == ["ok", "invalid", "warn", "error"]
    assert ".eu." in spark.range(1).select(boards.api_host(F.lit("EU"))).first()[0]


def events(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), rng.randrange(200_000)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "event_id long, user long, at long")


@pytest.mark.parametrize("machine", [state.Breaker(3000, 4, 9000), state.Limiter(3, 5000, 2000)], ids=["breaker", "limiter"])
def test_machines(spark, tmp_path, machine):
    rows, df = events(spark)
    want = []
    for user in range(4):
        held = machine.start()
        for i, _, at in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            held, decision = machine.step(held, at)
            want.append((user, at, i, *decision))
    assert sorted(map(tuple, state.folded(df, machine, "user", "at", "event_id").collect())) == sorted(want)
    for k in range(3):  # three files in order of time: three micro-batches
        df.where(f"at >= {k * 70_000} AND at < {(k + 1) * 70_000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = state.streamed(stream, machine, "user", "at", "event_id")
    query = out.writeStream.format("memory").queryName(type(machine).__name__.lower()).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table(type(machine).__name__.lower()).collect())) == sorted(want)


def test_breaker_by_its_definition():
    machine, held = state.Breaker(60_000, 10, 300_000), ([], 0)
    opened = []
    for at in range(0, 1_000_000, 5_000):
        held, (opens, _) = machine.step(held, at)
        opened += [at] * opens
    assert opened == [45_000, 350_000, 655_000, 960_000]


def test_stream_equals_batch(spark, tmp_path):
    jobs = classified(spark, ROWS)
    jobs.coalesce(1).write.parquet(str(tmp_path / "landed"))
    jobs.coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))  # delivered twice
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    table = Relation(spark, str(tmp_path / "table"), jobs.schema)
    start_ingest(stream, table, str(tmp_path / "cp")).awaitTermination()
    key = lambda rows: sorted(map(str, rows))
    assert key(table.read().collect()) == key(ingest.new_only(jobs, jobs.limit(0)).collect())
