import datetime as dt
import json

import pytest
from pyspark.sql.types import StructType

from vacantia.functions import places
from vacantia.operators import audits, ingest
from vacantia.operators.relation import Relation
from vacantia.plans import catalog
from vacantia.streaming import polling

JOB = "struct<id:string,hash:string,provider:string,company:string,posted_at:timestamp>"
JOB_COLUMNS = "id string, hash string, provider string, company string, posted_at timestamp"
SOURCE = "id string, provider string, external_id string, name string, is_active boolean, sync_status string, last_synced_at timestamp"
ANSWER = f"source_id string, provider string, ok boolean, at timestamp, postings array<{JOB}>"
T = dt.datetime(2024, 1, 1)


def job(i, company="Acme"):
    return (f"ashby:{i}", f"h{i}", "ashby", company, T)


def test_snapshots_move_the_relations_on(spark, tmp_path):
    jobs = Relation(spark, str(tmp_path / "jobs"), StructType.fromDDL(JOB_COLUMNS), buckets=4)
    sources = Relation(spark, str(tmp_path / "sources"), StructType.fromDDL(SOURCE), company="name", buckets=2)
    first = [("1", "ashby", "acme", "Acme", True, "idle", None), ("2", "ashby", "bolt", "Bolt", True, "idle", None), ("3", "ashby", "gone", "Gone", False, "idle", None)]
    sources.commit(0, spark.createDataFrame(first, SOURCE), None)
    landing = str(tmp_path / "landing")

    def poll(*answers):
        spark.createDataFrame(list(answers), ANSWER).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(ANSWER).parquet(landing)
        polling.start_polling(stream, jobs, sources, str(tmp_path / "checkpoint"), compact_after=2, keep=1).awaitTermination()
        return {r.id for r in jobs.read().collect()}, {r.id: r.sync_status for r in sources.read().collect()}

    held, status = poll(("1", "ashby", True, T, [job(1), job(2), job(2)]), ("2", "ashby", True, T, [job(7, "Bolt")]), ("3", "ashby", True, T, [job(9, "Gone")]))
    assert held == {"ashby:1", "ashby:2", "ashby:7"} and status == {"1": "success", "2": "success", "3": "idle"}
    held, status = poll(("1", "ashby", True, T, [job(2), job(3)]), ("2", "ashby", False, T, None))
    assert held == {"ashby:2", "ashby:3", "ashby:7"} and status == {"1": "success", "2": "error", "3": "idle"}
    # The second batch was the last to be compacted: one manifest, and no ids that are gone.
    assert jobs.manifests() == [(2, 1)] and {f.kind for f in jobs.folders()} == {"put"}
    held, status = poll(("2", "ashby", True, T, []))
    assert held == {"ashby:2", "ashby:3"} and status["2"] == "success"


def test_intervals():
    assert polling.interval(30) == "30 minutes"
    for minutes in (0, 1441):
        with pytest.raises(ValueError):
            polling.interval(minutes)


def test_equal_order_is_settled_by_content(spark):
    stored = spark.createDataFrame([("a", 0)], "k string, v int")
    rows = [("a", v, 1) for v in range(5)]
    got = {ingest.upserted(stored, spark.createDataFrame(r, "k string, v int, seq int").repartition(3), ["k"], {}, "seq").first().v for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(got) == 1


def test_a_report_is_written(spark, tmp_path):
    audit = audits.board_audit(catalog.plain_jobs(spark, "/root/testdata/sf0.001").where("external_id < 200"), places.gazetteer(spark)).persist()
    audits.write_report(audit, str(tmp_path))
    read = lambda name: [x for p in sorted((tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()]
    counts = json.loads(read("counts")[0])
    assert counts["scanned"] == audit.count() and f"scanned: {counts['scanned']}" in read("text")
    assert read("markdown")[:2] == ["| count | rows |", "| --- | --- |"] and {json.loads(x)["kind"] for x in read("samples")} <= set(audits.SAMPLES)


def test_backfills_change_what_differs_only(spark):
    rows = spark.createDataFrame([("1", "Москва", "Москва"), ("2", "Lyon", None), ("3", "Lyon", "Л`ион")], "id string, location string, location_raw string")
    changes = ingest.romanized_backfill(rows)
    assert {tuple(r) for r in changes.collect()} == {("1", "Moskva", "Moskva"), ("3", "Lyon", "Lion")}
    assert {tuple(r) for r in ingest.updated(rows, changes, ["location", "location_raw"]).collect()} == {("1", "Moskva", "Moskva"), ("2", "Lyon", None), ("3", "Lyon", "Lion")}
