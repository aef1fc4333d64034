"""What is worked out for each row, and what only once for rows that are alike."""

import datetime as dt

from pyspark.sql import functions as F

from vacantia.functions import places
from vacantia.operators import ingest
from vacantia.operators.relation import Relation

T = dt.datetime(2024, 3, 1, 12)


def postings(spark):
    said = [
        ("Acme", "Acme Berlin", "Backend Engineer"),
        ("Other", "Acme Berlin", "Backend Engineer"),
        ("ACME", "Acme", "Data Engineer - Paris"),
        ("", " Berlin,", "QA"),
        (None, " Berlin,", "QA"),
        ("Xy", "Xy Berlin ,", "QA"),
        ("Zebra", "Berlin ,", None),
    ]
    rows = [("lever", str(k), title, company, raw, T, k % 2 == 0, "u") for k, (company, raw, title) in enumerate(said)]
    return spark.createDataFrame(rows, "provider string, external_id string, title string, company string, location_raw string, posted_at timestamp, is_flagged_remote boolean, url string")


def test_rows_meet_what_their_combination_gave(spark):
    made = ingest.classified(postings(spark), places.gazetteer(spark))
    # Rows only look for their employer's name; all other patterns ran over distinct combinations.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2
    got = {r.external_id: r for r in made.collect()}
    assert [got[str(k)].location_raw for k in range(7)] == ["Berlin", "Acme Berlin", "Unknown", "Berlin,", "Berlin,", "Xy Berlin ,", "Berlin"]
    assert [got[str(k)].location_countries for k in range(7)] == [["germany"]] * 2 + [[]] + [["germany"]] * 4
    assert got["2"].title == "Data Engineer - Paris" and got["6"].title == ""
    assert made.columns[-10:] == ["location", "location_tokens", "location_countries", "location_regions", "is_remote", "role", "seniorities", "stack", "id", "hash"]


def test_an_employer_is_known_only_where_a_location_holds_it(spark):
    rows = spark.createDataFrame([("Acme  Inc Berlin", "acme inc"), ("Berlin", "Acme"), ("Berlin", " "), ("Xy Berlin", "Xy"), ("xy", "Xy"), ("Berlin", None)], "raw string, company string")
    got = [r.e for r in rows.select(places.employer_in(F.col("raw"), F.col("company")).alias("e")).collect()]
    assert got == ["acme inc", None, "", "", "Xy", ""]


def snapshot(spark, keep):
    rows = [(f"lever:{k}", "lever", f"c{k % 3}", f"h{k}", T) for k in range(30) if keep(k)]
    return spark.createDataFrame(rows, "id string, provider string, company string, hash string, posted_at timestamp")


def test_a_landed_snapshot_is_made_once(spark, tmp_path):
    jobs = snapshot(spark, lambda k: k % 4)
    held = Relation(spark, str(tmp_path / "jobs"), jobs.schema)
    held.commit(0, jobs, None)
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda id: made.add(1) or True, "boolean").asNondeterministic()
    landed = snapshot(spark, lambda k: k % 3 == 0 and k % 5)
    assert held.poll(1, landed.select("provider", "company").distinct(), landed.where(seen("id")))
    assert made.value == landed.count()
    assert {r.id for r in held.read().collect()} == {f"lever:{k}" for k in range(30) if (k % 5 if k % 3 == 0 else k % 4)}
    assert not [p for p in (tmp_path / "jobs").iterdir() if p.name == "landed"]


def test_a_polls_outcome_is_not_worked_out_where_it_is_read(spark):
    jobs, fetched = snapshot(spark, lambda k: k % 4), snapshot(spark, lambda k: k % 3 == 0 and k % 5)
    sources = spark.createDataFrame([("s0", "lever", "c0", "idle", None)], "id string, provider string, name string, sync_status string, last_synced_at timestamp")
    after, _ = ingest.polled(jobs, sources, spark.createDataFrame([("s0", True)], "source_id string, ok boolean"), fetched, F.lit("2024-02-01").cast("timestamp"))
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    # Spark may put the one join with what is gone on either side of the union.
    assert "Window" not in plan and plan.count("Join") <= 2
    assert {r.id for r in after.collect()} == {f"lever:{k}" for k in range(30) if (k % 5 if k % 3 == 0 else k % 4)}
