"""Relations that grow by batches, against a dictionary."""

import random
from pathlib import Path

import pytest
from pyspark.sql.types import StructType

from vacantia.operators.relation import Relation

SCHEMA = "id string, hash string, provider string, company string, n int"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, company="A", provider="ashby", n=0):
    return (f"{provider}:{i}", f"h{i}{provider}", provider, company, n)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "data").rglob("part-*")}


@pytest.fixture
def relation(spark, tmp_path):
    return Relation(spark, str(tmp_path / "r"), StructType.fromDDL(SCHEMA), buckets=4, order=("n", "id"))


def test_polls_against_a_dictionary(spark, relation):
    """Snapshots of random companies, replays, compaction and expiry; also odd names of providers and companies."""
    rng = random.Random(3)
    places = [(p, c) for p in ("ashby", "a b/c=%", "") for c in ("A", "B", None)]
    held = {}
    for version in range(1, 7):
        answered = rng.sample(places, rng.randint(1, 4))
        fetched = [row(f"{c}{rng.randrange(12)}", c, p, version) for p, c in answered for _ in range(rng.randint(0, 8))]
        args = (spark.createDataFrame(answered, "provider string, company string"), rows_of(spark, fetched))
        assert relation.poll(version, *args) and not relation.poll(version, *args) and not relation.poll(version - 1, *args)
        ids = {r[0] for r in fetched}
        # Null companies are no scope that an equi-join could meet.
        held = {i: r for i, r in held.items() if i in ids or (r[2], r[3]) not in answered or r[3] is None}
        for r in fetched:
            held.setdefault(r[0], r)
        if version % 3 == 0:
            assert relation.compact(2) > 0
            relation.expire(1)
            assert len(relation.manifests()) == 1
        assert sorted(r.id for r in relation.read().collect()) == sorted(held)
        assert {r.id: r.n for r in relation.read().collect()} == {i: r[4] for i, r in held.items()}


def test_a_poll_writes_its_own_source_only(spark, relation):
    many = [row(f"{c}-{i}", f"C{c}") for c in range(12) for i in range(200)]
    relation.commit(1, rows_of(spark, many), None)
    before = files(relation.path)
    scope = spark.createDataFrame([("ashby", "C3")], "provider string, company string")
    relation.poll(2, scope, rows_of(spark, [row(f"3-{i}", "C3") for i in range(1, 202)]))
    after = files(relation.path)
    assert before.items() <= after.items()  # nothing is rewritten
    new = [spark.read.parquet(p) for p in set(after) - set(before)]
    assert sum(x.count() for x in new) == 3  # two rows came, one id went
    assert relation.read().where("company = 'C3'").count() == 201 and relation.read().count() == 2401
    parts = relation.parts_of(scope)
    assert {r.company for r in relation.read(parts).select("company").distinct().collect()} >= {"C3"} and relation.read(parts).count() < 2401


def test_an_update_and_older_versions(spark, relation):
    relation.commit(1, rows_of(spark, [row(1), row(2, "B")]), None)
    changes = spark.createDataFrame([("ashby:2", 7), ("ashby:9", 7)], "id string, new_n int")
    assert relation.update(2, changes, ["n"]) and not relation.update(2, changes, ["n"])
    relation.commit(3, None, rows_of(spark, [row(1)]).select("id", "provider", "company"))
    relation.commit(4, rows_of(spark, [row(1, n=4)]), None)
    read = lambda below: {r.id: r.n for r in relation.read(below=below).collect()}
    assert [read(v) for v in (1, 2, 3, 4, None)] == [{}, {"ashby:1": 0, "ashby:2": 0}, {"ashby:1": 0, "ashby:2": 7}, {"ashby:2": 7}, {"ashby:1": 4, "ashby:2": 7}]
    relation.compact(1)
    assert read(None) == {"ashby:1": 4, "ashby:2": 7} and read(2) == {"ashby:1": 0, "ashby:2": 0}
    # Of six manifests' folders, those of the last two stay.
    assert relation.expire(2) == 0 and relation.expire(1) > 0 and read(None) == {"ashby:1": 4, "ashby:2": 7}


def test_a_write_that_stopped_is_no_version(spark, relation):
    relation.commit(1, rows_of(spark, [row(1)]), None)
    relation._write(rows_of(spark, [row(2)]), "put", 2)  # and no manifest
    assert relation.version() == 1 and relation.read().count() == 1
    assert relation.commit(2, rows_of(spark, [row(3)]), None) and relation.read().count() == 2
    assert relation.expire() == 1 and relation.read().count() == 2
