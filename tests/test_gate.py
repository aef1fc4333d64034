"""Timeouts that close a provider, in batch and as a stream, against a plain simulation."""

import random

import pytest

from vacantia.operators import ingest
from vacantia.streaming import gate
from vacantia.streaming.state import Breaker

FETCH = "provider string, at_ms long, fetch_id long, done_ms long, code string"
BREAKER = Breaker(window=1000, threshold=3, cooldown=4000)


def fetches(n=900):
    rng = random.Random(8)
    out = []
    for k in range(n):
        at = rng.randrange(60_000)
        out.append((rng.choice(("ashby", "lever")), at, k, at + rng.randrange(900), rng.choice(("ETIMEDOUT", "ECONNABORTED", "ECONNRESET", None, None, None))))
    return [*out, ("ashby", 5, n, None, "ETIMEDOUT"), ("workable", 1, n + 1, 2, None)]


def simulated(rows):
    """All moments in order, one at a time; outcomes come before questions of the same moment."""
    sent = {}
    for provider in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == provider), key=lambda r: (r[1], r[2]))
        until, recent, coming = 0, [], []
        for _, at, k, done, code in own:
            for t in sorted(x for x in coming if x <= at):
                recent = [x for x in recent if t - x < 1000] + [t]
                if len(recent) >= 3 and until < t:
                    until = t + 4000
            coming = [x for x in coming if x > at]
            sent[k] = until <= at
            if sent[k] and code in ("ETIMEDOUT", "ECONNABORTED"):
                coming.append(at if done is None else done)
    return sent


def test_batch(spark):
    rows = fetches()
    want = simulated(rows)
    got = {r.fetch_id: r.sent for r in gate.gated(spark.createDataFrame(rows, FETCH), BREAKER).collect()}
    assert got == want and 50 < sum(want.values()) < len(want) - 50
    assert gate.gated(spark.createDataFrame([], FETCH), BREAKER).count() == 0


def test_stream_equals_batch_whatever_the_batches(spark, tmp_path):
    """Answers in four micro-batches, of which the third fails once and is run again."""
    rows = sorted(fetches(), key=lambda r: r[1])
    want = simulated(rows)
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, FETCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        gate.gated_stream(stream, BREAKER)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gate.ROCKS)
    failed = []

    def put(batch, number):
        if number == 2 and not failed:
            failed.append(number)
            batch.count()
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/{number}"))

    def run():
        writer = gate.gated_stream(stream, BREAKER).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()

    try:
        with pytest.raises(Exception, match="lost"):
            run()
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.fetch_id: r.sent for k in range(4) for r in spark.read.parquet(str(tmp_path / f"out/{k}")).collect()}
    assert got == want


def test_open_circuits_hold_back_a_poll(spark):
    """Three timeouts within the window close one provider to the next poll; other errors and refused fetches don't."""
    rows = [("ashby", 100 * k, k, 100 * k + 50, "ETIMEDOUT") for k in range(3)] + [("lever", 100 * k, 10 + k, 100 * k + 50, "ECONNRESET") for k in range(9)]
    sources = spark.createDataFrame([(p, p, p, "x", True) for p in ingest.PROVIDERS], "id string, provider string, external_id string, name string, is_active boolean")
    for at, held_back in ((200, set()), (300, {"ashby"}), (4249, {"ashby"}), (4250, set())):
        circuits = gate.open_circuits(spark.createDataFrame(rows, FETCH), BREAKER, at)
        assert {r.provider for r in ingest.poll_messages(sources, circuits).collect()} == set(ingest.PROVIDERS) - held_back
