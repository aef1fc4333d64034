"""Timeouts that close a provider: a circuit breaker whose state decides which fetches of the next polls are sent.

A fetch is asked for at some time, and its outcome comes later. Fetches of a provider whose circuit is open are not sent, so
they have no outcome; timeouts of those that were sent are recorded when they come, and may open the circuit. Other errors
mark the source, but don't count.

In batch a table of fetches with their outcomes is replayed, each provider in order of time; in a stream the same machine
keeps its state in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vacantia.streaming.state import Breaker

# The error codes of a request that took too long.
TIMEOUTS = ("ECONNABORTED", "ETIMEDOUT")

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed_out(code: Column) -> Column:
    return F.coalesce(code.isin(*TIMEOUTS), F.lit(False))


class Gate:
    """A breaker with the outcomes that are still to come."""

    def __init__(self, breaker: Breaker, recent: list[int] | None = None, until: int = 0, pending: list[int] | None = None):
        self.breaker, self.state, self.pending = breaker, (list(recent or []), until), sorted(pending or [])

    def settle(self, now: int) -> None:
        """Record the timeouts that have come by now."""
        while self.pending and self.pending[0] <= now:
            self.state, _ = self.breaker.step(self.state, heappop(self.pending))

    def ask(self, now: int, done: int, slow: bool) -> tuple[bool, int]:
        """Whether a fetch is sent now, and until when the circuit is open; `slow` fetches time out at `done`."""
        self.settle(now)
        sent = self.state[1] <= now
        if sent and slow:
            heappush(self.pending, max(done, now))
        return sent, self.state[1]


RESULT = "provider string, at_ms long, fetch_id long, sent boolean, open_until long"


def _asked(fetches: DataFrame) -> DataFrame:
    """The columns that the gate needs; rows without a provider or a time are left out."""
    done = F.coalesce("done_ms", "at_ms").cast("long")
    rows = fetches.where("provider IS NOT NULL AND at_ms IS NOT NULL")
    return rows.select(F.col("provider").cast("string"), F.col("at_ms").cast("long"), F.col("fetch_id").cast("long"), done.alias("done_ms"), timed_out(F.col("code")).alias("slow"))


def gated(fetches: DataFrame, breaker: Breaker) -> DataFrame:
    """provider, at_ms, fetch_id, sent and open_until of each of `fetches` (provider, at_ms, fetch_id, done_ms, code).

    A provider's fetches are replayed in order of time and id, in sorted batches, so that memory holds the breaker's window
    and what is on its way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, gate = None, Gate(breaker)
        for batch in batches:
            out = []
            for provider, now, done, slow in zip(batch["provider"], batch["at_ms"], batch["done_ms"], batch["slow"], strict=True):
                if provider != last:
                    last, gate = provider, Gate(breaker)
                out.append(gate.ask(now, done, slow))
            sent, until = zip(*out, strict=True) if out else ((), ())
            yield batch[["provider", "at_ms", "fetch_id"]].assign(sent=list(sent), open_until=list(until)).astype({"sent": bool, "open_until": "int64"})

    rows = _asked(fetches)
    return rows.repartition("provider").sortWithinPartitions("provider", "at_ms", "fetch_id").mapInPandas(run, RESULT)


class GateProcessor(StatefulProcessor):
    """The gate of one provider in a stream: recent and pending timeouts as lists, and the end of the open time."""

    def __init__(self, breaker: Breaker, idle_ms: int | None):
        self.breaker, self.idle_ms = breaker, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long", self.idle_ms)
        self.pending = handle.getListState("pending", "at long", self.idle_ms)
        self.until = handle.getValueState("until", "at long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = lambda state: [x[0] for x in state.get()] if state.exists() else []
        gate = Gate(self.breaker, times(self.recent), self.until.get()[0] if self.until.exists() else 0, times(self.pending))
        batch = pd.concat(list(rows)).sort_values(["at_ms", "fetch_id"], ignore_index=True)
        out = [gate.ask(int(a), int(d), bool(s)) for a, d, s in zip(batch["at_ms"], batch["done_ms"], batch["slow"], strict=True)]
        for state, held in ((self.recent, gate.state[0]), (self.pending, gate.pending)):
            state.clear()
            if held:
                state.put([(int(t),) for t in held])
        self.until.update((int(gate.state[1]),))
        yield batch[["provider", "at_ms", "fetch_id"]].assign(sent=[s for s, _ in out], open_until=[u for _, u in out])

    def close(self) -> None:
        pass


def gated_stream(fetches: DataFrame, breaker: Breaker, idle_ms: int | None = None) -> DataFrame:
    """The same decisions over a stream of fetches; those of a micro-batch are taken in order of time.

    With `idle_ms` the state of a provider that asks for nothing so long is forgotten; it should be longer than the window,
    the cooldown and any fetch. The session's state store must be RocksDB's.
    """
    spark = fetches.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return _asked(fetches).groupBy("provider").transformWithStateInPandas(GateProcessor(breaker, idle_ms), RESULT, "Append", mode)


def open_circuits(fetches: DataFrame, breaker: Breaker, at_ms: int) -> DataFrame:
    """provider and open_until of the circuits that are open at a time, as the fetches and outcomes before it leave them."""
    past = fetches.where(F.col("at_ms") <= at_ms).select("provider", "at_ms", "fetch_id", "done_ms", "code")
    # A last question to each provider, which counts for nothing, finds what is open.
    probe = past.select("provider").distinct().select("provider", F.lit(at_ms).cast("long"), F.lit((1 << 63) - 1), F.lit(at_ms).cast("long"), F.lit(None).cast("string"))
    asked = gated(past.select("provider", F.col("at_ms").cast("long"), F.col("fetch_id").cast("long"), F.col("done_ms").cast("long"), F.col("code").cast("string")).union(probe), breaker)
    return asked.where(F.col("fetch_id") == (1 << 63) - 1).where("NOT sent").select("provider", "open_until")
