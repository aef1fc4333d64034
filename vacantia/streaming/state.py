"""Keyed state over event streams: a circuit breaker and a request limiter.

Each is a small machine that folds one key's events in order. In batch, keys are grouped and folded in sorted batches,
so that a key of any length passes through in bounded memory; in a stream, the machine's state lives in Spark's state
store. Both give the same decisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Breaker:
    """Opens for `cooldown` ms when `threshold` events fall within `window` ms, unless it is still open."""

    def __init__(self, window: int = 60_000, threshold: int = 10, cooldown: int = 300_000):
        self.window, self.threshold, self.cooldown = window, threshold, cooldown

    def start(self) -> tuple[list[int], int]:
        return [], 0

    def step(self, state: tuple[list[int], int], now: int) -> tuple[tuple[list[int], int], tuple[bool, int]]:
        """The next state, and (opens now, open until)."""
        recent = [t for t in state[0] if now - t < self.window] + [now]
        opens = len(recent) >= self.threshold and state[1] < now
        until = now + self.cooldown if opens else state[1]
        # More than `threshold` recent events decide as `threshold` do.
        return (recent[-self.threshold :], until), (opens, until)

    columns = "opens boolean, open_until long"
    stored = "recent array<long>, until long"


class Limiter:
    """Counts hits in fixed windows of `ttl` ms from a first hit; over `limit`, blocks for `block` ms."""

    def __init__(self, limit: int = 60, ttl: int = 60_000, block: int = 60_000):
        self.limit, self.ttl, self.block = limit, ttl, block

    def start(self) -> tuple[int, int, int]:
        return 0, 0, 0

    def step(self, state: tuple[int, int, int], now: int) -> tuple[tuple[int, int, int], tuple[int, int, bool, int]]:
        """The next state (hits, window's end, block's end), and (hits, seconds to expire, blocked, seconds to the block's end)."""
        hits, ends, blocked = state
        up = lambda ms: -(-ms // 1000)
        if blocked > now:
            return state, (self.limit + 1, up(blocked - now), True, up(blocked - now))
        hits, ends = (hits + 1, ends) if ends > now else (1, now + self.ttl)
        left = max(1, up(ends - now))
        if hits > self.limit:
            return (hits, ends, now + self.block), (hits, left, True, max(1, up(self.block)))
        return (hits, ends, blocked), (hits, left, False, 0)

    columns = "total_hits long, time_to_expire long, is_blocked boolean, time_to_block_expire long"
    stored = "hits long, ends long, blocked long"


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def folded(events: DataFrame, machine: Breaker | Limiter, key: str, at_ms: str, order: str) -> DataFrame:
    """key, at_ms, order and the decision for each event, in order of time. Events without a key or time are left out."""
    rows = events.where(F.col(key).isNotNull() & F.col(at_ms).isNotNull()).select(F.col(key).alias("key"), F.col(at_ms).cast("long").alias("at_ms"), F.col(order).alias("order_id"))
    kind = dict(rows.dtypes)
    schema = f"key {kind['key']}, at_ms long, order_id {kind['order_id']}, {machine.columns}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, machine.start()
        for batch in batches:
            out = []
            for k, now in zip(batch["key"], batch["at_ms"], strict=True):
                if k != last:
                    last, state = k, machine.start()
                state, decision = machine.step(state, int(now))
                out.append(decision)
            yield pd.concat([batch, pd.DataFrame(out, columns=_names(machine.columns), index=batch.index)], axis=1)

    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "order_id").mapInPandas(run, schema)


def _stateful(machine: Breaker | Limiter, idle_ms: int | None) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        now_state = machine.start() if held is None else tuple(list(x) if hasattr(x, "__len__") else x for x in held)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "order_id"])
        out = []
        for at in rows["at_ms"]:
            now_state, decision = machine.step(now_state, int(at))
            out.append(decision)
        state.update(tuple(now_state))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.concat([rows[["key", "at_ms", "order_id"]].reset_index(drop=True), pd.DataFrame(out, columns=_names(machine.columns))], axis=1)

    return run


def streamed(events: DataFrame, machine: Breaker | Limiter, key: str, at_ms: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """The same decisions over a stream; a micro-batch's events of a key are taken in order of time.

    With `idle_ms`, a key that sends nothing for so long is forgotten, so that state holds no more keys than are active. It
    should be longer than any window or block, and than any delay of the stream. It is for queries that run on: Spark keeps
    waiting for timeouts, so that a query over what is available now would never end.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at_ms).isNotNull()).select(F.col(key).alias("key"), F.col(at_ms).cast("long").alias("at_ms"), F.col(order).alias("order_id"))
    kind = dict(rows.dtypes)
    schema = f"key {kind['key']}, at_ms long, order_id {kind['order_id']}, {machine.columns}"
    return rows.groupBy("key").applyInPandasWithState(_stateful(machine, idle_ms), schema, machine.stored, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def recent_counts(events: DataFrame, key: str, at_ms: str, window_ms: int = 60_000) -> DataFrame:
    """`events` with n_recent: how many of the key's events lie in the window that ends with each. Native, for batch."""
    span = Window.partitionBy(key).orderBy(at_ms).rangeBetween(-(window_ms - 1), 0)
    return events.withColumn("n_recent", F.count(F.lit(1)).over(span))
