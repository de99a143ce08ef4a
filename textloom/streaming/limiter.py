"""Login limiter over ordered attempts: a counting window anchored at the first failure, then a lock; in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures counted, end of the counting window, end of the lock.
State = tuple[int, float, float]
FRESH: State = (0, 0.0, 0.0)


def decide(state: State, t: float, bad: bool, window: float, most: int, lock: float) -> tuple[str, State]:
    """The decision on one attempt, and the state after it."""
    count, until, locked = state
    if t != t or t < locked:
        return "rejected", state
    if not bad:
        return "success", FRESH
    if count == 0 or t >= until:
        count, until = 0, t + window
    if count + 1 >= most:
        return "locked", (0, until, t + lock)
    return "failure", (count + 1, until, locked)


def _attempts(attempts: DataFrame, key: str, failed: Column) -> DataFrame:
    return attempts.select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id", F.coalesce(failed, F.lit(True)).alias("failed"),
    )


def limit_attempts(attempts: DataFrame, key: str, failed: Column, window: float = 300.0, most: int = 5, lock: float = 900.0) -> DataFrame:
    """(event_id, decision) of each attempt: ``rejected`` while the key is locked, else ``failure``, ``locked`` or ``success``.

    The ``most``-th failure within ``window`` seconds of the first locks the key for ``lock`` seconds and resets its count; a
    success resets both. Order is (ts, event_id). Null keys are one key; an attempt without a time is dropped from the order
    and decided as ``rejected``; a null ``failed`` is a failure.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, FRESH
        for pdf in batches:
            out = []
            for k, t, bad in zip(pdf["k"], pdf["t"], pdf["failed"]):
                if k != name:
                    name, state = k, FRESH
                decision, state = decide(state, t, bad, window, most, lock)
                out.append(decision)
            yield pd.DataFrame({"event_id": pdf["event_id"], "decision": out})

    # one key's attempts pass through a task in order; the state is three numbers, whatever the key's size
    return _attempts(attempts, key, failed).repartition("k").sortWithinPartitions("k", "t", "event_id").mapInPandas(fold, "event_id long, decision string")


def limit_stream(attempts: DataFrame, key: str, failed: Column, window: float = 300.0, most: int = 5, lock: float = 900.0) -> DataFrame:
    """The same rule on a streaming frame: attempts of a trigger in (ts, event_id) order, triggers as they come."""

    def step(_, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else FRESH
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"], na_position="first")
        out = []
        for t, bad in zip(pdf["t"], pdf["failed"]):
            decision, state = decide(state, t, bad, window, most, lock)
            out.append(decision)
        held.update(state)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "decision": out})

    return _attempts(attempts, key, failed).groupBy("k").applyInPandasWithState(step, "event_id long, decision string", "count int, until double, locked double", "append", GroupStateTimeout.NoTimeout)
