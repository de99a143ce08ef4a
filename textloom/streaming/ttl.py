"""TTL state over ordered events: replay protection, as a fold in batch and state in streams.

The window is anchored at a key's first event, so it is no tumbling window. ``replay_stream`` keeps one
timestamp a key in the state store; the batch form folds a key's ordered events between pauses of the window's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accept_once(times: list[float], last: float | None, ttl: float) -> tuple[list[bool], float | None]:
    """Which of the ordered times are accepted: a time is a replay within ``ttl`` seconds of the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= ttl
        out.append(ok)
        last = t if ok else last
    return out, last


def spans(rows: DataFrame, gap: float) -> DataFrame:
    """Adds ``span``: a key's events (k, t, event_id) in order, cut wherever ``gap`` seconds or more lie between two, since no
    state of that life crosses there. A busy key so becomes as many parts as it has pauses."""
    order = Window.partitionBy("k").orderBy("t", "event_id")
    pause = rows.withColumn("_before", F.lag("t").over(order))
    return pause.withColumn("span", F.sum(F.coalesce((F.col("t") - F.col("_before") >= gap).cast("int"), F.lit(0))).over(order)).drop("_before")


def replay_batch(events: DataFrame, key: str, ttl: float) -> DataFrame:
    """(event_id, accepted): the exact TTL rule on a bounded table; parts of a key between pauses of ``ttl`` go in parallel."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = None, None  # rows are sorted: the part at hand is all the state
        for pdf in batches:
            keep = []
            for p, t in zip(zip(pdf["k"], pdf["span"]), pdf["t"]):
                ok = p != part or t - last >= ttl
                part, last = p, t if ok else last
                keep.append(ok)
            yield pd.DataFrame({"event_id": pdf["event_id"], "accepted": keep})

    rows = events.select(F.col(key).cast("string").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")
    return spans(rows, ttl).repartition("k", "span").sortWithinPartitions("k", "span", "t", "event_id").mapInPandas(fold, "event_id long, accepted boolean")


def replay_stream(spark: SparkSession, path: str, schema, key: str, ttl: float) -> DataFrame:
    """The same rule on a stream of files: (event_id, accepted)."""

    def step(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        ok, last = accept_once(pdf["t"].tolist(), last, ttl)
        state.update((last,))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "accepted": ok})

    rows = spark.readStream.schema(schema).parquet(path).select(F.col(key).cast("string").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")
    return rows.groupBy("k").applyInPandasWithState(step, "event_id long, accepted boolean", "last double", "append", GroupStateTimeout.NoTimeout)
