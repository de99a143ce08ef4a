"""One-time codes and claims with a life of seconds, on streams: state that event-time timers free again.

A code is issued once and consumed once while it lives; a claim (replay protection) is an issue without a consumer. The state of
a code is the time of its issue. A timer at the end of its life removes it as soon as the watermark has passed, so the state
store holds what may still live, not every code that ever was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECIDED = "event_id long, op string, accepted boolean"
#: The state store that timers and expiry need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide(issued: float | None, op: str, t: float, ttl: float) -> tuple[bool, float | None]:
    """Whether a code's event is accepted, and the time of its issue after it (None: no living code)."""
    live = issued is not None and t - issued < ttl
    if op == "issue":
        return not live, issued if live else t
    return live, None


class Codes(StatefulProcessor):
    """Decides a code's events of a trigger in order of time; holds one number while the code lives."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issued = handle.getValueState("issued", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # all events of one code in one trigger: codes are used a few times
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        before = issued = self.issued.get()[0] if self.issued.exists() else None
        accepted = []
        for op, t in zip(pdf["op"], pdf["t"]):
            ok, issued = decide(issued, op, t, self.ttl)
            accepted.append(ok)
        if issued is None:
            self.issued.clear()
        elif issued != before:
            self.issued.update((issued,))
            self.handle.registerTimer(int((issued + self.ttl) * 1000))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "op": pdf["op"].to_numpy(), "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a code may have been consumed and issued anew since the timer was set
        if self.issued.exists() and (self.issued.get()[0] + self.ttl) * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.issued.clear()
        yield from ()

    def close(self) -> None:
        pass


def code_stream(events: DataFrame, ttl: float, delay: str = "0 seconds") -> DataFrame:
    """(event_id, op, accepted) of a stream of ``events`` (code, op, ts, event_id), op being ``issue`` or ``consume``.

    Events later than ``delay`` behind the newest of earlier triggers are dropped. The session's state store must be ``STORE``."""
    rows = events.select("code", "op", "ts", "event_id", (F.unix_micros("ts") / 1e6).alias("t")).withWatermark("ts", delay)
    return rows.groupBy("code").transformWithStateInPandas(statefulProcessor=Codes(ttl), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime")


def code_batch(events: DataFrame, ttl: float) -> DataFrame:
    """The same decisions on a table. Between two pauses of ``ttl`` a code's events go in order; pauses end every life, so a busy
    code is as many parts as it has pauses."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, issued = None, None
        for pdf in batches:
            accepted = []
            for p, op, t in zip(zip(pdf["code"], pdf["span"]), pdf["op"], pdf["t"]):
                part, issued = p, issued if p == part else None
                ok, issued = decide(issued, op, t, ttl)
                accepted.append(ok)
            yield pd.DataFrame({"event_id": pdf["event_id"], "op": pdf["op"], "accepted": accepted})

    rows = events.select("code", "op", "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    order = Window.partitionBy("code").orderBy("t", "event_id")
    pause = (F.col("t") - F.lag("t").over(order) >= ttl).cast("int")
    cut = rows.withColumn("pause", F.coalesce(pause, F.lit(0))).withColumn("span", F.sum("pause").over(order)).drop("pause")
    return cut.repartition("code", "span").sortWithinPartitions("code", "span", "t", "event_id").mapInPandas(fold, DECIDED)
