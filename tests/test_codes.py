import random

from pyspark.sql import functions as F

from textloom.streaming import codes

SCHEMA = "code string, op string, ts timestamp, event_id long"


def events(spark, rows):
    return spark.createDataFrame(rows, "code string, op string, t double, event_id long").select("code", "op", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "event_id")


def expected(rows, ttl):
    live, want = {}, {}
    for code, op, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        ok = code in live and t - live[code] < ttl
        if op == "issue":
            want[i] = not ok
            if not ok:
                live[code] = t
        else:
            want[i] = ok
            live.pop(code, None)
    return want


def test_codes_batch_and_stream_agree(spark, tmp_path):
    """Three triggers of events in order; codes of earlier triggers leave the state store once their life is over."""
    rng = random.Random(1)
    spark.conf.set(*codes.STORE)
    rows, i = [], 0
    for trigger in range(4):
        for _ in range(80):
            rows.append((f"c{trigger}{rng.randint(0, 12)}", rng.choice(["issue", "consume"]), trigger * 1000.0 + rng.randint(1, 200), i))
            i += 1
    rows += [("again", op, t, i + k) for k, (op, t) in enumerate([("issue", 10.0), ("issue", 60.0), ("issue", 80.0), ("consume", 100.0), ("consume", 101.0), ("issue", 3100.0)])]
    want = expected(rows, 60.0)
    assert {r.event_id: r.accepted for r in codes.code_batch(events(spark, rows), 60.0).collect()} == want
    for trigger in range(4):
        own = [r for r in rows if trigger * 1000 <= r[2] < trigger * 1000 + 1000]
        events(spark, own).coalesce(1).write.parquet(str(tmp_path / "in" / f"{trigger}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = codes.code_stream(stream, 60.0).writeStream.format("memory").queryName("codes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    assert {r.event_id: r.accepted for r in spark.table("codes").collect()} == want
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    issued = len({r[0] for r in rows})
    # the store never holds what all triggers issued: each trigger's codes go when the next one's watermark has passed
    assert max(held) < issued and held[-1] <= max(held)
