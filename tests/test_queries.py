import pytest

from tests.compare import connect, same
from textloom import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunk_packing_brute_force(spark):
    def pack(sizes, most=6000, tail=1500):
        done, cur, size = [], 0, 0
        for x in sizes:
            if x > most and cur == 0:
                done.append((1, x))
            elif cur and size + x > most:
                done.append((cur, size))
                cur, size = 1, x
            else:
                cur, size = cur + 1, size + x
        if cur:
            if size < tail and done:
                done[-1] = (done[-1][0] + cur, done[-1][1] + size)
            else:
                done.append((cur, size))
        return done

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {}
    for r in QUERIES["w8_chunk_packing"](spark, SF).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.paragraphs, r.chars))
    assert got == {r.doc_id: pack([len(x) for x in r.text.split("\n")]) for r in docs}


def test_replay_batch_and_stream_agree(spark, tmp_path):
    from textloom.streaming import ttl

    ev = spark.read.parquet(f"{SF}/events.parquet")
    last, want = {}, {}
    for r in sorted(ev.collect(), key=lambda r: (r.ts, r.event_id)):
        ok = r.event_type not in last or (r.ts - last[r.event_type]).total_seconds() >= 300
        want[r.event_id] = ok
        if ok:
            last[r.event_type] = r.ts
    assert {r.event_id: r.accepted for r in ttl.replay_batch(ev, "event_type", 300.0).collect()} == want
    ev.write.parquet(str(tmp_path / "in"))
    q = ttl.replay_stream(spark, str(tmp_path / "in"), ev.schema, "event_type", 300.0)
    q.writeStream.format("memory").queryName("replays").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.table("replays").collect()} == want
