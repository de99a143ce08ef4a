"""The parts of request chains grow with the requests."""

import random

from textloom.operators import chains


def test_parts_grow_with_requests(spark, monkeypatch):
    """there were as many parts as shuffle partitions, so a task sorted ever more requests."""
    rng = random.Random(3)
    held = spark.createDataFrame([(i, "a", "0") for i in range(8)], "id long, status string, attempt string")
    rows = [(rng.choice([0, 0, 0, *range(1, 10)]), k, rng.choice("ab"), "0", rng.choice("ab"), "0") for k in range(300)]
    asked = spark.createDataFrame(rows, "id long, seq long, expected string, attempt string, new string, new_attempt string")
    want = sorted(map(tuple, chains.request_chains(held, asked, 1).collect()), key=repr)
    monkeypatch.setattr(chains, "PART_ROWS", 10)
    got = chains.request_chains(held, asked)
    assert got.rdd.getNumPartitions() == 30 and sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 300
