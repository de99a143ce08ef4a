"""Overlaps of n-gram sets by matrix products: equal to brute force and to the prefix filter, whatever the sizes of blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions.points import code_points, gram_sets, row_slices
from textloom.operators import core, overlap


def _sides(seed, n, m):
    rng = random.Random(seed)
    words = ["abc", "abd", "bcd", "xyz", "xy", "é", "违约😀", "ωΣ"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    return [(i, text(), f"s{i % 3}") for i in range(n)], [(i, text(), f"s{i % 2}") for i in range(m)]


@pytest.mark.parametrize("size", [2, 3])
def test_gram_sets_brute_force(size):
    rng = random.Random(size)
    for alphabet in ("ab c", "aé😀违", [chr(c) for c in range(32, 0xD000, 7)]):
        for _ in range(40):
            rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(2, 9))]
            apart = rng.choice([None, alphabet[0]])
            row, code = gram_sets(pa.array(rows, pa.string()).slice(1), size, apart)
            number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
            assert sorted(zip(row.tolist(), code.tolist())) == sorted({(i, number(p[k : k + size])) for i, p in enumerate(rows[1:]) for k in range(len(p) - size + 1) if apart not in set(p[k : k + size])})


def test_padded_words():
    assert overlap._padded(pa.array(["a bc", "", "é"])).to_pylist() == ["  a \n  bc ", "", "  é "]


def test_code_points_of_text_that_is_not_utf8():
    points, at = code_points(pa.array([b"ab\xffc", None, b"\xc3\xa9"], pa.binary()))
    assert points.tolist() == [97, 98, 0xFFFD, 99, 233] and at.tolist() == [0, 4, 4, 5]


def test_small_memory_makes_no_rows_of_ngrams(spark, monkeypatch):
    """against a small side, no text was met without exploding every text's n-grams and joining them with their counts."""
    ls, rs = _sides(5, 90, 70)
    left, right = spark.createDataFrame(ls, "lid long, ltext string, scope string"), spark.createDataFrame(rs, "rid long, rtext string, scope string")
    runs = lambda: (sorted(map(tuple, core.trigram_top(left, right, 4, 0.3).collect())), sorted((r.lid, r.rid, r.similarity) for r in core.fuzzy_join(left, right, 0.6).collect()))
    monkeypatch.setattr(overlap, "DENSE", -1)
    by_prefix = runs()
    monkeypatch.undo()
    calls = []
    monkeypatch.setattr(core, "set_pairs", lambda *a: calls.append(a))
    assert runs() == by_prefix and not calls and all(by_prefix)
    for name, value in (("BLOCK", 8), ("BUCKET", 20), ("ROWS", 3), ("WIDTH", 5), ("CHARS", 30)):
        monkeypatch.setattr(overlap, name, value)  # BLOCK and BUCKET count here, the others in the tasks' own process
    assert runs() == by_prefix


def test_products_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.random((7, 40)) < 0.3, rng.random((5, 40)) < 0.3
    monkeypatch.setattr(overlap, "WIDTH", 6)
    codes = lambda m: tuple(a.astype(np.uint64) if k else a for k, a in enumerate(np.nonzero(m)))
    assert (overlap._common(codes(x), 7, codes(y), 5) == x.astype(int) @ y.T.astype(int)).all()
    texts = pa.array(["ab" * k for k in (0, 3, 1, 0, 50, 2)])
    cuts = row_slices(texts, 1024, 8)
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == 6 and (4, 5) in cuts


def test_long_text_meets_memory(spark):
    left = spark.createDataFrame([(1, "ab" * 40000 + "違約"), (2, "ab違約")], "lid long, ltext string")
    got = core.fuzzy_join(left, spark.createDataFrame([(7, "ab違約"), (8, "")], "rid long, rtext string"), 0.5).orderBy("lid")
    assert [(r.lid, r.rid, r.similarity) for r in got.select("lid", "rid", F.round("similarity", 6).alias("similarity")).collect()] == [(1, 7, 0.857143), (2, 7, 1.0)]
