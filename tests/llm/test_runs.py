import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """Runs (start, length, period), lag by lag."""
    n, out = len(words), {}
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([number[x] for x in words], np.int64)
    for q in range(1, n // 2 + 1):
        same = np.flatnonzero(np.diff(np.concatenate(([0], (w[q:] == w[:-q]).astype(np.int8), [0]))))
        for a, b in zip(same[0::2].tolist(), same[1::2].tolist()):
            if b + q - a >= max(12, 2 * q):
                out.setdefault((a, b + q - a), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def changed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = changed(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def query(spark, folder):
    return sorted(map(tuple, runs.op12(spark, str(folder)).collect()), key=repr)


def test_query_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((expected(*r) for r in rows), key=repr)
    assert query(spark, SF) == want
    assert sum(r[1] for r in want) > 0


def test_odd_rows(spark, tmp_path):
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    # 100, 105 and 115 are of the documents that the query changes
    texts = [None, "", " \n", "w", "x " * 11, "x " * 12, "x " * 50_000, " ".join(fib[-1]), " ".join(fib[-1] * 2), "a b " * 9 + "a", "ab ab\tab\vab é é é é é é é é é é é é é", "q w e r t y " * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x " * 20), (100, "one two three four " * 30), (115, "p"), (3, "w"), (3, "w")]
    spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, start string, __pr_runs int").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    # the text of 50,000 equal words has one run, which its own brute force would take long to say
    want = [expected(*r) for r in rows if r[0] != 6]
    got = query(spark, tmp_path)
    assert [r for r in got if r[0] != 6] == sorted(want, key=repr)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 50_000, 1, 50_000_000)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert query(spark, tmp_path / "none") == []


def test_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c " * 5 + "end", 4, "k"), (1, None, None, None)], "doc_id long, text string, __pr_runs int, __PR_KEPT string")
    out, (words, found, kept) = runs.mark_runs(df)
    assert out.columns[:4] == df.columns and len({c.lower() for c in out.columns}) == 7
    got = out.select("doc_id", words, F.to_json(found), kept, "__pr_runs").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, "[]", "", None), (1, 16, '[{"start":0,"length":15,"period":3}]', "a b c end", 4)]


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    """Texts of few words, of repeated blocks, of touching periodic stretches, and Fibonacci words, several in a batch."""
    rng = np.random.default_rng(seed)
    fib = ([0], [0, 1])
    while len(fib[1]) < 200:
        fib = (fib[1], fib[1] + fib[0])
    for _ in range(60):
        docs = []
        for _ in range(rng.integers(1, 4)):
            kind, w = rng.integers(0, 5), []
            if kind == 0:
                w = rng.integers(0, 2, rng.integers(0, 150)).tolist()
            elif kind == 1:
                w = (rng.integers(0, 3, rng.integers(1, 40)).tolist() * 20)[: rng.integers(1, 250)]
            elif kind == 2:
                for _ in range(6):
                    w += ([0] * rng.integers(1, 40) + [1] * rng.integers(0, 3)) * rng.integers(1, 4)
            elif kind == 3:
                p = rng.integers(1, 4)
                for _ in range(5):
                    w += (list(range(p)) * 60)[rng.integers(0, p) : rng.integers(10, 80)]
            else:
                w = fib[1][rng.integers(0, 30) :] * rng.integers(1, 3)
            docs.append(w)
        first = np.cumsum([0, *map(len, docs)]).tolist()
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        got = runs.find_runs(np.array(sum(docs, []), np.int64), row)
        want = sorted((first[i] + s, first[i] + s + n, q) for i, d in enumerate(docs) for s, n, q in brute(d))
        assert sorted(map(tuple, got.tolist())) == want
