import hashlib
import zlib

import numpy as np
import pytest

from textloom.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, __mx_x int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def path(level, i):
    """The runs of a node's ancestors with its slots in them, and the root."""
    out = []
    while len(level) > 1:
        a = i // 8 * 8
        out.append((level[a : a + 8], i - a))
        level, i = [digest(*level[b : b + 8]) for b in range(0, len(level), 8)], i // 8
    return out, level[0]


def brute(rows):
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [path([leaf(r) for r in trees[x]], 0)[1] for x in order]
    for k, x in enumerate(order):
        own = [leaf(r) for r in trees[x]]
        for i, r in enumerate(trees[x]):
            above, root = path(tops, k)
            steps = path(own, i)[0] + above
            low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            h = leaf((*r[:4], low)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own[i]
            for run, s in steps:
                h = digest(*run[:s], h, *run[s + 1 :])
            out.append((r[0], own[i], tops[k], root, digest(*(y for run, s in steps for j, y in enumerate(run) if j != s)), h, h == root))
    return sorted(out, key=repr)


def query(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "t", 7, 1) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, merkle.op11(spark, str(tmp_path)).collect()), key=repr)


def test_states_and_digests():
    children = [hashlib.sha256(bytes([i])).digest() for i in range(19)]
    got, states = merkle.parents(np.frombuffer(b"".join(children), np.uint8).reshape(-1, 32))
    assert [x.tobytes().hex() for x in got] == [digest(*(c.hex() for c in children[a : a + 8])) for a in (0, 8, 16)]
    # resuming before the third slot with another child gives the digest of the changed run
    new = hashlib.sha256(b"other").digest()
    right = [(slice(None), merkle.hexed(np.frombuffer(c, np.uint8)[None])) for c in children[3:8]]
    resumed = merkle._resume(merkle._states(states[:1, 2]), np.frombuffer(new, np.uint8)[None], right, np.array([8]))
    assert resumed[0].tobytes().hex() == digest(*(c.hex() for c in [*children[:2], new, *children[3:8]]))


@pytest.mark.parametrize("langs", (1, 3, 70))
def test_brute_force(spark, tmp_path, langs):
    rng = np.random.default_rng(langs)
    rows = [(int(d), f"s{d % 3}", None if d % langs == 1 else f"é{d % langs}", int(d), f"Text {d} É") for d in rng.permutation(300)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_two_rounds(spark, tmp_path):
    """More leaves than one task takes, most in one language."""
    rows = [(d, "s", "en" if d % 9 else "de", d, f"T{d}") for d in range(6000)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    long = "Word " * 200_000
    rows = [(1, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (2, "s", "en", 0, ""), (2, "s", "en", 0, ""), (3, "s", "", 5, long), (12, "", "fr", 1, "ABC"), (12, "", "fr", 1, "abc")]
    rows += [(7, "s", "xx", 1, "Same")] * 40
    got = query(spark, rows, tmp_path)
    assert got == brute(rows)
    alone = [(5, "s", "en", 1, "X")]
    assert query(spark, alone, tmp_path / "one") == brute(alone)
    assert query(spark, [], tmp_path / "none") == []


def test_written_manifest(spark, tmp_path):
    """Without a changed digest every leaf folds to the root; the tables of a manifest are plain columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    leaves = docs.select(F.col("lang").alias("tree"), "doc_id", merkle.leaf_digests(docs).alias("digest")).withColumn("now", F.col("digest"))
    manifest = merkle.build_manifest(leaves)
    assert all(r.verified for r in merkle.verify(manifest).collect())
    assert manifest.trees.rounds[0].columns == ["tree", "chunk", "level", "pos", "digest", "states", "levels"]
