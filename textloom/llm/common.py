"""Helpers that the corpus operators share: numpy word hashing over Arrow batches, checkpoints, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.storage import cut

#: Bytes that end a word of the white-space word rule: space and \t..\r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_BYTES = ~_SPACE
#: Bytes of the alphanumeric word rule, after lower-casing: 0-9, a-z and all of UTF-8 beyond ASCII.
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True
#: Byte map that lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if _POWERS["n"] < n + 1:
        size = max(1 << 16, 2 * (n + 1))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def span_hash(codes: np.ndarray, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``symbols``; spans are in order and do not overlap; ``codes`` has a symbol's number."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # in pieces, so that powers of the base stay a small table
        upto = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 20), side="right")))
        lo, hi = int(start[at]), int(end[upto - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[symbols[lo:hi]] * up[: hi - lo])))
        s, e = start[at:upto] - lo, end[at:upto] - lo
        out[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def numbered(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers the spans of ``symbols`` by content: (a span of each content, the number of each span), exactly.

    Spans of an equal hash are compared with one of them symbol by symbol; should two differ, all are told apart by their symbols.
    """
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = end - start
    twin = first[number]
    equal = bool((lengths == lengths[twin]).all())
    step = 1 << 16
    for a in range(0, len(start) if equal else 0, step):
        n = lengths[a : a + step]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not (symbols[np.repeat(start[a : a + step], n) + within] == symbols[np.repeat(start[twin[a : a + step]], n) + within]).all():
            equal = False
            break
    if not equal:
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(symbols[s:e].tobytes(), len(seen)) for s, e in zip(start, end)], np.int64)
        first = np.unique(number, return_index=True)[1]
    return first, number


class Words:
    """The words of a list of UTF-8 texts: byte spans, owning row and 64-bit hash of each, in text order.

    ``first[r]:first[r + 1]`` are the words of row r. Texts are cut into words by numpy over one shared buffer, so
    the cost a word is a few tens of nanoseconds and memory is a small multiple of the texts' bytes.
    """

    def __init__(self, texts: list[bytes], allowed: np.ndarray = WORD_BYTES, lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"  # a separator that is in no word of either rule
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            raw = LOWER[raw]
            self.data = raw.tobytes()
        inside = allowed[raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))  # first byte of each row
        self.first = np.searchsorted(self.start, self.bounds)
        self.first[-1] = len(self.start)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = span_hash(_BYTE_CODES, raw, self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether all n are in its row."""
        return grams(self.hash, self.row, n)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def joined(self, i: int, j: int) -> bytes:
        """Words i..j-1, joined by one space."""
        return b" ".join(self.data[self.start[k] : self.end[k]] for k in range(i, j))


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(hashes)
    if size < n:
        return np.zeros(size, np.uint64), np.zeros(size, bool)
    out = np.zeros(size, np.uint64)
    m = size - n + 1
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * _STEP + hashes[k : k + m]
    out[:m] = mix(acc + np.uint64(n))
    good = np.zeros(size, bool)
    good[:m] = row[:m] == row[n - 1 :]
    return out, good


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, most: int = 16 << 20):
    """The batch in parts of about ``most`` bytes of text, so that a task's memory has a bound beside one row's size."""
    at, size = 0, 0
    lengths = batch.column("text").cast(pa.large_binary())
    import pyarrow.compute as pc

    lengths = [x or 0 for x in pc.binary_length(lengths).to_pylist()]
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted working names, each with as many underscores added as it takes to be no column's name (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps until nothing changes. No step gathers a node's neighbours: each is a
    minimum per key (combined before the shuffle) and joins back, which adaptive execution splits where a key is hot.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node goes to the node's minimum
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # small star: every smaller neighbour, and the node, go to the minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e = cut(small)
        before, state = state, e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def joined_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (id, component) with the components that ``edges`` (a, b) link made one; settled nodes stay as they are."""
    side = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    named = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = cut(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    if between.isEmpty():
        return groups
    more = cut(components(between))
    new = more.select(F.col("id").alias("component"), F.col("component").alias("joined"))
    moved = groups.join(new, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
    return cut(moved.unionByName(more.join(groups, "id", "left_anti").select("id", "component")))
