"""Which of many patterns stand in texts: texts are walked character by character along the patterns' prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from textloom.functions.points import code_points, row_slices

#: log2 of the bits of a table at most, bits a prefix below that, characters and places of texts walked at a time.
MOST_BITS, SPARSE, CHARS, PLACES = 27, 16, 1 << 20, 1 << 19
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _longer(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of runs of characters that are longer by one."""
    h = (hashes + points + np.uint64(1)) * _STEP
    return h ^ (h >> np.uint64(32))


@dataclass
class Prefixes:
    """Sets of 2**log bits of the hashes of the patterns' prefixes and of whole patterns, the first characters, the longest length.
    The sets hold too much at times, never too little."""

    log: int
    prefixes: np.ndarray
    wholes: np.ndarray
    first: np.ndarray
    longest: int

    @staticmethod
    def empty(log: int) -> Prefixes:
        return Prefixes(log, np.zeros(1 << (log - 3), np.uint8), np.zeros(1 << (log - 3), np.uint8), np.zeros(0x110000, bool), 0)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _MIX) >> np.uint64(64 - self.log)).astype(np.int64)

    def _has(self, bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0

    def add(self, strings: pa.Array) -> None:
        points, at = code_points(strings)
        start, end = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
        self.first[points[start]] = True
        h, n = np.zeros(len(start), np.uint64), 0
        while len(start):
            h, n = _longer(h, points[start + n].astype(np.uint64)), n + 1
            slots, last = self._slots(h), start + n == end
            np.bitwise_or.at(self.prefixes, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
            np.bitwise_or.at(self.wholes, slots[last] >> 3, (1 << (slots[last] & 7)).astype(np.uint8))
            self.longest = max(self.longest, n)
            start, end, h = start[~last], end[~last], h[~last]

    def walk(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the runs that begin at ``start``, lie before ``end`` of the place, and may be patterns."""
        h, out = np.zeros(len(start), np.uint64), [(start[:0], start[:0])]
        for n in range(1, self.longest + 1):
            inside = start + n <= end
            start, end, h = start[inside], end[inside], h[inside]
            if not len(start):
                break
            h = _longer(h, points[start + n - 1].astype(np.uint64))
            slots = self._slots(h)
            known = self._has(self.prefixes, slots)
            start, end, h, slots = start[known], end[known], h[known], slots[known]
            whole = start[self._has(self.wholes, slots)]
            out.append((whole, whole + n))
        return tuple(np.concatenate([x[k] for x in out]) for k in (0, 1))


def prefixes(patterns: DataFrame) -> Prefixes:
    """The table of a column of patterns, of a written frame. Each of a few tasks sets the bits of its patterns; the tables, of a size
    that has an upper limit whatever the number of patterns, are united one after the other."""
    (name,) = patterns.columns
    chars = patterns.agg(F.sum(F.length(name))).first()[0] or 0
    log = min(MOST_BITS, max(16, int(chars * SPARSE).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Prefixes.empty(log)
        for b in batches:
            own.add(b.column(0))
        packed = [zlib.compress(x.tobytes(), 1) for x in (own.prefixes, own.wholes, np.packbits(own.first))]
        yield pa.RecordBatch.from_pydict({"p": [packed[0]], "w": [packed[1]], "f": [packed[2]], "n": [own.longest]}, schema=pa.schema([("p", pa.binary()), ("w", pa.binary()), ("f", pa.binary()), ("n", pa.int64())]))

    out = Prefixes.empty(log)
    for r in patterns.coalesce(8).mapInArrow(build, "p binary, w binary, f binary, n long").toLocalIterator():
        get = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
        out.prefixes |= get(r.p)
        out.wholes |= get(r.w)
        out.first |= np.unpackbits(get(r.f)).astype(bool)
        out.longest = max(out.longest, r.n)
    return out


def _runs(strings: pa.Array, table: Prefixes) -> tuple[np.ndarray, list[str]]:
    """(row, run) of the runs of the strings that may be patterns, by row."""
    points, at = code_points(strings)
    places = np.flatnonzero(table.first[points])
    ends = at[np.searchsorted(at, places, side="right")] if len(places) else places
    found = [table.walk(points, places[k : k + PLACES], ends[k : k + PLACES]) for k in range(0, len(places), PLACES)]
    start, end = (np.concatenate([x[k] for x in found]) if found else places for k in (0, 1))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    whole = points.tobytes().decode("utf-32-le")
    return np.searchsorted(at, start, side="right") - 1, [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def held_patterns(texts: DataFrame, key: str, tables: dict[str, Prefixes]) -> DataFrame:
    """(key, column, pattern): the distinct runs of characters of the text columns that may be among the patterns of the column's
    table, every one that is among them; joined with the patterns, they are the exact matches. The rows of a text follow from
    what stands in it, not from how many patterns begin alike."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)
    names = list(tables)
    schema = StructType().add(key, texts.schema[key].dataType).add("column", "string").add("patterns", ArrayType(StringType()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, name in enumerate(names, 1):
                for lo, hi in row_slices(b.column(k), len(b), CHARS):
                    row, runs = _runs(b.column(k).slice(lo, hi - lo), shared.value[name])
                    rows, counts = np.unique(row, return_counts=True)
                    lists = pa.ListArray.from_arrays(np.concatenate((np.zeros(1, np.int32), np.cumsum(counts))).astype(np.int32), pa.array(runs, pa.string()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows + lo)), pa.array([name] * len(rows), pa.string()), lists], names=[key, "column", "patterns"])

    found = texts.select(key, *names).mapInArrow(find, schema)
    return found.select(key, "column", F.explode(F.array_distinct("patterns")).alias("pattern"))
