"""Periodic runs of words by a sparse diagonal DP (operator 12).

A run is a stretch of consecutive words with smallest period q, at least max(12, 2 q) long, that no neighbouring word extends
keeping the period. In the table of lags, word i stands on the diagonal of lag d where word i - d is the same; a stretch of
period d is d words and then a row of such places, and a run of period d ends with at least max(12 - d, d) of them.

The DP adds one to a lag's match length where a word's earlier occurrence is that far back, and a diagonal that ends long
enough is emitted. It is sparse: lags below 16 have their diagonals walked whole; beyond that, a diagonal of lag d must hold d
places in a row, so for lags from L to 2 L - 1 (L a power of two) only earlier occurrences of the L words that begin here
count, no further back than 2 L. What repeats at L words is found by doubling, and positions that repeat nothing drop
out, so ordinary text is done with after a few doublings. A diagonal that such an occurrence opens is measured from there
both ways by the doublings already made, and is emitted if it is long enough.

Words in a stretch of small period p would open a diagonal for every multiple of p. L words inside a known run of period L/2 or
less open none: a diagonal that stays inside one run has that run's period, and one that leads from a run into another of
the same period is a run only where the two touch, so those lags are opened at the seams instead, one place for each.
With these left out, L words occur at most three times in 2 L, so cells grow as the words times the doublings, also for texts
of one word a million times. A stretch found at several lags has the smallest as its period.

Words are compared by number within their document, numbers are given by content; no hash decides. A task holds one batch of
about four million bytes of text (or one longer text) and some ten numbers a word.

Defined results: null and empty texts have no words and no runs; a null doc_id is passed through; repeated rows are judged one
by one; an empty table gives an empty one; texts of any length are taken whole; every other column passes through
unchanged, under names of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Words, free_names, numbered, slices, texts_of

#: Lags walked whole.
SMALL = 16
LEAST = 12


class Doubles:
    """Numbers of the 1, 2, 4 ... words from each place on; equal numbers are equal words of one document, and negative ones
    repeat nothing."""

    def __init__(self, ids: np.ndarray, row: np.ndarray):
        self.row, self.n, self.levels = row, len(ids), []
        self._add(np.arange(self.n), row.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids)
        while (self.levels[-1] >= 0).any():
            self._double()

    def _add(self, at: np.ndarray, key: np.ndarray) -> None:
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        out = -1 - np.arange(self.n, dtype=np.int64)
        again = count[number] > 1
        out[at[again]] = number[again]
        self.levels.append(out)

    def _double(self) -> None:
        last, step = self.levels[-1], 1 << (len(self.levels) - 1)
        at = np.flatnonzero(last >= 0)
        at = at[at + step < self.n]
        at = at[last[at + step] >= 0]  # numbers are of one document, so both halves are
        at = at[self.row[at] == self.row[at + step]]
        self._add(at, last[at] * np.int64(self.n + 1) + last[at + step])

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on."""
        start = x
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.maximum(x, y) < self.n
            same = np.zeros(len(x), np.int64)
            same[inside] = self.levels[k][x[inside]] == self.levels[k][y[inside]]
            x, y = x + (same << k), y + (same << k)
        return x - start

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x equal those before y."""
        start = x
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.minimum(x, y) >= 1 << k
            same = np.zeros(len(x), np.int64)
            same[inside] = self.levels[k][x[inside] - (1 << k)] == self.levels[k][y[inside] - (1 << k)]
            x, y = x - (same << k), y - (same << k)
        return start - x


def _smallest(runs: list[np.ndarray]) -> np.ndarray:
    """Runs (start, end, period), each stretch with its smallest period, in order of start and then period."""
    found = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _long_enough(start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    good = end - start >= np.maximum(LEAST, 2 * lag)
    return np.stack((start[good], end[good], lag[good]), axis=1)


def _walked(word: np.ndarray, lag: int) -> np.ndarray:
    """Runs on the diagonal of one lag."""
    match = np.concatenate(([False], word[lag:] == word[:-lag], [False]))
    edge = np.flatnonzero(match[1:] != match[:-1])
    return _long_enough(edge[0::2], edge[1::2] + lag, np.full(len(edge) // 2, lag))


def _covered(runs: np.ndarray, size: int, n: int) -> np.ndarray:
    """Places whose ``size`` words lie in one run of period size / 2 or less."""
    own = runs[(runs[:, 2] * 2 <= size) & (runs[:, 1] - runs[:, 0] >= size)]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, own[:, 0], 1)
    np.add.at(mark, own[:, 1] - size + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _cells(numbers: np.ndarray, free: np.ndarray, size: int) -> np.ndarray:
    """(place, lag) of the earlier occurrences of the ``size`` words from each free place, size to 2 size - 1 back."""
    at = np.flatnonzero((numbers >= 0) & free)
    at = at[np.argsort(numbers[at], kind="stable")]
    out = []
    for back in range(1, len(at)):
        later, earlier = at[back:], at[:-back]
        near = (numbers[later] == numbers[earlier]) & (later - earlier < 2 * size)
        if not near.any():
            break
        far = near & (later - earlier >= size)
        out.append(np.stack((later[far], later[far] - earlier[far]), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _first_of_diagonals(cells: np.ndarray) -> np.ndarray:
    """Cells that no cell of their lag stands just before: the DP's match lengths begin there."""
    cells = cells[np.lexsort((cells[:, 0], cells[:, 1]))]
    new = np.ones(len(cells), bool)
    new[1:] = (cells[1:, 1] != cells[:-1, 1]) | (cells[1:, 0] != cells[:-1, 0] + 1)
    return cells[new]


def _seams(runs: np.ndarray, size: int, doubles: Doubles) -> np.ndarray:
    """Cells where two runs of one period touch, for lags from size to 2 size - 1 that lead from one into the other."""
    own = runs[(runs[:, 2] * 2 <= size) & (runs[:, 1] - runs[:, 0] >= size)]
    own = own[np.lexsort((own[:, 0], own[:, 2]))]
    a, b = own[:-1], own[1:]
    pair = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    a, b = a[pair], b[pair]
    out = []
    for (start, end, p), (second, last, _) in zip(a.tolist(), b.tolist()):
        most = min(end - start, last - second, 2 * size - 1)
        if most < size:
            continue
        lags = np.arange(size, min(size + p, most + 1))  # one of p lags in a row leads to the same words
        x = np.full(len(lags), end)
        for lag in lags[doubles.ahead(x, x - lags) >= p].tolist():
            all_lags = np.arange(lag, most + 1, p)
            out.append(np.stack((np.full(len(all_lags), end), all_lags), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def find_runs(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) of the words numbered ``word``; ``row`` is each word's document, in order."""
    n = len(word)
    if not n:
        return np.zeros((0, 3), np.int64)
    # a document's words get numbers of their own, so that no diagonal leads into another document
    doubles = Doubles(word, row)
    one = doubles.levels[0]
    runs = _smallest([_walked(one, lag) for lag in range(1, min(SMALL, n))])
    for k, numbers in enumerate(doubles.levels):
        size = 1 << k
        if size < SMALL:
            continue
        cells = [_first_of_diagonals(_cells(numbers, ~_covered(runs, size, n), size)), _seams(runs, size, doubles)]
        at, lag = np.concatenate(cells).T
        inside = (at < n) & (at >= lag)
        at, lag = at[inside], lag[inside]
        start, end = at - doubles.behind(at, at - lag), at + doubles.ahead(at, at - lag)
        runs = _smallest([runs, _long_enough(start - lag, end, lag)])
    return runs


def later_copies(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are in a run, after its first period."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 1], -1)
    return np.cumsum(mark[:-1]) > 0


def word_numbers(words: Words) -> np.ndarray:
    return numbered(np.frombuffer(words.data, np.uint8), words.start, words.end, words.hash)[1]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Bytes of text that a task works on at a time; a longer text is a part of its own.
PART = 4 << 20


def _mark(names: list[str], added: list[str], change):
    def run(batches):
        for batch in batches:
            for part in slices(batch, PART):
                words = Words(texts_of(part.column("text")))
                number, row = word_numbers(words), words.row
                if change:
                    at = np.concatenate([change(key, b - a) + a for key, a, b in zip(part.column("doc_id").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist())] or [np.zeros(0, np.int64)])
                    number = number[at]
                else:
                    at = np.arange(len(number))
                runs = find_runs(number, row)
                keep = ~later_copies(runs, len(number))
                cut_at = np.searchsorted(runs[:, 0], words.first)
                found, kept = [], []
                for r in range(part.num_rows):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    found.append([{"start": s - a, "length": e - s, "period": p} for s, e, p in runs[cut_at[r] : cut_at[r + 1]].tolist()])
                    kept.append(b" ".join(words.text(i) for i in at[a:b][keep[a:b]].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(np.diff(words.first).astype(np.int64)), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, *added]
                )

    return run


def mark_runs(docs: DataFrame, change=None) -> tuple[DataFrame, list[str]]:
    """``docs`` (with doc_id and text) and three more columns, whose names are given too: the number of words, the runs by start
    and period, and the text of the words that are in no run after its first period.

    ``change`` (doc_id, n) may give the places of the words that stand for a document's n words.
    """
    added = free_names(docs.columns, "__pr_words", "__pr_runs", "__pr_kept")
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T._parse_datatype_string(RUNS)), T.StructField(added[2], T.StringType())])
    return docs.mapInArrow(_mark(docs.columns, added, change), schema), added


def repeat_tail(doc_id, n: int) -> np.ndarray:
    """Places of a document's n words after the query's change: every tenth document, by its checksum, repeats from a place on."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked, (_, runs, kept) = mark_runs(docs, repeat_tail)
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return marked.withColumn("best", best).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(kept, 256).alias("collapsed_sha256"),
    )
