"""Rules that depend on the order of a key's rows: chains of compare-and-set requests, and names that must not be taken twice.

Both pass sorted rows through tasks with a small state. What makes them scale is how a key is cut: requests by an associative
composition of maps, names by the part of a name that a suffix can never change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import sheet_title
from textloom.storage import cut

State = tuple[str | None, str | None]


class TransitionMap:
    """What a row of requests does to any state: a map on finitely many states, the identity on all others."""

    def __init__(self) -> None:
        self.ends: dict[State, State] = {}
        self.starts: dict[State, set[State]] = {}

    def then(self, expected: State, new: State) -> None:
        """Adds a request: whatever ends in ``expected`` so far, now ends in ``new``."""
        moved = self.starts.pop(expected, set())
        if expected not in self.ends:
            moved.add(expected)
        for start in moved:
            self.ends[start] = new
        self.starts.setdefault(new, set()).update(moved)

    def rows(self) -> list[tuple]:
        return [(*start, *end) for start, end in self.ends.items()]


_PART = ["id", "part"]
PART_ROWS = 1 << 18  # requests that a task sorts, about


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Maps of the requests of each (id, part), which come sorted."""
    key, held = None, TransitionMap()
    for pdf in batches:
        out = []
        for k, e, a, s, b in zip(zip(pdf["id"], pdf["part"]), pdf["expected"], pdf["attempt"], pdf["new"], pdf["new_attempt"]):
            if k != key:
                if key is not None:
                    out += [(*key, *r) for r in held.rows()]
                key, held = k, TransitionMap()
            held.then((e, a), (s, b))
        yield pd.DataFrame(out, columns=[*_PART, "s0", "a0", "s1", "a1"])
    if key is not None:
        yield pd.DataFrame([(*key, *r) for r in held.rows()], columns=[*_PART, "s0", "a0", "s1", "a1"])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state before each part, from the row's first state and the maps of the parts before, which come in order."""
    key, at, state, moves = None, None, None, {}
    for pdf in batches:
        out = []
        for k, p, s, a, s0, a0, s1, a1 in pdf[["id", "part", "status", "attempt", "s0", "a0", "s1", "a1"]].itertuples(index=False, name=None):
            if (k, p) != at:
                state = moves.get(state, state) if k == key else (s, a)
                key, at, moves = k, (k, p), {}
                out.append((k, p, *state))
            moves[s0, a0] = (s1, a1)
        yield pd.DataFrame(out, columns=[*_PART, "status", "attempt"])


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for pdf in batches:
        out = []
        for k, p, seq, e, a, s, b, known, s0, a0 in pdf[[*_PART, "seq", "expected", "attempt", "new", "new_attempt", "known", "status", "held"]].itertuples(index=False, name=None):
            if (k, p) != key:
                key, state = (k, p), (s0, a0)
            ok = bool(known) and state == (e, a)
            state = (s, b) if ok else state
            out.append((k, seq, ok, *state))
        yield pd.DataFrame(out, columns=["id", "seq", "accepted", "status", "attempt"])


def request_chains(held: DataFrame, requests: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, seq, accepted, status, attempt): each of the ``requests`` (id, seq, expected, attempt, new, new_attempt) in order of
    seq, and the row's state after it, given ``held`` (id, status, attempt), an id once.

    A request is accepted where the row then has the expected status under the request's attempt (null equals null), and sets
    the new status and attempt. Requests for ids that are not held, or null, are refused. States are strings. Requests of equal
    seq go in order of their other columns, nulls first.

    Requests are dealt by ranges of (id, seq): a busy id lies in many parts. A part's requests compose to a map of states, on
    as many states as the part names; an id's maps, a row a part and state, give the state before each part; then the parts
    apply their requests at the same time. No task takes an id's requests as a whole. The number of parts grows with the
    requests, so that a task's rows, and what it sorts, do not.
    """
    spark = requests.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-requests.count() // PART_ROWS), 1)
    text = lambda c: F.col(c).cast("string").alias(c)
    r = requests.select("id", F.col("seq").cast("long").alias("seq"), *map(text, ("expected", "attempt", "new", "new_attempt")))
    order = ["seq", "expected", "attempt", "new", "new_attempt"]
    r = cut(r.repartitionByRange(n, "id", *order).withColumn("part", F.spark_partition_id()))
    kind = r.schema["id"].dataType.simpleString()
    own = held.select("id", text("status"), text("attempt"))
    # a number that is given is not lowered by the planner, whose own tasks hold so many bytes of shuffle, compressed
    dealt = lambda df, *by: df.repartition(n, *by)
    pandas = lambda df, f, schema: df.mapInPandas(f, schema)
    maps = pandas(dealt(r, *_PART).sortWithinPartitions(*_PART, *order), _maps, f"id {kind}, part int, s0 string, a0 string, s1 string, a1 string")
    starts = pandas(dealt(maps, "id").join(dealt(own, "id"), "id").sortWithinPartitions("id", "part"), _starts, f"id {kind}, part int, status string, attempt string")
    starts = cut(starts.withColumnRenamed("attempt", "held").withColumn("known", F.lit(True)))
    return pandas(dealt(r, *_PART).join(dealt(starts, *_PART), _PART, "left").sortWithinPartitions(*_PART, *order), _apply, f"id {kind}, seq long, accepted boolean, status string, attempt string")


def _title_fold(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, taken, following = None, set(), {}
        for pdf in batches:
            out = []
            for k, base in zip(zip(pdf["book"], pdf["stem"]), pdf["base"]):
                if k != key:
                    key, taken, following = k, set(), {}
                title, n = base, following.get(base, 2)
                while title.lower() in taken:  # a base's earlier numbers stay taken, so its search goes on where it ended
                    suffix = f"_{n}"
                    title, n = base[: most - len(suffix)] + suffix, n + 1
                following[base] = n
                taken.add(title.lower())
                out.append(title)
            yield pd.DataFrame({"book": pdf["book"], "idx": pdf["idx"], "final": out})

    return run


def sheet_titles(sheets: DataFrame, most: int = 31) -> DataFrame:
    """(book, idx, final) of ``sheets`` (book, idx, title, original): titles without characters that sheets can't have, at most
    ``most`` long, and none twice in a book whatever its case: a later sheet takes the first free one of ``_2``, ``_3`` and so on
    in its title's last places. Empty and reserved titles fall back on the original; sheets without a new title keep theirs and
    take no name.

    A sheet's search is decided by those before it in the book that can come to the same name. A suffix is the only change,
    and up to six digits of it leave the first 24 characters alone but for endings like a suffix; so books are cut by these.
    """
    named = F.coalesce(F.col("title"), F.lit("")) != ""
    rows = sheets.where(named).select("book", "idx", sheet_title(F.col("title"), F.col("original"), most).alias("base"))
    folded = F.translate(F.lower(F.left("base", F.lit(most - 7))), "ς", "σ")
    rows = rows.withColumn("stem", F.regexp_replace(folded, "(_[0-9]*)+$", ""))
    schema = ", ".join(f"{c} {sheets.schema[c].dataType.simpleString()}" for c in ("book", "idx")) + ", final string"
    found = rows.repartition("book", "stem").sortWithinPartitions("book", "stem", "idx").mapInPandas(_title_fold(most), schema)
    return found.unionByName(sheets.where(~named).select("book", "idx", F.col("original").alias("final")))


def fold_batch(batch: DataFrame, keys: list[str], order: list[str], overwrite: list[str], keep_old_if_null: list[str] = (), keep_old: list[str] = ()) -> DataFrame:
    """The rows of ``batch`` as one a key, as if merged in ``order``: the last value of overwritten columns (also null), the last
    value that is not null of the second kind, the first of the third. Aggregates, combined before the shuffle."""
    at = F.struct(*order)
    last = [F.max_by(F.struct(c), at)[c].alias(c) for c in overwrite]
    last += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep_old_if_null]
    last += [F.min_by(F.struct(c), at)[c].alias(c) for c in keep_old]
    return batch.groupBy(*keys).agg(*last)


def chunk_schedule(chunks: DataFrame, large: int = 30_000) -> DataFrame:
    """(doc_id, chunk, lane, turn, after) of ``chunks`` (doc_id, chunk, size): documents of more than ``large`` characters go chunk by
    chunk, each in a turn after its predecessor; smaller ones are one piece of work each, all in turn 0. A lane is what may run
    at the same time as other lanes: rows of one turn have different lanes."""
    doc = Window.partitionBy("doc_id")
    big = F.sum("size").over(doc) > large
    order = doc.orderBy("chunk")
    return chunks.select(
        "doc_id", "chunk", F.concat_ws(":", "doc_id", F.when(big, None).otherwise(F.col("chunk"))).alias("lane"),
        F.when(big, F.row_number().over(order) - 1).otherwise(0).cast("bigint").alias("turn"), F.when(big, F.lag("chunk").over(order)).alias("after"),
    )
