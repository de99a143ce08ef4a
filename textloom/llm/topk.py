"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index (operator 1).

The index is dealt into blocks of vectors. A block's index holds postings (vector) in segments by quantised impact and
dimension: a component is quantised to a multiple of the block's step, and all postings of a segment have the same impact. A
batch of queries takes the segments in descending order of impact; a segment adds its impact, times the queries' component, to
the accumulators of its vectors. What an accumulator still lacks of a score is bounded by |query| * |vector less what was
added| (Cauchy-Schwarz), impacts' rounding included. The k-th largest lower bound of a query, or the k-th best score that the
task has found in other blocks, is what a candidate must reach; when that proof leaves few candidates, or no segment is left,
the work on the block stops, and possible members are rescored exactly.

Queries against all rows are a search in blocks: the index is written once, the queries are broadcast in parts of
``part_bytes``, and each part passes over the index (results of all but the last are written, and the part's broadcast is freed).
A block returns at most k rows a query, and the last step ranks those.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id;
components are floor(256 * x) as doubles, in which any such number is exact; the scores of vectors of different lengths take
missing components as 0; scores are exact integers, and those beyond a long count as the end of its range; rows that repeat an
id count once, with the smallest vector; ties go to the smaller id; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut

IMPACTS = 24  # quantised impacts of a block, each sign
BATCH = 256  # queries whose accumulators are filled together
LONG = (1 << 63) - 1


class Block:
    """The impact-ordered index of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.most = float(np.abs(self.x).max(initial=0.0))
        self.step = max(1.0, self.most / (IMPACTS + 0.5))
        self.impact = np.rint(self.x / self.step)
        rows, dims = np.nonzero(self.impact)
        value = self.impact[rows, dims].astype(np.int64)
        order = np.lexsort((rows, dims, value, -np.abs(value)))  # descending impact, then dimension
        self.rows, dims, value = rows[order], dims[order], value[order]
        at = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (value[1:] != value[:-1])]) if len(value) else np.zeros(0, np.int64)
        self.segments = list(zip(at.tolist(), np.r_[at[1:], len(value)].tolist(), dims[at].tolist(), (value[at] * self.step).tolist(), np.abs(value[at]).tolist()))
        # |vector less what was added| once all impacts above a level are in
        self.left = {}
        for level in range(IMPACTS + 1, 0, -1):
            added = np.where(np.abs(self.impact) >= level, self.impact * self.step, 0.0)
            self.left[level] = np.linalg.norm(self.x - added, axis=1)
        self.whole = np.linalg.norm(self.x, axis=1)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the vector, score) of each query's k best of the block that reach ``floor``."""
        n, m = len(self.ids), len(qids)
        d = min(self.x.shape[1], q.shape[1])
        qs = np.zeros((self.x.shape[1], m))
        qs[:d] = q[:, :d].T
        lengths = np.linalg.norm(qs, axis=0)
        own = np.searchsorted(self.ids, qids)
        own_col = np.flatnonzero((own < n) & (self.ids[np.minimum(own, n - 1)] == qids))
        own = own[own_col]
        acc = np.zeros((n, m))
        top = min(k, n)
        rounding = 1e-9 * self.whole[:, None] * lengths[None, :] + 1e-6
        possible, checked = None, self.whole.sum()

        def proof(level: int) -> np.ndarray:
            slack = self.left[level][:, None] * lengths[None, :] + rounding
            lower = acc - slack
            lower[own, own_col] = -np.inf
            least = np.maximum(np.partition(lower, n - top, axis=0)[n - top], floor)
            # scores beyond a long tie at its ends
            good = np.clip(acc + slack, -float(LONG), float(LONG)) >= np.clip(least, -np.inf, float(LONG))[None, :]
            good[own, own_col] = False
            return good

        level = IMPACTS + 1
        for a, b, dim, value, size in self.segments:
            if size < level:
                # a proof costs as much as some segments: it is tried when half of what was left is in
                if self.left[size + 1].sum() * 2 <= checked:
                    checked = self.left[size + 1].sum()
                    possible = proof(size + 1)
                    if possible.sum() <= 4 * top * m:
                        break
                level = size
            acc[self.rows[a:b]] += value * qs[dim]
            possible = None
        if possible is None:
            possible = proof(1)
        rows, cols = np.nonzero(possible)
        score = exact(self.x, qs.T, rows, cols, self.most)
        order = np.lexsort((self.ids[rows], -score, cols))  # -score is safe: see exact
        rows, cols, score = rows[order], cols[order], score[order]
        keep = (np.arange(len(cols)) - np.searchsorted(cols, cols)) < k
        return cols[keep], rows[keep], score[keep]


def exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of chosen pairs, within +-(2**63 - 1)."""
    bound = most * float(np.abs(q).max(initial=0.0)) * x.shape[1]
    out = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 1 << 16):  # pairs at a time: rows are gathered
        r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
        if bound < 2**53:
            out[a : a + len(r)] = np.einsum("ij,ij->i", x[r], q[c])
        elif bound < 2**62 and most < 2**62 and np.abs(q).max() < 2**62:
            out[a : a + len(r)] = np.einsum("ij,ij->i", x[r].astype(np.int64), q[c].astype(np.int64))
        else:
            out[a : a + len(r)] = [min(LONG, max(-LONG, sum(int(u) * int(v) for u, v in zip(x[i], q[j])))) for i, j in zip(r, c)]
    return out


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    width = 1 << key[0].as_py()
    data = np.zeros((table.num_rows, width))
    vectors = table.column("v").combine_chunks()
    sizes = np.asarray(vectors.value_lengths())
    data[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(vectors.flatten())
    data = data[:, : int(sizes.max())]
    return pa.table({
        "ids": pa.array([np.asarray(table.column("id"), dtype=np.int64).tobytes()], pa.binary()),
        "vectors": pa.array([data.astype(np.float32 if np.abs(data).max(initial=0) < 2**24 else np.float64).tobytes()], pa.binary()),
        "dims": pa.array([data.shape[1]], pa.int32()),
    })


def _search(shared, k: int):
    def run(batches):
        parts = shared.value
        # each query's best scores of the blocks that this task has seen
        best = [np.full((len(qids), k), -np.inf) for qids, _ in parts]
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                kind = np.float32 if len(r["vectors"]) == 4 * len(ids) * r["dims"] else np.float64
                block = Block(ids, np.frombuffer(r["vectors"], kind).reshape(len(ids), -1).astype(np.float64))
                for (qids, q), known in zip(parts, best):
                    cols, rows, score = block.search(qids, q, k, known.min(axis=1))
                    place = np.arange(len(cols)) - np.searchsorted(cols, cols)
                    found = np.full(known.shape, -np.inf)
                    found[cols, place] = score
                    known[:] = np.sort(np.hstack([known, found]), axis=1)[:, -k:]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[cols]), pa.array(block.ids[rows]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _batches(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries in batches of one width each."""
    ids = np.asarray(rows.column("id"), dtype=np.int64)
    vectors = rows.column("v").combine_chunks()
    sizes = np.asarray(vectors.value_lengths())
    start = np.r_[0, np.cumsum(sizes)]
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    out = []
    for width in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == width)
        data = flat[start[own][:, None] + np.arange(width)]
        out += [(ids[own[a : a + BATCH]], data[a : a + BATCH]) for a in range(0, len(own), BATCH)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = 2 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for frames of (id long, v array<double>); a query's own id is no candidate."""
    spark = vectors.sparkSession
    width = F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1)).cast("double"))).cast("int")  # vectors of like lengths share blocks
    sized = vectors.select(width.alias("width"), "id", "v")
    counts = {r.width: r.n for r in sized.groupBy("width").agg(F.count("*").alias("n")).collect()}
    blocks = F.lit(1).cast("long")
    for w, n in counts.items():
        blocks = F.when(F.col("width") == w, F.lit(max(1, -(-n * (8 << w) // block_bytes)))).otherwise(blocks)
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    index = cut(dealt.groupBy("width", "block").applyInArrow(_pack, "ids binary, vectors binary, dims int"))
    size = queries.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8 + 8), F.lit(0))).first()[0]
    parts, found = max(1, -(-size // part_bytes)), None
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("id", F.lit(parts)), F.lit(parts)) == part).select("id", "v").toArrow()
        shared = spark.sparkContext.broadcast(_batches(rows))
        own = index.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        if part + 1 < parts:
            own = cut(own)
            shared.destroy()
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component, for vectors whose components are all finite; one row an id."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c))
    # a double from 2**52 on is whole, and floor would leave the long's range
    v = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < F.lit(float(1 << 52)), F.floor(c.cast("double") * scale).cast("double")).otherwise(c.cast("double") * scale))
    return embeddings.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def op1(spark, sf_dir: str) -> DataFrame:
    index = cut(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(index, index.where("id % 50 = 0"), 5)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= 5
"""
