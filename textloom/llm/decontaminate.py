"""Benchmark decontamination with a broadcast hash set of test n-grams (operator 4).

Words are lower-cased (A-Z alone) runs of digits, ASCII letters and everything beyond ASCII. A benchmark item's windows
are its runs of ``ngram`` words; an item with fewer words is one window. Windows are hashed, a document's windows are looked
up by hash in batches, and each hit is verified against the words themselves.

The set is broadcast in parts of about ``part_bytes`` bytes of windows and item ids. A benchmark of one part, the usual case,
takes one pass over the documents without a shuffle. One of more parts takes a pass a part; the result of a pass is written
before the next begins and its broadcast is then freed, so that one part at a time is on the driver and in the executors.

Defined results: null or empty texts have no words and no hits; items with a null text or no word, and items with a null
id, give no windows; items that share windows are all reported; repeated rows are judged one by one; an empty table, or
an empty benchmark, gives rows without hits; every column of the documents passes through unchanged, whatever its name
(working columns take names that are free).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import ALNUM_BYTES, Words, cut, free_names, slices, texts_of

#: Bytes of windows and items of one broadcast part; the hash tables made of them take some five times as much.
PART_BYTES = 48 << 20


def _windows(ngram: int):
    """Benchmark rows to (window text, item)."""

    def run(batches):
        for batch in batches:
            grams, items = [], []
            texts = texts_of(batch.column("text"))
            w = Words(texts, ALNUM_BYTES, lower=True)
            for r, item in enumerate(batch.column("item").to_pylist()):
                a, b = int(w.first[r]), int(w.first[r + 1])
                n = min(ngram, b - a)
                for p in range(a, b - n + 1) if n else ():
                    grams.append(w.joined(p, p + n))
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(items, pa.string())], names=["gram", "item"])

    return run


def _window_set(rows: list[tuple[bytes, str]]) -> dict[int, tuple[np.ndarray, dict]]:
    """Windows by their length in words: sorted hashes, and for each hash its texts with their items."""
    texts: dict[bytes, set[str]] = {}
    for gram, item in rows:
        texts.setdefault(gram, set()).add(item)
    out = {}
    for n in sorted({g.count(b" ") + 1 for g in texts}):
        own = [g for g in texts if g.count(b" ") + 1 == n]
        w = Words(own, ALNUM_BYTES, lower=True)
        h, _ = w.grams(n)
        by_hash: dict[int, dict[bytes, set[str]]] = {}
        for g, x in zip(own, h[w.first[:-1]].tolist()):
            by_hash.setdefault(x, {})[g] = texts[g]
        out[n] = (np.array(sorted(by_hash), dtype=np.uint64), by_hash)
    return out


def _scan(shared, names: list[str], added: list[str], first: bool):
    def run(batches):
        windows = shared.value
        for batch in batches:
            for part in slices(batch):
                w = Words(texts_of(part.column("text")), ALNUM_BYTES, lower=True)
                rows = part.num_rows
                mark = np.zeros(len(w.hash) + 1, np.int64)
                if not first:
                    for r, old in enumerate(part.column(added[1]).to_pylist()):
                        for p in np.frombuffer(old or b"", np.int32):
                            mark[w.first[r] + p] += 1
                            mark[w.first[r] + p + 1] -= 1
                items = [set() for _ in range(rows)] if first else [set(x) for x in part.column(added[2]).to_pylist()]
                for n, (hashes, by_hash) in windows.items():
                    h, ok = w.grams(n)
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    for p in np.flatnonzero(ok & (hashes[at] == h)).tolist():
                        found = by_hash[int(h[p])].get(w.joined(p, p + n))
                        if found:
                            mark[p] += 1
                            mark[p + n] -= 1
                            items[w.row[p]] |= found
                hit = np.cumsum(mark[:-1]) > 0
                hits = [np.flatnonzero(hit[a:b]).astype(np.int32).tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(np.diff(w.first).astype(np.int64)), pa.array(hits, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*names, *added],
                )

    return run


def mark_contamination(docs: DataFrame, benchmark: DataFrame, ngram: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with __dc_words (number of words), __dc_hits (positions of hit words, int32 bytes) and __dc_items, the last three
    columns; each has an underscore more for every column of ``docs`` that is in its way."""
    spark = docs.sparkSession
    names, added = docs.columns, free_names(docs.columns, "__dc_words", "__dc_hits", "__dc_items")
    bench = benchmark.where("text is not null and item_id is not null").select(F.col("text").cast("string").alias("text"), F.col("item_id").cast("string").alias("item"))
    windows = cut(bench.mapInArrow(_windows(ngram), "gram binary, item string").distinct())
    size = windows.agg(F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("item") + 32), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    # a window that very many items share spreads over the parts too
    windows = windows.withColumn("part", F.pmod(F.xxhash64("gram", "item"), F.lit(parts)))
    schema = T.StructType([
        *docs.schema.fields,
        *(T.StructField(c, t) for c, t in zip(added, (T.LongType(), T.BinaryType(), T.ArrayType(T.StringType())))),
    ])
    out = docs
    for part in range(parts):
        rows = [(bytes(r.gram), r.item) for r in windows.where(F.col("part") == part).select("gram", "item").collect()]
        shared = spark.sparkContext.broadcast(_window_set(rows))
        out = out.mapInArrow(_scan(shared, names, added, part == 0), schema)
        if part + 1 < parts:
            out = cut(out)
            shared.destroy()
    return out


def without_spans(text: str, hits: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The text without runs of hit words; ``start`` and ``end`` are its words' byte places."""
    raw = text.encode()
    kept, at = [], 0
    for run in np.split(hits, np.flatnonzero(np.diff(hits) != 1) + 1):
        kept.append(raw[at : start[run[0]]])
        at = end[run[-1]]
    return b"".join([*kept, raw[at:]]).decode()


def _strip(names: list[str], found: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                hits = part.column(found).to_pylist()
                rows = [i for i, h in enumerate(hits) if h]
                w = Words([texts[i].encode() for i in rows], ALNUM_BYTES, lower=True)
                for k, i in enumerate(rows):
                    own = slice(w.first[k], w.first[k + 1])
                    texts[i] = without_spans(texts[i], np.frombuffer(hits[i], np.int32), w.start[own] - w.bounds[k], w.end[own] - w.bounds[k])
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names], names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, ngram: int = 10, max_hit_share: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without contamination: documents with a larger share of hit words than ``max_hit_share`` go; from the
    others, the hit spans are cut. With 0, the default, every contaminated document goes."""
    marked = mark_contamination(docs, benchmark, ngram, part_bytes)
    words, hits = marked.columns[-3:-1]
    share = F.octet_length(hits) / F.lit(4) / F.greatest(words, F.lit(1))
    kept = marked.where(share <= max_hit_share)
    if max_hit_share <= 0:
        return kept.select(*docs.columns)
    return kept.select(*docs.columns, hits).mapInArrow(_strip(docs.columns, hits), docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.octet_length("__dc_hits").cast("long") / 4
    return marked.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("__dc_words").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size("__dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__dc_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bs AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM bw WHERE len(w) > 0
), bg AS (
  SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM bs
), ns AS (SELECT DISTINCT n FROM bg), ds AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, ns WHERE len(w) >= n
), hits AS (
  SELECT d.doc_id, d.p, d.n, bg.item
  FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ds) d JOIN bg ON d.g = bg.g AND d.n = bg.n
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""
