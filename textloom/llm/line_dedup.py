"""Line dedup by winnowing over line hashes (operator 6).

Lines are the parts of a text between newlines; for comparing they lose white space at both ends, and blank lines are
passed over. A *run* is ``min_lines`` or more lines in a row (blank ones aside), or a single line of ``single_words`` words
or more or of more than 32 bytes (for scripts without spaces), that also occurs earlier: in a document with a smaller
doc_id, or further up in the same one. All lines of such later runs go, with the newline, also where it is a document's
only line. Shorter single lines stay unless their neighbours repeat too; ``single_words=None`` lets no single line be a run.

Of each window of ``min_lines`` line hashes the leftmost smallest is a fingerprint, so any run that long shares one at the
same place; a single line is its own. Windows whose lines are all runs by themselves are left to those. Fingerprints that
occur once are done with; the others lead to the windows that chose them, which are compared by content, and a window's first
occurrence is kept. A longer run is the union of its windows: none is grown line by line. A fingerprint or window that very many documents share is counted before the shuffle and joined back;
pairs of positions are never listed.

Defined results: null and empty texts stay as they are; rows with a null doc_id stay and are no source; rows equal in
doc_id and text are one document; an empty table gives an empty one; every other column passes through unchanged, whatever
its name (working columns take names that are free).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, free_names, texts_of


OWN = "array<struct<pos:int,n:int,key:binary,again:boolean>>"


def _anchors(min_lines: int, single_words: int | None):
    def single(line: bytes) -> bool:
        return single_words is not None and (len(line) > 32 or len(line.split()) >= single_words)

    def run(batches):
        import xxhash

        line_hash, window_hash = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            out = {"fp": [], "doc": [], "txt": [], "own": []}
            for doc, txt, text in zip(batch.column("doc").to_pylist(), batch.column("txt").to_pylist(), texts_of(batch.column("text"))):
                lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
                h = np.array([line_hash(x) for x in lines], dtype=np.uint64)
                alone = [single(x) for x in lines]
                runs = [(p, p, 1) for p, x in enumerate(alone) if x]
                runs += [(p, p + int(np.argmin(h[p : p + min_lines])), min_lines) for p in range(len(lines) - min_lines + 1) if not all(alone[p : p + min_lines])]
                own: dict[int, list] = {}
                seen: set[bytes] = set()
                for p, a, n in runs:
                    key = window_hash(b"\n".join(lines[p : p + n]))
                    own.setdefault(a, []).append({"pos": p, "n": n, "key": key, "again": key in seen})
                    seen.add(key)
                for a, windows in own.items():
                    out["fp"].append(int(h[a].view(np.int64)))
                    out["doc"].append(doc)
                    out["txt"].append(txt)
                    out["own"].append(windows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["fp"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["txt"], pa.int64()), pa.array(out["own"], pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("again", pa.bool_())])))],
                names=["fp", "doc", "txt", "own"],
            )

    return run


def _delete(names: list[str], places: str, count: str):
    def run(batches):
        for batch in batches:
            texts, removed = [], []
            for text, later in zip(batch.column("text").to_pylist(), batch.column(places).to_pylist()):
                if not later:
                    texts.append(text)
                    removed.append(0)
                    continue
                gone = {x["pos"] + k for x in later for k in range(x["n"])}
                kept, i = [], 0
                for line in text.split("\n"):
                    if line.strip(" \t\r\x0b\x0c"):
                        if i not in gone:
                            kept.append(line)
                        i += 1
                    else:
                        kept.append(line)
                texts.append("\n".join(kept))
                removed.append(len(gone))
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64())], names=[*names, count])

    return run


def dedup_lines(docs: DataFrame, min_lines: int = 2, single_words: int | None = 2) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, and ``__ld_removed``, the lines deleted, as last column
    (with an underscore more for every column of ``docs`` that is in its way)."""
    names = docs.columns
    doc, txt, pos, removed = free_names(names, "__ld_doc", "__ld_txt", "__ld_pos", "__ld_removed")
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(txt, F.xxhash64("text"))
    # written tables: texts are cut into lines once, and joins on hot keys stand right above exchanges that can be split
    anchors = cut(keyed.where(F.col(doc).isNotNull() & F.col("text").isNotNull()).select(F.col(doc).alias("doc"), F.col(txt).alias("txt"), "text").mapInArrow(
        _anchors(min_lines, single_words), f"fp long, doc long, txt long, own {OWN}"
    ))
    again = cut(anchors.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    windows = cut(anchors.join(again, "fp", "left_semi").select("doc", "txt", F.explode("own").alias("o")).select("doc", "txt", "o.*"))
    first = cut(windows.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("times")).where("times > 1").select("key", "first"))
    later = (
        windows.join(first, "key")
        .where("doc > first or again")  # rows that share a doc_id but not the text have no order
        .groupBy("doc", "txt").agg(F.collect_set(F.struct("pos", "n")).alias(pos))
        .withColumnsRenamed({"doc": doc, "txt": txt})
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, T.LongType())])
    return keyed.join(later, [doc, txt], "left").select(*names, pos).mapInArrow(_delete(names, pos, removed), schema)


def op6(spark, sf_dir: str) -> DataFrame:
    # OP6_SQL defines the query's runs: two lines or more
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), single_words=None)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__ld_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), n AS (
  SELECT doc_id, i, line, CASE WHEN trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') <> ''
    THEN trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') END AS t FROM l
), f AS (
  SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos,
         lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM n WHERE t IS NOT NULL
), w AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, pos) AS occurrence FROM f WHERE t2 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, p AS pos FROM (SELECT doc_id, unnest([pos, pos + 1]) AS p FROM w WHERE occurrence > 1)
), kept AS (
  SELECT n.doc_id, n.i, n.line, gone.pos IS NOT NULL AS cut
  FROM n LEFT JOIN f ON n.doc_id = f.doc_id AND n.i = f.i LEFT JOIN gone ON f.doc_id = gone.doc_id AND f.pos = gone.pos
), g AS (
  SELECT doc_id, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS t
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.t, d.text, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
