"""Pairs of texts whose character n-grams overlap, counted by matrix products where one side is small."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.points import gram_sets, row_slices

#: Rows of the small side in a block, of the large side in a bucket (all scopes) and in a product, n-grams in a product.
BLOCK, BUCKET, ROWS, WIDTH = 1024, 32768, 1024, 8192
CHARS = 1 << 20  # of the large side in a product, unless one text is longer
DENSE = 8 * BLOCK  # rows of a small side: beyond, each text would be compared with too many


def dice(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 2.0 * common / total


def jaccard(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return common / (total - common)


def _padded(words: pa.Array) -> pa.Array:
    """Words joined by a space as words with two spaces before and one behind each, on lines; no word stays none."""
    lines = pc.binary_join_element_wise("  ", pc.replace_substring(words, " ", " \n  "), " ", "")
    return pc.if_else(pc.equal(words, ""), "", lines)


def _common(left: tuple[np.ndarray, np.ndarray], n: int, right: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """How many codes rows of both sides share, as a product of 0/1 matrices, some n-grams at a time."""
    names = np.unique(right[1])
    place = np.searchsorted(names, left[1])
    known = names[np.minimum(place, len(names) - 1)] == left[1]
    (lrow, lplace), (rrow, rplace) = (left[0][known], place[known]), (right[0], np.searchsorted(names, right[1]))
    out = np.zeros((n, m), np.float32)
    for lo in range(0, len(names), WIDTH):
        width = min(WIDTH, len(names) - lo)
        sides = []
        for rows, places, size in ((lrow, lplace, n), (rrow, rplace, m)):
            here = (places >= lo) & (places < lo + width)
            side = np.zeros((size, width), np.float32)
            side[rows[here], places[here] - lo] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def near_pairs(left: DataFrame, right: DataFrame, size: int, words: bool, measure: Callable, least: float, most: int | None = None, buckets: int = 1, blocks: int = 1) -> DataFrame:
    """(lid, rid, similarity) of all pairs of ``left`` (lid, scope, text) and ``right`` (rid, scope, text) of one scope with a
    similarity of ``least`` or more of their distinct runs of ``size`` characters; with ``words``, of those inside words with two
    spaces before and one behind, the text being words joined by a space. With ``most``, of each lid and block those that are
    among its ``most`` nearest, ties with the last included. Texts without such runs give no pair.

    Both sides are dealt by (scope, bucket of the left, block of the right): a group's overlaps are products of 0/1 matrices
    of bounded size. The right side is copied to each bucket, so it is the small one.
    """
    dealt = left.withColumn("bucket", F.pmod(F.xxhash64("lid"), F.lit(buckets))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copied = right.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    schema = StructType().add("lid", left.schema["lid"].dataType).add("rid", right.schema["rid"].dataType).add("similarity", "double")

    def group(ls: pa.Table, rs: pa.Table) -> pa.Table:
        ls, rs = ls.combine_chunks(), rs.combine_chunks()
        rows, lids, rids, sims = [], ls.column("lid"), rs.column("rid"), []
        if ls.num_rows and rs.num_rows:
            sets = lambda texts: gram_sets(_padded(texts), size, "\n") if words else gram_sets(texts, size)
            rsets = sets(rs.column("text").combine_chunks())
            rn = np.bincount(rsets[0], minlength=rs.num_rows)
            texts = ls.column("text").combine_chunks()
            for lo, hi in row_slices(texts, ROWS, CHARS) if len(rsets[0]) else []:
                lsets = sets(texts.slice(lo, hi - lo))
                ln = np.bincount(lsets[0], minlength=hi - lo)
                common = _common(lsets, hi - lo, rsets, rs.num_rows).astype(np.float64)
                # rows without n-grams share none; a total of 1 keeps the quotient defined
                similar = measure(common, np.maximum(ln[:, None] + rn[None, :], 1))
                if most is not None and most < rs.num_rows:
                    last = np.partition(similar, rs.num_rows - most, axis=1)[:, rs.num_rows - most]
                    i, j = np.nonzero((common > 0) & (similar >= least) & (similar >= last[:, None]))
                else:
                    i, j = np.nonzero((common > 0) & (similar >= least))
                rows.append((i + lo, j))
                sims.append(similar[i, j])
        i, j = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"lid": lids.take(pa.array(i)), "rid": rids.take(pa.array(j)), "similarity": pa.array(np.concatenate(sims) if sims else np.zeros(0))})

    by = ["scope", "bucket", "block"]
    return dealt.groupBy(*by).cogroup(copied.groupBy(*by)).applyInArrow(group, schema)
