"""Near-duplicate groups by HyperMinHash (operator 8).

A document's set holds its distinct shingles of ``shingle`` words (lower-cased A-Z); with fewer words, the whole sequence.
One 64-bit hash a shingle chooses one of 256 buckets by its top bits; a bucket keeps the smallest rest, as the count of its
leading zeros and ten mantissa bits (16 bits). Empty buckets borrow from buckets that a fixed random order names.

1. Documents with equal sets form a class, which its smallest doc_id stands for: copies cost no pairs.
2. Bands of registers are hashed; representatives with an equal band share a bucket. Each member of a bucket is paired
   with two members, the smallest doc_id and a random one, never with all. The register estimate, corrected for
   registers that are equal by chance, drops pairs that are far below the threshold (six standard deviations).
3. Pairs are verified on the full sets: first each document's best pair, then those pairs whose ends are still apart.
4. Buckets whose members are still in different components give the remaining pairs across components. Of buckets of up to
   ``LISTED`` members they are listed, by ids. The members of larger ones, families of texts that are alike but below the
   threshold, meet by their rarest shingles instead: with shingles in one order (by counters: those of a single component first,
   then the rarest), two sets at the threshold share one of the first n - o + 1 shingles of each, o being the overlap that their
   sizes ask for, and the one they share lets o be reached. Sizes are dealt into classes, so that this count is exact to a few
   percent and is part of the join's key. Texts that differ from all others in their own rare shingles so meet none of them.
   Pairs are then estimated and verified as before. No link between different texts that share a band is lost, and members
   that are already together are not compared.

The number of registers a band has is the largest with which a pair at the threshold is missed with probability of at
most 1e-6.

Defined results: null texts and texts without words have an empty set and stand alone; repeated rows of a doc_id are one
document with the links of all its texts; rows with a null doc_id have no component and are kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Words, components, cut, grams, joined_groups, slices, texts_of

BUCKETS = 256
LISTED = 16
COUNTERS = 1 << 20  # of shingles, for their order in step 4: 8 MiB a task
CLASS = 1.03  # ratio of the largest to the smallest size of a class
USED = 252  # a multiple of many band widths
MANTISSA = 10
_PROBES = np.array([np.random.default_rng(7 + i).permutation(BUCKETS) for i in range(BUCKETS)], dtype=np.uint8)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h, ok = w.grams(shingle)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(h[a : b - shingle + 1]))
        elif b > a:
            out.append(grams(w.hash[a:b], np.zeros(b - a, np.int64), b - a)[0][:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(values: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty sorted set of hashes."""
    bucket = (values >> np.uint64(56)).astype(np.int64)
    first = np.searchsorted(bucket, np.arange(BUCKETS))
    full = np.zeros(BUCKETS, bool)
    full[bucket] = True
    rest = (values[np.minimum(first, len(values) - 1)] << np.uint64(8)) | np.uint64(255)
    # leading zeros of the rest, and the bits behind its first one
    zeros = 63 - np.floor(np.log2((rest >> np.uint64(1)).astype(np.float64) * 2 + 1)).astype(np.int64)
    zeros = np.clip(zeros, 0, 53)
    mantissa = (rest << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    reg = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _PROBES[empty]
        reg[empty] = reg[order[np.arange(len(empty)), np.argmax(full[order], axis=1)]]
    return reg.astype(np.uint16)


def _sketch(shingle: int):
    def run(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch):
                n, hi, lo, regs = [], [], [], []
                for s in shingle_sets(texts_of(part.column("text")), shingle):
                    n.append(len(s))
                    if len(s):
                        d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                        hi.append(int(d[0]))
                        lo.append(int(d[1]))
                        regs.append(registers(s)[:USED].tobytes())
                    else:
                        hi.append(None)
                        lo.append(None)
                        regs.append(None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n", "hi", "lo", "regs"])

    return run


def _estimate(threshold: float):
    """Keeps the pairs whose estimated similarity is not clearly below the threshold."""
    chance = 1 / (3 << MANTISSA)  # two different minima of sets alike in size: zeros agree with 1/3, mantissas with 2**-10
    least = threshold - 6 * (threshold * (1 - threshold) / USED) ** 0.5

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column("ra").to_pylist()), np.uint16).reshape(-1, USED)
            b = np.frombuffer(b"".join(batch.column("rb").to_pylist()), np.uint16).reshape(-1, USED)
            j = ((a == b).mean(axis=1) - chance) / (1 - chance)
            keep = pa.array(j >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j)], names=["a", "b", "j"]).filter(keep)

    return run


def _confirm(shingle: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            # a text that many pairs share is cut into shingles once a batch
            texts = batch.column("ta").to_pylist() + batch.column("tb").to_pylist()
            names = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            sets = shingle_sets([t.encode() for t in names], shingle)
            linked = []
            for x, y in zip(texts[: batch.num_rows], texts[batch.num_rows :]):
                p, q = sets[names[x]], sets[names[y]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(den * both >= num * (len(p) + len(q) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [pa.array(x.view(np.int64)) for x in shingle_sets(texts_of(part.column("text")), shingle)]
                ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                values = pa.concat_arrays(sets) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("txt"), part.column("c"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["rep", "txt", "c", "tokens"])

    return run


def _counters(batches):
    """A task's counters of shingles (k, df, lo and hi component), combined before they leave it."""
    df, lo, hi = np.zeros(COUNTERS, np.int64), np.full(COUNTERS, 1 << 62), np.full(COUNTERS, -1 << 62)
    for batch in batches:
        k = batch.column("tokens").flatten().to_numpy() & (COUNTERS - 1)
        c = np.repeat(batch.column("c").to_numpy(), batch.column("tokens").value_lengths().to_numpy())
        np.add.at(df, k, 1)
        np.minimum.at(lo, k, c)
        np.maximum.at(hi, k, c)
    used = np.flatnonzero(df)
    for i in range(0, len(used), 1 << 16):
        k = used[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k]), pa.array(lo[k]), pa.array(hi[k])], names=["k", "df", "lo", "hi"])


def _prefixes(order, num: int, den: int):
    """The first shingles of each set, as many as an overlap with the smallest partner can ask for; ``order`` ranks counters."""
    t = num / den

    def run(batches):
        ranks = order.value
        for batch in batches:
            rare = []
            for n, tokens in zip(batch.column("n").to_pylist(), batch.column("tokens")):
                x = np.asarray(tokens.values)
                need = math.ceil((n + math.ceil(n * t - 1e-9)) * (t / (1 + t)) - 1e-9)
                rare.append(pa.array(x[np.lexsort((x, ranks[x & (COUNTERS - 1)]))[: n - need + 1]]))
            ends = np.r_[0, np.cumsum([len(x) for x in rare])].astype(np.int32)
            values = pa.concat_arrays(rare) if rare else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("c"), batch.column("n"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["rep", "c", "n", "rare"])

    return run


def crowd_pairs(crowd: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b) of texts (rep, c, text) in different components c that may reach the threshold: the prefix join of step 4.

    Shingles are ordered by ``COUNTERS`` counters, an array of that many numbers however large the input: counters that one
    component alone has go first, then small ones, ties by the shingle. Any order gives exact results; a good one few rows.
    """
    t = num / den
    spark = crowd.sparkSession
    sets = cut(crowd.withColumn("txt", F.xxhash64("text")).select("rep", "txt", "c", "text").mapInArrow(_sets(shingle), "rep long, txt long, c long, tokens array<long>"))
    sets = sets.where("size(tokens) > 0").select("rep", "c", F.size("tokens").cast("long").alias("n"), "tokens")
    counted = sets.select("c", "tokens").mapInArrow(_counters, "k long, df long, lo long, hi long")
    counted = counted.groupBy("k").agg(F.sum("df").alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    counts = counted.select("k", F.when(F.col("lo") < F.col("hi"), F.col("df")).otherwise(0).alias("rank")).toArrow()
    ranks = np.zeros(COUNTERS, np.int64)
    ranks[counts.column("k").to_numpy()] = counts.column("rank").to_numpy()
    order = spark.sparkContext.broadcast(ranks)
    each = cut(sets.mapInArrow(_prefixes(order, num, den), "rep long, c long, n long, rare array<long>").select("rep", "c", "n", F.posexplode("rare").alias("pos", "token")))
    # a shingle that stands in the prefixes of one component only brings no two together
    shared = each.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    ranked = each.join(shared, "token", "left_semi")
    group = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS)))
    n, pos = F.col("n"), F.col("pos")
    # the set of the smaller class waits under its own class, with the shingles that a partner as large can ask for; the other
    # looks it up in those classes where its shingle waits for another component, of the sizes that the shingle's place leaves
    # possible: n - pos must reach the overlap
    smallest = F.greatest(F.floor(F.pow(F.lit(CLASS), F.col("own"))), F.ceil(n * t - 1e-9))
    first = n - F.ceil((n + smallest) * (t / (1 + t)) - 1e-9) + 1
    least, largest = F.ceil(n * t - 1e-9), F.floor((n - pos) * ((1 + t) / t) - n + 1e-6)
    placed = cut(ranked.withColumn("own", group(n)))
    x = placed.where(pos < first)
    waiting = x.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.collect_set("own").alias("waits"))
    asked = placed.where(largest >= least).join(waiting, "token").where("lo <> c or hi <> c")
    possible = F.filter("waits", lambda o: o.between(group(least), F.least("own", group(largest))))
    x, y = x.alias("x"), asked.select("rep", "c", "n", "own", "pos", "token", F.explode(possible).alias("other")).alias("y")
    overlap = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.own") == F.col("y.other"))
               & (F.col("x.c") != F.col("y.c")) & ((F.col("x.own") < F.col("y.own")) | (F.col("x.rep") < F.col("y.rep")))
               & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num) & (overlap >= (F.col("x.n") + F.col("y.n")) * (t / (1 + t)) - 1e-6))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).where("a < b").distinct()
    )


def band_width(threshold: float, miss: float = 1e-6) -> int:
    """Registers a band: the most with which a pair at the threshold shares no band with probability of at most ``miss``."""
    return max(r for r in range(1, 17) if (1 - threshold**r) ** (USED // r) <= miss or r == 1)


def near_duplicates(docs: DataFrame, shingle: int = 5, similar: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links are den * |intersection| >= num * |union|, for ``similar`` = (num, den)."""
    num, den = similar
    width = band_width(num / den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = cut(docs.mapInArrow(_sketch(shingle), "doc_id long, n long, hi long, lo long, regs binary"))
    full = sketches.where("n > 0 and doc_id is not null")
    classes = full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = cut(classes)
    of = cut(full.select("doc_id", "hi", "lo").join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select("doc_id", "rep").distinct())
    # a doc_id with several texts links the classes of all of them
    several = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a")
    several = of.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")

    bands = USED // width
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(i, F.substring(F.col("regs"), i * F.lit(2 * width) + 1, F.lit(2 * width))).alias("band")))
    in_band = classes.select("rep", "n", F.explode(keys).alias("k")).select("rep", "n", "k.band", "k.i")
    # a bucket's two centres: its smallest member, and a random one; bands take turns with four random orders
    shared = in_band.groupBy("band").agg(
        F.min(F.struct("rep", "n")).alias("c1"), F.min(F.struct(F.xxhash64("rep", F.col("i") % 4).alias("o"), "rep", "n")).alias("c2"), F.max("rep").alias("top")
    ).where("c1.rep < top").select("band", F.array("c1", F.struct("c2.rep", "c2.n")).alias("centres"))
    members = cut(in_band.select("rep", "n", "band").join(shared, "band"))
    stars = members.select("rep", "n", F.explode("centres").alias("c")).where(f"rep <> c.rep and least(n, c.n) * {den} >= greatest(n, c.n) * {num}")
    stars = cut(stars.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct())
    texts = cut(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    def estimated(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("rep").alias(x), F.col("regs").alias(f"r{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb").mapInArrow(_estimate(num / den), "a long, b long, j double")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
        joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        return joined.mapInArrow(_confirm(shingle, num, den), "a long, b long").distinct()

    def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        side = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return joined.where("not coalesce(ca, a) <=> coalesce(cb, b)").select(*pairs.columns)

    candidates = cut(estimated(stars))
    best = candidates.groupBy("b").agg(F.max(F.struct("j", F.negative("a").alias("a"))).alias("m")).select(F.negative("m.a").alias("a"), "b")
    groups = cut(components(confirmed(best).unionByName(several)))
    groups = joined_groups(groups, confirmed(apart(candidates, groups)))

    # what is left: pairs of a bucket that are in different components and have not been looked at
    labelled = cut(members.select("band", "rep", "n").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c")))
    open_ = labelled.groupBy("band").agg(F.min("c").alias("lo_c"), F.max("c").alias("hi_c"), F.count("*").alias("size")).where("lo_c < hi_c")
    rows = cut(labelled.join(open_.select("band", (F.col("size") > LISTED).alias("large")), "band"))
    x, y = rows.where("not large").alias("x"), rows.where("not large").alias("y")
    listed = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c"))
                    & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    crowd = rows.where("large").select("rep", "c").distinct()
    rest = listed
    if not crowd.isEmpty():
        rest = listed.unionByName(crowd_pairs(texts.withColumnRenamed("doc_id", "rep").join(crowd, "rep"), shingle, num, den))
    groups = joined_groups(groups, confirmed(cut(estimated(rest.distinct().join(stars, ["a", "b"], "left_anti")))))
    names = of.join(groups, of["rep"] == groups["id"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sketches.join(names, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, similar=(85, 100))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g HAVING count(*) > 1),
o AS (SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(df, 1), s.g) AS r FROM s LEFT JOIN f ON s.g = f.g),
x AS (SELECT o.doc_id, o.g, n.n FROM o JOIN n ON o.doc_id = n.doc_id JOIN f ON o.g = f.g WHERE o.r <= n.n - ceil(0.85 * n.n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
e AS (SELECT c.a, c.b FROM c JOIN s u ON u.doc_id = c.a JOIN s v ON v.doc_id = c.b AND u.g = v.g
      GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 85 * (c.na + c.nb - count(*))),
y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, y.b FROM reach JOIN y ON reach.b = y.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
