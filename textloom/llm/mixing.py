"""Mixing sources to target weights by pivotal dependent rounding (operator 9, DataFrame functions only).

Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words; a target stops at
``most`` times its source's words, and the excess is shared again by weight. A document of a source is to be taken
target / source_size times: that number's whole part is certain, and the fraction is rounded so that the source's words
keep their sum. Two documents with fractional copies meet; a random choice moves words from one to the other (in
proportion, so that each keeps its expectation) until one of them is whole. Documents meet within small groups; each group
is left with one fractional document at most, and those meet on the next level of a tree whose levels shrink by the
group's size. Large documents meet first, so that the one that stays open is small. The last document of a source is
rounded to its nearer end. A hot source is as many small groups as it needs.

All random choices are hashes of the seed and of the rows; equal rows are numbered by their count. So reruns agree, however the
input's rows are split over files and tasks. Sources are summed in parallel to one row each; those rows are ranked in one task.

Defined results: a null text counts 0 words and is taken 0 times; a null source is a source of its own; rows with null
or repeated doc_ids are rounded one by one; an empty table gives an empty result; of the documents, doc_id, text and
source are read, and other columns are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut

GROUP = 32
REPEATS = 1 << 16  # copies of one row that a task writes out at most
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    With r = most * size / weight, the sources that stop at their limit are the smallest r: the level at which the rest of
    the words is shared is found from running sums in the order of r.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    s = sizes.select("source", "source_size", weight.alias("weight")).withColumn("limit", limit).withColumn("r", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("r", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("all"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("done"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left"),
    )
    level = (F.col("all") * F.lit(float(share)) - F.col("done")) / F.col("left")
    s = s.withColumn("level", level).withColumn("free", F.col("r") > F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct("r", "level"))).over(everything)["level"]
    shared = s.withColumn("shared", level)
    return shared.select("source", "source_size", F.least(F.coalesce(F.col("weight") * F.col("shared"), F.col("limit")), F.col("limit")).alias("target"))


def _unit(*cols) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


DOC = "struct<size:bigint,row:bigint,mass:double,doc_id:bigint,whole:bigint,source_size:bigint,target:double>"


def _doc(d: Column, mass: Column) -> Column:
    return F.struct(d["size"].alias("size"), d["row"].alias("row"), mass.alias("mass"), *(d[c].alias(c) for c in ("doc_id", "whole", "source_size", "target")))


def _meet(items: Column, seed: Column) -> Column:
    """Fold of a group: each step leaves one of two documents whole. Gives the settled documents and the open one.

    Of a document's ``size`` words, ``mass`` are taken; it is whole at 0 and at its size.
    """

    def step(acc, x):
        o = acc["open"]
        # the most words that can move to the open document, and from it, until one of the two is whole
        up = F.least(o["size"] - o["mass"], x["mass"])
        down = F.least(o["mass"], x["size"] - x["mass"])
        rose = _unit(seed, o["row"], x["row"]) * (up + down) < down
        open_whole = F.when(rose, up >= o["size"] - o["mass"]).otherwise(down >= o["mass"])
        # a whole document's mass is set to its bound, so that no rounding error stays
        settled = F.when(open_whole, _doc(o, F.when(rose, o["size"].cast("double")).otherwise(F.lit(0.0)))).otherwise(
            _doc(x, F.when(rose, F.lit(0.0)).otherwise(x["size"].cast("double")))
        )
        rest = F.when(open_whole, _doc(x, F.when(rose, x["mass"] - up).otherwise(x["mass"] + down))).otherwise(
            _doc(o, F.when(rose, o["mass"] + up).otherwise(o["mass"] - down))
        )
        met = F.struct(F.concat(acc["done"], F.array(settled.cast(DOC))).alias("done"), rest.cast(DOC).alias("open"))
        return F.when(o.isNull(), F.struct(acc["done"].alias("done"), x.cast(DOC).alias("open"))).otherwise(met)

    start = F.expr(f"struct(cast(array() as array<{DOC}>) as done, cast(null as {DOC}) as open)")
    return F.aggregate(items, start, step)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how many whole copies of each document the mix takes."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        F.xxhash64("doc_id", "text", "source").alias("row"),
    )
    # equal rows are counted and numbered, so that they too spread over the groups, however the input is split
    alike = cut(slim.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n")))
    span = lambda a, b: F.explode(F.sequence(a, b))
    many = alike.where("n > 1").withColumn("part", span(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))).repartition("row", "part")
    first = F.col("part") * REPEATS
    many = many.withColumn("again", span(first, F.least(F.col("n"), first + REPEATS) - 1))
    many = many.withColumn("row", F.when(F.col("again") > 0, F.xxhash64("row", "again")).otherwise(F.col("row")))
    slim = cut(alike.where("n = 1").drop("n").unionByName(many.drop("n", "part", "again")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    of = targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = slim.join(of, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("whole", F.floor(ratio).cast("long"))
    joined = cut(joined.withColumn("mass", (ratio - F.col("whole")) * F.col("size")).drop("of"))
    open_, fields = (F.col("mass") > 0) & (F.col("size") > 0), ("doc_id", "size", "source_size", "target", "whole", "mass")
    done = [joined.where(~open_).select("source", *fields)]
    level = joined.where(open_).select("source", F.struct("size", "row", "mass", "doc_id", "whole", "source_size", "target").alias("d"))
    number, depth = max(1, joined.count()), 0
    while True:
        groups = -(-number // GROUP)
        name = F.pmod(F.xxhash64("d.row", F.lit(seed), F.lit(depth)), F.lit(groups))
        gathered = level.groupBy("source", name.alias("g")).agg(F.sort_array(F.collect_list("d"), asc=False).alias("items"))
        met = cut(gathered.select("source", _meet(F.col("items"), F.xxhash64(F.lit(seed), F.lit(depth), F.col("g"))).alias("m")))
        done.append(met.select("source", F.explode("m.done").alias("d")).select("source", *(f"d.{c}" for c in fields)))
        level = met.where("m.open is not null").select("source", F.col("m.open").alias("d"))
        if groups == 1:
            break
        number, depth = groups, depth + 1
    mass = F.when(F.col("d.mass") * 2 >= F.col("d.size"), F.col("d.size").cast("double")).otherwise(F.lit(0.0))
    done.append(level.select("source", *(f"d.{c}" for c in fields[:-1]), mass.alias("mass")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + ((F.col("mass") > 0) & (F.col("size") > 0)).cast("long")
    return out.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"))


def op9(spark, sf_dir: str) -> DataFrame:
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
