"""Deletes along foreign keys, declared constraints as one frame of violations, and writes that become visible together."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.storage import cut


@dataclass(frozen=True)
class Link:
    """A foreign key: ``child.column`` refers to ``parent.key``; ``action`` is cascade, null or restrict."""

    child: str
    column: str
    parent: str
    key: str
    action: str


class Restricted(ValueError):
    """A delete that a restricting link refuses; nothing is deleted."""


def delete_along(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], roots: dict[str, DataFrame], rounds: int = 1000) -> dict[str, DataFrame]:
    """``tables`` after deleting the rows whose keys ``roots`` (table: frame of its key) name, and what follows from it.

    Rows behind a cascading link go in rounds, each from the rows that the last one took, until a round takes none; so links
    may form cycles. Then a row that stays and refers to one that went refuses everything (restrict, ``Restricted``) or loses
    its reference (null). Null references refer to nothing. A round's frontier is a written table of keys.
    """
    unique = lambda df, name: df.select(F.col(keys[name]).alias("k")).where("k is not null").distinct()
    gone = {name: cut(unique(df, name)) for name, df in roots.items()}
    fresh = dict(gone)
    by = lambda link, taken: taken[link.parent].withColumnRenamed("k", link.column)

    def parents(link: Link, taken: dict[str, DataFrame]) -> DataFrame:
        if link.key == keys[link.parent]:
            return by(link, taken)
        rows = tables[link.parent].join(taken[link.parent].withColumnRenamed("k", keys[link.parent]), keys[link.parent], "left_semi")
        return rows.select(F.col(link.key).alias(link.column)).distinct()

    for _ in range(rounds):
        following: dict[str, DataFrame] = {}
        for link in links:
            if link.action == "cascade" and link.parent in fresh:
                own = unique(tables[link.child].join(parents(link, fresh), link.column, "left_semi"), link.child)
                following[link.child] = following[link.child].unionByName(own) if link.child in following else own
        fresh = {}
        for name, df in following.items():
            new = cut((df.join(gone[name], "k", "left_anti") if name in gone else df).distinct())
            if not new.isEmpty():
                fresh[name] = new
                gone[name] = cut(gone[name].unionByName(new)) if name in gone else new
        if not fresh:
            break
    else:
        raise RuntimeError(f"deletes not settled after {rounds} rounds")
    out = {name: df.join(gone[name].withColumnRenamed("k", keys[name]), keys[name], "left_anti").select(df.columns) if name in gone else df for name, df in tables.items()}
    for link in links:
        if link.parent in gone and link.action == "restrict":
            if not out[link.child].join(parents(link, gone), link.column, "left_semi").isEmpty():
                raise Restricted(f"{link.child}.{link.column} refers to deleted rows of {link.parent}")
    for link in links:
        if link.parent in gone and link.action == "null":
            df = out[link.child]
            lost = parents(link, gone).withColumn("_lost", F.lit(True))
            columns = [F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c == link.column else F.col(c) for c in df.columns]
            out[link.child] = df.join(lost, link.column, "left").select(columns)
    return out


@dataclass(frozen=True)
class Constraint:
    """``kind`` of a table's rule: ``unique`` (columns), ``single`` (at most one row a group of columns where the condition holds),
    ``reference`` (columns[0] is in parent.columns), ``distribution`` (counts by columns[0] are those expected) or ``check``
    (the condition holds)."""

    kind: str
    table: str
    columns: tuple[str, ...] = ()
    condition: str = "true"
    parent: tuple[str, str] | None = None
    expected: dict[str, int] = field(default_factory=dict, hash=False)


def violations(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """(kind, table, columns, value, n): a row for each value that breaks a constraint, with its number of rows.

    Values are JSON of the constraint's columns. Keys with a null are not compared, as in SQL. Unique and single constraints are
    aggregates that combine before the shuffle, references anti-joins of distinct values.
    """
    out = None
    for c in constraints:
        df = tables[c.table].where(F.expr(c.condition)) if c.kind == "single" else tables[c.table]
        names = list(c.columns)
        value = F.to_json(F.struct(*names)) if names else F.lit("{}")
        whole = F.lit(True)
        for name in names:
            whole = whole & F.col(name).isNotNull()
        if c.kind in ("unique", "single"):
            bad = df.where(whole).groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(value.alias("value"), "n")
        elif c.kind == "reference":
            parent = tables[c.parent[0]].select(F.col(c.parent[1]).alias(names[0])).distinct()
            bad = df.where(whole).groupBy(*names).agg(F.count("*").alias("n")).join(parent, names[0], "left_anti").select(value.alias("value"), "n")
        elif c.kind == "distribution":
            want = df.sparkSession.createDataFrame(list(c.expected.items()) or [("", 0)], "k string, want long").where("want > 0")
            have = df.groupBy(F.col(names[0]).cast("string").alias("k")).agg(F.count("*").alias("n"))
            both = have.join(want, have["k"].eqNullSafe(want["k"]), "full_outer")
            off = ~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("want", F.lit(0)))
            bad = both.where(off).select(F.to_json(F.struct(F.coalesce(have["k"], want["k"]).alias(names[0]))).alias("value"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        else:
            bad = df.where(~F.coalesce(F.expr(c.condition), F.lit(False))).groupBy(*names).agg(F.count("*").alias("n")).select(value.alias("value"), "n")
        bad = bad.select(F.lit(c.kind).alias("kind"), F.lit(c.table).alias("table"), F.lit(",".join(names)).alias("columns"), "value", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


POINTER = "current.json"


def publish(folder: str, write: dict[str, Callable[[], DataFrame] | DataFrame]) -> str:
    """Writes several tables under a new version of ``folder`` and then, in one rename, points readers to all of them.

    A writer that fails before the rename leaves readers with the version before; its files are no version's. Tables that are
    not named keep the files of the version before."""
    spark = SparkSession.active()
    version = uuid.uuid4().hex
    files = dict(_pointer(spark, folder))
    for name, df in write.items():
        path = f"{folder}/{version}/{name}"
        (df() if callable(df) else df).write.parquet(path)
        files[name] = path
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(f"{folder}/{POINTER}"), hadoop.Path(f"{folder}/{version}.json")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(files).encode()))
    stream.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    option[0] = spark._jvm.java.lang.Enum.valueOf(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    context.rename(draft, target, option)
    return version


def _pointer(spark: SparkSession, folder: str) -> dict[str, str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/{POINTER}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return json.loads("".join(r.value for r in spark.read.text(path.toString()).collect()))


def published(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the version that is published now."""
    return {name: spark.read.parquet(path) for name, path in _pointer(spark, folder).items()}
