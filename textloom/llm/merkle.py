"""Merkle dataset manifest as a tree of SHA-256 midstates (operator 11).

A document's leaf is the digest of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and value. The leaves of a
language are in order of doc_id; while there are several nodes, every eight in a row become their parent, the digest of
their hexadecimal digests. The languages' roots, in order of their names, become the dataset's root in the same way.

A child's 64 hexadecimal characters are just one block of SHA-256. So the hash state before child slot k of a parent is 32 bytes
after k whole blocks, and a parent's row retains a copy of the state before each of its children. Folding a leaf that has
another digest now resumes the state of its slot with the replacement and the right siblings only, parent by parent up to
the root; left siblings are never hashed again. States are rows of a table like digests, so that folding works on a manifest
that was written long ago and elsewhere; the compression runs in numpy, a lane for each node of a task.

Where it runs: leaves are dealt by ranges of (language, doc_id) and numbered in their range; counts of earlier ranges make the
numbers whole. A task takes the 4,096 leaves below a node four levels up, so a language's size is no task's size, and a
round of four levels leaves 1/4096 of the nodes. Paths (state, siblings) go down the same rounds, one row a chunk.

Defined results: null columns count as ``-``; a null language is one, before all others; rows with a null doc_id stand
before others and, like rows that share a doc_id, in order of their digests; rows that are equal have places of their own;
a lone leaf is its language's root; without siblings a proof is the digest of nothing; an empty table gives no rows, and
its root is None; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, partitions

FAN = 8
#: Levels that one task builds or folds; a chunk is the FAN ** LEVELS nodes below one node.
LEVELS = 4
CHUNK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: The standard's constants by their rule: fractions of the square and cube roots of the first primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Last block of a message of n whole blocks.
_PAD = np.zeros((FAN + 1, 64), np.uint8)
_PAD[:, 0] = 0x80
for _n in range(FAN + 1):
    _PAD[_n, 56:] = np.frombuffer((_n * 512).to_bytes(8, "big"), np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block (n, 64 bytes) each."""
    w = list(np.ascontiguousarray(block).view(">u4").astype(np.uint32).T)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state.T
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h), axis=1)


def hexed(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) as hexadecimal text (n, 64 bytes): one block each."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, 0::2], out[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return out


def _digests(state: np.ndarray) -> np.ndarray:
    return state.astype(">u4").view(np.uint8).reshape(-1, 32)


def _states(data: np.ndarray) -> np.ndarray:
    """States (n, 8) from their bytes (n, 32)."""
    return np.ascontiguousarray(data).view(">u4").astype(np.uint32)


def parents(children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of every eight of ``children`` (n, 32 bytes) and the states before each slot (parents, 8 slots, 32 bytes)."""
    n = len(children)
    many = -(-n // FAN)
    state, kept = np.tile(START, (many, 1)), np.zeros((many, FAN, 32), np.uint8)
    for slot in range(FAN):
        own = children[slot::FAN]
        kept[: len(own), slot] = _digests(state[: len(own)])
        state[: len(own)] = compress(state[: len(own)], hexed(own))
    sizes = np.full(many, FAN)
    sizes[-1] = n - FAN * (many - 1)
    return _digests(compress(state, _PAD[sizes])), kept


def _column(values, kind: pa.DataType = pa.binary()) -> pa.Array:
    return pa.array(values, kind)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


NODE = "tree string, chunk long, level int, pos long, digest binary, states binary, levels int"


def _build(table: pa.Table) -> pa.Table:
    """Nodes above one chunk: up to four levels, fewer where the tree ends."""
    table = table.sort_by("pos")
    tree, chunk, depth, levels = (table.column(c)[0].as_py() for c in ("tree", "chunk", "depth", "levels"))
    digests, first = _matrix(table.column("digest")), chunk * CHUNK
    out: dict[str, list] = {"level": [], "pos": [], "digest": [], "states": []}
    for level in range(depth + 1, min(depth + LEVELS, levels) + 1):
        children = len(digests)
        digests, kept = parents(digests)
        first //= FAN
        for i, (d, s) in enumerate(zip(digests, kept)):
            out["level"].append(level)
            out["pos"].append(first + i)
            out["digest"].append(d.tobytes())
            out["states"].append(s[: min(FAN, children - FAN * i)].tobytes())
    n = len(out["pos"])
    return pa.table([
        _column([tree] * n, pa.string()), _column([chunk] * n, pa.int64()), _column(out["level"], pa.int32()), _column(out["pos"], pa.int64()),
        _column(out["digest"]), _column(out["states"]), _column([levels] * n, pa.int32()),
    ], names=["tree", "chunk", "level", "pos", "digest", "states", "levels"])


class Chunk:
    """A chunk's rows as arrays: digests by level, states of each level's parents, and the path above."""

    def __init__(self, table: pa.Table):
        part = lambda k: table.filter(pc.equal(table.column("kind"), k)).sort_by([("level", "ascending"), ("pos", "ascending")])
        self.base, nodes, above = part(0), part(1), part(2)
        self.tree = above.column("tree")[0].as_py()
        self.subroot = above.column("digest")[0].as_py()
        self.path = above.column("path")[0].as_py()
        self.digests, self.states = [_matrix(self.base.column("digest"))], []
        level = nodes.column("level").to_numpy()
        for x in np.unique(level):
            own = nodes.filter(pa.array(level == x))
            self.digests.append(_matrix(own.column("digest")))
            kept = np.zeros((own.num_rows, FAN, 32), np.uint8)
            for i, s in enumerate(own.column("states").to_pylist()):
                kept[i, : len(s) // 32] = np.frombuffer(s, np.uint8).reshape(-1, 32)
            self.states.append(kept)

    def lanes(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parent, slot and number of the parent's children of each base node's ancestor at ``level``."""
        at = np.arange(len(self.digests[0])) // FAN**level
        return at // FAN, at % FAN, np.minimum(FAN, len(self.digests[level]) - at // FAN * FAN)

    def siblings(self, level: int) -> list[bytes]:
        """The others of the run of each base node's ancestor at ``level``, left to right, in hexadecimal."""
        text = hexed(self.digests[level]).tobytes()
        own = lambda p, s, n: text[p * 512 : p * 512 + s * 64] + text[p * 512 + s * 64 + 64 : p * 512 + n * 64]
        return [own(*x) for x in zip(*(a.tolist() for a in self.lanes(level)))]


def _paths(table: pa.Table) -> pa.Table:
    """The path above each base node: that of the chunk with the levels inside it before it."""
    c = Chunk(table)
    steps = []
    for level, kept in enumerate(c.states):
        state = kept[tuple(c.lanes(level)[:2])]
        steps.append([bytes((s, n)) + x.tobytes() + y for s, n, x, y in zip(*(a.tolist() for a in c.lanes(level)[1:]), state, c.siblings(level))])
    n = c.base.num_rows
    paths = [[step[i] for step in steps] + c.path for i in range(n)]
    return pa.table([_column([c.tree] * n, pa.string()), c.base.column("pos"), _column(paths, pa.list_(pa.binary())), _column([c.subroot] * n)], names=["tree", "pos", "path", "subroot"])


def _resume(state: np.ndarray, now: np.ndarray, right: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> np.ndarray:
    """Digests of the parents whose states before a slot are given, with ``now`` in that slot, then ``right`` siblings (lanes, blocks)."""
    state = compress(state, hexed(now))
    for lanes, blocks in right:
        state[lanes] = compress(state[lanes], blocks)
    return _digests(compress(state, _PAD[sizes]))


FOLD = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, tree string"


def _fold(table: pa.Table) -> pa.Table:
    """Each leaf's proof, and the root that its present digest gives with the manifest's states and right siblings."""
    c = Chunk(table)
    now = _matrix(c.base.column("now"))
    proofs = [[] for _ in now]
    for level, kept in enumerate(c.states):
        parent, slot, n = c.lanes(level)
        right = []
        for k in range(1, FAN):
            lanes = np.flatnonzero((slot < k) & (k < n))
            right.append((lanes, hexed(c.digests[level][parent[lanes] * FAN + k])))
        now = _resume(_states(kept[parent, slot]), now, right, n)
        for proof, x in zip(proofs, c.siblings(level)):
            proof.append(x)
    above = b""
    for step in c.path:
        slot, n, state, others = step[0], step[1], np.frombuffer(step[2:34], np.uint8), step[34:]
        right = [(slice(None), np.tile(np.frombuffer(others[k * 64 : k * 64 + 64], np.uint8), (len(now), 1))) for k in range(slot, n - 1)]
        now = _resume(np.tile(_states(state[None]), (len(now), 1)), now, right, np.full(len(now), n))
        above += others
    proof = [hashlib.sha256(b"".join(p) + above).hexdigest() for p in proofs]
    return pa.table([
        c.base.column("doc_id"), _column([d.tobytes().hex() for d in c.digests[0]], pa.string()), _column([c.subroot.hex()] * len(now), pa.string()),
        _column(proof, pa.string()), _column([d.tobytes().hex() for d in now], pa.string()), _column([c.tree] * len(now), pa.string()),
    ], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "tree"])


def _number(batches):
    """Numbers sorted rows within their tree and partition."""
    part, last, n = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        at = []
        for tree in batch.column("tree").to_pylist():
            last, n = (last, n + 1) if last == (tree,) else ((tree,), 0)
            at.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, _column([part] * len(at), pa.int32()), _column(at, pa.int64())], names=[*batch.schema.names, "part", "at"])


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` (tree, ...) with ``pos``, a row's place in its tree by ``order`` from 0, and ``levels``, the levels above the tree's leaves.

    Rows are dealt by ranges; rows that are equal in all of ``order`` are dealt by a number of their own, so that a third of
    equal rows is no single range. Ranges are numbered each for itself, and the counts of those before are added."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(partitions(df.sparkSession), "tree", *order, "_salt")
    rows = cut(dealt.drop("_salt").sortWithinPartitions("tree", *order).mapInArrow(_number, f"{schema}, part int, at long"))
    sizes = rows.groupBy("tree", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = sum((F.sum("n").over(own) > FAN**k).cast("int") for k in range(21))
    sizes = sizes.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), before.alias("_before"), levels.alias("levels"))
    on = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part"))
    return cut(rows.join(sizes, on).withColumn("pos", F.col("at") + F.col("_before")).drop("_tree", "_part", "_before", "part", "at"))


@dataclass
class Trees:
    """Placed leaves, the nodes of each round of four levels, and each tree's root."""

    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame) -> Trees:
    """The trees over placed ``leaves`` (tree, pos, digest, levels)."""
    most = leaves.agg(F.max("levels")).first()[0] or 0
    base, rounds = leaves.select("tree", "pos", "digest", "levels"), []
    roots = base.where("levels = 0").select("tree", "digest", "levels")
    for depth in range(0, most, LEVELS):
        open_ = base.where(F.col("levels") > depth).withColumn("chunk", F.floor(F.col("pos") / CHUNK)).withColumn("depth", F.lit(depth))
        made = cut(open_.groupBy("tree", "chunk").applyInArrow(_build, NODE))
        rounds.append(made)
        roots = roots.unionByName(made.where("level = levels").select("tree", "digest", "levels"))
        base = made.where(F.col("level") == depth + LEVELS).select("tree", "pos", "digest", "levels")
    return Trees(leaves, rounds, roots)


def _chunks(base: DataFrame, nodes: DataFrame | None, above: DataFrame) -> DataFrame:
    """Rows of a round's chunks in one table: base nodes (kind 0), the nodes above them (1) and the chunk's path (2)."""
    blank = {"level": "int", "pos": "long", "digest": "binary", "states": "binary", "now": "binary", "doc_id": "long", "path": "array<binary>"}

    def side(df: DataFrame, kind: int) -> DataFrame:
        own = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
        return df.select("tree", "chunk", F.lit(kind).alias("kind"), *own)

    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    rows = side(base.select("*", chunk), 0).unionByName(side(above, 2))
    return rows if nodes is None else rows.unionByName(side(nodes, 1))


def _descend(trees: Trees, above: DataFrame) -> DataFrame:
    """Chunks of the leaves' round, each with its path; ``above`` (tree, path, subroot) has the path above each tree."""
    ends = trees.roots.select("tree", "levels").withColumn("last", F.greatest(F.ceil(F.col("levels") / LEVELS) - 1, F.lit(0))).alias("e")
    start = cut(ends.join(above.alias("a"), F.col("e.tree").eqNullSafe(F.col("a.tree"))).select("e.tree", "last", F.lit(0).cast("long").alias("chunk"), "path", F.col("subroot").alias("digest")))
    paths = None
    for r in range(max(len(trees.rounds) - 1, 0), -1, -1):
        own = start.where(F.col("last") == r).drop("last")
        if paths is not None:
            own = own.unionByName(paths.select("tree", F.col("pos").alias("chunk"), "path", F.col("subroot").alias("digest")))
        if r == 0:
            return _chunks(trees.leaves, trees.rounds[0] if trees.rounds else None, own)
        base = trees.rounds[r - 1].where(F.col("level") == r * LEVELS).where(F.col("levels") > r * LEVELS).select("tree", "pos", "digest")
        paths = cut(_chunks(base, trees.rounds[r], own).groupBy("tree", "chunk").applyInArrow(_paths, "tree string, pos long, path array<binary>, subroot binary"))


@dataclass
class Manifest:
    """The trees of the languages, the tree over their roots, and the dataset's root (None for an empty dataset)."""

    trees: Trees
    top: Trees
    root: bytes | None


def leaf_digests(docs: DataFrame, text: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> Column:
    """A row's leaf digest, 32 bytes; ``text`` stands for the text column."""
    value = lambda c: (text if c == "text" and text is not None else F.col(c)).cast("string")
    fields = [F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def build_manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (tree, doc_id, digest, and ``now``, the digest to hold against it)."""
    trees = grow(placed(leaves, "doc_id", "digest"))
    roots = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = grow(placed(roots, "name"))
    last = top.roots.first()
    return Manifest(trees, top, bytes(last["digest"]) if last else None)


def verify(manifest: Manifest) -> DataFrame:
    """(tree, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf of the manifest, digests in hexadecimal."""
    top = manifest.top
    above = top.roots.select("tree", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("subroot"))
    chunks = _descend(top, above).groupBy("tree", "chunk")
    names = top.leaves.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
    paths = chunks.applyInArrow(_paths, "tree string, pos long, path array<binary>, subroot binary").select("pos", "path")
    folded = _descend(manifest.trees, cut(names.join(paths, "pos").drop("pos"))).groupBy("tree", "chunk").applyInArrow(_fold, FOLD)
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    return folded.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    upper = "".join(chr(c) for c in range(65, 91))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    now = F.when(tampered, leaf_digests(docs, F.translate("text", upper, upper.lower())))
    leaves = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digests(docs).alias("digest"), now.alias("now"))
    leaves = cut(leaves.withColumn("now", F.coalesce("now", "digest")))
    return verify(build_manifest(leaves)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_CRC = """
  SELECT doc_id AS id, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
"""


def _leaf_sql(text: str) -> str:
    value = {c: f"{text if c == 'text' else c}::VARCHAR" for c in COLUMNS}
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in value.values()) + ")"


OP11_SQL = f"""
WITH RECURSIVE crc AS ({_CRC}), d AS (
  SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
         CASE WHEN xor(crc.c, 4294967295::UBIGINT) % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents LEFT JOIN crc ON doc_id = id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t FROM d
), nodes AS (
  SELECT t, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM ranked
  UNION ALL
  SELECT t, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY t, level, i // 8, n
), tops AS (
  SELECT t - 1 AS i, 0 AS level, h, count(*) OVER () AS n FROM (SELECT t, h FROM nodes WHERE n = 1)
  UNION ALL
  SELECT i // 8, level + 1, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, i // 8, n
), tree AS (
  SELECT t, level, i, h, n FROM nodes UNION ALL SELECT 0, level, i, h, n FROM tops
), steps AS (
  SELECT DISTINCT t, level, n FROM tree WHERE n > 1
), fold AS (
  SELECT t AS tree_of, t, i AS leaf_at, i AS at, 0 AS level, coalesce(changed, leaf) AS h, '' AS proof FROM ranked
  UNION ALL
  SELECT * FROM (
    WITH go AS (
      SELECT f.tree_of, f.leaf_at, f.h, f.proof, s.t IS NULL AS up, f.t, f.at, f.level
      FROM fold f LEFT JOIN steps s ON s.t = f.t AND s.level = f.level WHERE f.t > 0 OR s.t IS NOT NULL
    )
    SELECT tree_of, 0, leaf_at, (t - 1)::BIGINT, 0, h, proof FROM go WHERE up
    UNION ALL
    SELECT go.tree_of, go.t, go.leaf_at, go.at // 8, go.level + 1,
           sha256(string_agg(CASE WHEN x.i = go.at THEN go.h ELSE x.h END, '' ORDER BY x.i)),
           go.proof || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> go.at), '')
    FROM go JOIN tree x ON x.t = go.t AND x.level = go.level AND x.i // 8 = go.at // 8 WHERE NOT up
    GROUP BY go.tree_of, go.t, go.leaf_at, go.at, go.level, go.h, go.proof
  )
), top AS (SELECT h FROM tops WHERE n = 1), done AS (
  SELECT tree_of, leaf_at, h, proof FROM (SELECT *, row_number() OVER (PARTITION BY tree_of, leaf_at ORDER BY t, level DESC) AS r FROM fold) WHERE r = 1
)
SELECT r.doc_id, r.leaf, s.h AS subroot, top.h AS root, sha256(done.proof) AS proof_sha256, done.h AS folded_root, done.h = top.h AS verified
FROM ranked r JOIN done ON done.tree_of = r.t AND done.leaf_at = r.i JOIN nodes s ON s.t = r.t AND s.n = 1, top
"""
