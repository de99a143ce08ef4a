"""Substring dedup by prefix-partitioned suffix trees (operator 2).

A repeat is a run of ``window`` words or more. Suffixes start at words; a sparse set of them is enough: each window of words
holds one anchor, the leftmost smallest hash among the ``prefix``-word grams in it, which depends on the window's words alone, so
two copies of a window have their anchor at the same place. The suffixes from the anchors on are the ones that are sorted.

1. *Prefix counts.* A suffix's prefix is its first ``prefix`` words, the anchor. A prefix that one document alone has leads to
   no repeat and needs no subtree; for the others, buckets of documents count their distinct fragments (an anchor with the
   words of all windows that hold it), as wholes and under each longer prefix.
2. *Variable-length prefixes.* The suffixes under a prefix go to one subtree. A prefix with more than ``group_rows`` fragments
   is lengthened word by word until the suffixes under each longer prefix fit (each bucket is granted its share of the group, so
   that their sum fits); a window that ends before the longer prefix does is a prefix by itself, its whole words.
3. *Subtrees.* The suffixes of a group are sorted and their longest common prefixes give the LCP intervals, the internal nodes
   of the suffix tree with their depths; the words before the anchors, reversed, give a second tree. A node of depth
   ``window - l`` in the first and one of depth l in the second are together a repeat of ``window`` words with l words before
   the anchor; the smallest doc_id among the suffixes under both says which occurrences are later ones. A prefix that has grown
   to a whole window is one node: its smallest doc_id is a minimum by key, combined before the shuffle, so that a passage of
   very many documents costs one row a bucket and never a group.
4. *Removal.* Smallest doc_ids go back to the buckets, which mark the words of later occurrences.

Words and fragments are compared by content inside a subtree; whole-window prefixes by 128 bits of hash.

Defined results: a null text has no words; rows with a null doc_id keep all their words and are no source for others;
rows that repeat a doc_id are one document (a repeat needs a *smaller* doc_id); texts shorter than the window keep all;
an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Words, _powers, cut, mix, numbered, partitions, texts_of

BUCKET_BYTES = 4 << 20
GROUP_ROWS = 2_000
SHAPE = 1 << 10  # a fragment's windows * SHAPE + words before its anchor
_OTHER_STEP = np.uint64(0xA0761D6478BD642F)


class _Fragments:
    """The anchors of a bucket's texts, and the run of window starts that each anchor owns."""

    def __init__(self, texts: list[bytes], window: int, prefix: int):
        self.words = w = Words(texts)
        self.window = window
        self.fp = self.key = np.zeros(0, np.uint64)
        self.row = self.first = self.count = self.anchor = np.zeros(0, np.int64)
        if not len(w.hash):
            return
        gram, _ = w.grams(prefix)
        n = len(gram) - window + 1
        if n <= 0:
            return
        best, arg = gram[:n].copy(), np.arange(n)
        for k in range(1, window - prefix + 1):
            less = gram[k : k + n] < best
            best[less] = gram[k : k + n][less]
            arg[less] = np.flatnonzero(less) + k
        p = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
        if not len(p):
            return
        a = arg[p]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        self.first, self.count, self.anchor = p[new], np.diff(np.r_[new, len(p)]), a[new]
        self.fp, self.row = best[self.first], w.row[self.first]
        self.up, self.down = _powers(len(w.hash) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hash * self.up[: len(w.hash)])))
        self.key = self.span(self.first, self.first + self.count + window - 1)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words a..b-1."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def whole(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that start at p."""
        h, other = self.words.hash, np.zeros(len(p), np.uint64)
        for k in range(self.window):
            other = other * _OTHER_STEP + h[p + k]
        return self.span(p, p + self.window), mix(other)

    def cut_to(self, level: np.ndarray) -> np.ndarray:
        """First window start of each fragment that reaches as far as a prefix of ``level`` words; it and those behind do."""
        return np.clip(self.anchor + level - self.window, self.first, self.first + self.count)


def _ids(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, doc_ids (0 for null) and whether a doc_id is there; texts without a doc_id count as empty here."""
    ids = table.column("doc_id").cast(pa.int64())
    known = ~np.asarray(ids.is_null())
    return texts_of(table.column("text")), np.asarray(ids.fill_null(0)), known


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _prefix_counts(window: int, prefix: int):
    kinds = pa.schema([("fp", pa.int64()), ("frags", pa.int32()), ("many", pa.bool_()), ("longer", pa.list_(pa.int32())), ("bucket", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        texts, ids, known = _ids(table)
        f = _Fragments([t if k else b"" for t, k in zip(texts, known)], window, prefix)
        if not len(f.fp):
            return kinds.empty_table()
        order = np.lexsort((f.key, f.fp))
        fp, key, doc = f.fp[order], f.key[order], ids[f.row[order]]
        at = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
        fresh = np.r_[True, (fp[1:] != fp[:-1]) | (key[1:] != key[:-1])]
        frags = np.add.reduceat(fresh.astype(np.int64), at)
        many = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        # the most fragments under each longer prefix, where there is more than one fragment
        longer = np.ones((len(at), window - prefix - 1), np.int32)
        owner = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(fp)]))
        some = np.flatnonzero(fresh & (frags[owner] > 1))
        a, own, n = f.anchor[order][some], owner[some], len(f.words.hash)
        for k in range(prefix + 1, window):
            gram = f.span(a, np.minimum(a + k, n)) if len(a) else np.zeros(0, np.uint64)
            sort = np.lexsort((gram, own))
            g, o = gram[sort], own[sort]
            edge = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])]) if len(g) else np.zeros(0, np.int64)
            np.maximum.at(longer[:, k - prefix - 1], o[edge], np.diff(np.r_[edge, len(g)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(frags > 1, longer.shape[1], 0))].astype(np.int32)), pa.array(longer[frags > 1].ravel()))
        return pa.table([_signed(fp[at]), pa.array(frags.astype(np.int32)), pa.array(many), lists, pa.array(np.full(len(at), bucket))], schema=kinds)

    return run


def _least_most(sort: np.ndarray, keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key: a row that has it, its smallest and largest doc_id; ``sort`` brings equal keys together."""
    change = np.zeros(len(sort), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[sort][1:] != k[sort][:-1]
    at = np.flatnonzero(change)
    return sort[at], np.minimum.reduceat(doc[sort], at), np.maximum.reduceat(doc[sort], at)


def _with_levels(table: pa.Table, shared: pa.Table, window: int, prefix: int) -> tuple[_Fragments, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket's fragments, its doc_ids, the fragments with a prefix in ``shared``, and the length of each one's prefix."""
    texts, ids, known = _ids(table)
    f = _Fragments([t if k else b"" for t, k in zip(texts, known)], window, prefix)
    fps = np.asarray(shared.column("fp")).view(np.uint64)
    order = np.argsort(fps)
    at = np.minimum(np.searchsorted(fps[order], f.fp), len(fps) - 1)
    take = np.flatnonzero(fps[order][at] == f.fp)
    level = np.full(len(f.fp), prefix, np.int64)
    level[take] = np.asarray(shared.column("level"))[order][at[take]]
    return f, ids, take, level


def _fragments(window: int, prefix: int):
    """What goes to the subtrees (``other`` is null), and the windows that end before their lengthened prefix.

    Equal ones of a bucket travel once, with their smallest and largest doc_id.
    """
    kinds = pa.schema([
        ("part", pa.int64()), ("other", pa.int64()), ("bucket", pa.int64()), ("key", pa.int64()), ("frag", pa.binary()), ("shape", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
    ])

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows or not shared.num_rows:
            return kinds.empty_table()
        bucket = table.column("bucket")[0].as_py()
        f, ids, take, level = _with_levels(table, shared, window, prefix)
        start, end, w = f.cut_to(level), f.first + f.count, f.words
        out = [kinds.empty_table()]
        own = take[(start < end)[take]]
        if len(own):
            some, low, high = _least_most(np.argsort(f.key[own], kind="stable"), [f.key[own]], ids[f.row[own]])
            i = own[some]
            frags = [w.data[a:b] for a, b in zip(w.start[start[i]].tolist(), w.end[end[i] + window - 2].tolist())]
            part = f.fp[i].copy()
            deep = np.flatnonzero(level[i] > prefix)
            part[deep] = f.span(f.anchor[i[deep]], f.anchor[i[deep]] + level[i[deep]])
            shape = (end[i] - start[i]) * SHAPE + f.anchor[i] - start[i]
            out.append(pa.table([
                _signed(part), pa.nulls(len(i), pa.int64()), pa.array(np.full(len(i), bucket)), _signed(f.key[i]), pa.array(frags, pa.binary()), pa.array(shape.astype(np.int32)),
                pa.array(low), pa.array(high),
            ], schema=kinds))
        p = _ranges(f.first[take], (start - f.first)[take])
        if len(p):
            key, other = f.whole(p)
            some, low, high = _least_most(np.lexsort((other, key)), [key, other], ids[w.row[p]])
            n = len(some)
            out.append(pa.table([
                _signed(key[some]), _signed(other[some]), pa.array(np.full(n, bucket)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(low), pa.array(high),
            ], schema=kinds))
        return pa.concat_tables(out)

    return run


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., n[i] numbers each."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class SuffixTree:
    """The suffix tree of token rows, group by group: sorted leaves, and the LCP intervals that are its internal nodes.

    ``order`` are the leaves, ``lcp`` the tokens that each shares with the one before (-1 at a group's first leaf).
    """

    def __init__(self, group: np.ndarray, tokens: np.ndarray):
        self.order = np.lexsort((*tokens.T[::-1], group))
        t, g = tokens[self.order], group[self.order]
        self.lcp = np.full(len(t), -1, np.int64)
        self.lcp[1:] = np.where(g[1:] == g[:-1], np.cumprod(t[1:] == t[:-1], axis=1).sum(axis=1), -1)

    def node(self, depth: int) -> np.ndarray:
        """For each row, the number of the node (or leaf) in which it lies at this depth."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.lcp < depth)
        return out

    def nodes(self, least: int) -> list[tuple[int, int, int]]:
        """(depth, first leaf, last leaf) of the internal nodes of a depth of at least ``least``: the LCP intervals."""
        out, open_ = [], []
        for i, d in enumerate([*self.lcp.tolist(), -1]):
            first = i - 1
            while open_ and open_[-1][0] > d:
                depth, first = open_.pop()
                out.append((depth, first, i - 1))
            if d >= least and (not open_ or open_[-1][0] < d):
                open_.append((d, first))
        return sorted(out, key=lambda x: (x[1], -x[2]))


def repeats(group: np.ndarray, frags: list[bytes], before: np.ndarray, count: np.ndarray, low: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The smallest ``low`` of each window of each fragment, fragments' windows in order.

    A fragment has ``count`` windows; the first starts ``before`` words before the anchor.
    """
    w = Words(frags)
    raw = np.frombuffer(w.data, np.uint8)
    _, token = numbered(raw, w.start, w.end, w.hash)
    first, end = w.first[:-1], w.first[1:]
    anchor = first + before

    def words(step: int, n: int) -> np.ndarray:
        at = anchor[:, None] + (np.arange(n) if step > 0 else -1 - np.arange(n))[None, :]
        inside = (at >= first[:, None]) & (at < end[:, None])
        return np.where(inside, token[np.clip(at, 0, len(token) - 1)], -1)

    right, left = SuffixTree(group, words(1, window)), SuffixTree(group, words(-1, window - prefix))
    begin = np.cumsum(count) - count
    least = np.repeat(low, count)
    for l in range(window - prefix + 1):  # noqa: E741  windows with l words before the anchor
        own = np.flatnonzero((before >= l) & (before - l < count))
        if not len(own):
            continue
        node = right.node(window - l)[own] * (len(group) + 1) + left.node(l)[own]
        order = np.argsort(node, kind="stable")
        sorted_ = node[order]
        at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        smallest = np.minimum.reduceat(low[own][order], at)
        out = np.empty(len(own), np.int64)
        out[order] = np.repeat(smallest, np.diff(np.r_[at, len(own)]))
        least[(begin + before - l)[own]] = out
    return least


def _subtrees(window: int, prefix: int):
    def run(table: pa.Table) -> pa.Table:
        counts, before = np.divmod(np.asarray(table.column("shape")).astype(np.int64), SHAPE)
        low, high = np.asarray(table.column("low")), np.asarray(table.column("high"))
        least = repeats(np.asarray(table.column("part")), table.column("frag").to_pylist(), before, counts, low, window, prefix)
        first = np.cumsum(counts) - counts
        keep = np.flatnonzero(np.minimum.reduceat(least, first) < high)
        return pa.table({
            "bucket": table.column("bucket").take(pa.array(keep)).combine_chunks(),
            "key": table.column("key").take(pa.array(keep)).combine_chunks(),
            "least": pa.array([least[first[i] : first[i] + counts[i]].tobytes() for i in keep], pa.binary()),
        })

    return run


def _remove(window: int, prefix: int):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        if not table.num_rows:
            return schema.empty_table()
        texts, ids, known = _ids(table)
        f = _Fragments([t if k else b"" for t, k in zip(texts, known)], window, prefix)
        w = f.words
        mark = np.zeros(len(w.hash) + 1, np.int64)

        def later(start):
            np.add.at(mark, start, 1)
            np.add.at(mark, start + window, -1)

        if found.num_rows and len(f.key):
            keys = np.asarray(found.column("key")).view(np.uint64)
            other, low = found.column("other").combine_chunks(), np.asarray(found.column("low").fill_null(0))
            whole = ~np.asarray(other.is_null())
            other = np.asarray(other.fill_null(0)).view(np.uint64)
            own = np.flatnonzero(~whole)
            own = own[np.argsort(keys[own])]
            if len(own):
                at = np.minimum(np.searchsorted(keys[own], f.key), len(own) - 1)
                hit = np.flatnonzero(keys[own][at] == f.key)
                least = found.column("least").take(pa.array(own[at[hit]])).to_pylist()  # of a fragment's last windows
                n = np.array([len(v) // 8 for v in least], np.int64)
                start = _ranges((f.first + f.count)[hit] - n, n) if len(hit) else np.zeros(0, np.int64)
                later(start[np.frombuffer(b"".join(least), np.int64) < ids[w.row[start]]])
            own = np.flatnonzero(whole)
            own = own[np.argsort(keys[own], kind="stable")]
            if len(own):  # whole windows as prefixes; those of an equal first hash stand side by side
                p = _ranges(f.first, f.count)
                a, b = f.whole(p)
                at = np.searchsorted(keys[own], a)
                for step in range(int(np.unique(keys[own], return_counts=True)[1].max())):
                    i = own[np.minimum(at + step, len(own) - 1)]
                    later(p[(keys[i] == a) & (other[i] == b) & (low[i] < ids[w.row[p]])])
        gone = np.cumsum(mark[:-1]) > 0
        total, removed, kept = [], [], []
        for r in range(len(texts)):
            if not known[r]:
                own = texts[r].split()
                total.append(len(own))
                removed.append(0)
                kept.append(b" ".join(own))
                continue
            a, b = w.first[r], w.first[r + 1]
            total.append(int(b - a))
            removed.append(int(gone[a:b].sum()))
            kept.append(b" ".join(texts[r].split()) if not removed[-1] else b" ".join(w.text(i) for i in a + np.flatnonzero(~gone[a:b])))
        return pa.table([table.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(total), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, prefix: int = 5, group_rows: int = GROUP_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words of later repeats of ``window`` words or more."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * partitions(spark), -(-size // bucket_bytes))
    base = docs.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(buckets)).alias("bucket"), "doc_id", "text")
    counts = base.groupBy("bucket").applyInArrow(_prefix_counts(window, prefix), "fp long, frags int, many boolean, longer array<int>, bucket long")
    by = Window.partitionBy("fp")
    # a bucket's share of a group, and the shortest prefix whose groups keep to it; ``window`` where none does
    share = F.floor(F.lit(group_rows) / F.col("_in"))
    fits = F.array_position(F.transform(F.coalesce("longer", F.array_repeat(F.lit(1), window - prefix - 1)), lambda n: n <= share), True)
    own = F.when(F.col("frags") <= share, F.lit(prefix)).when(fits > 0, fits + prefix).otherwise(F.lit(window)).cast("int")
    shared = cut(
        counts.select("*", F.count("*").over(by).alias("_in")).where("_in > 1 or many")
        .select("bucket", "fp", F.max(own).over(by).alias("level"))
    )
    pieces = cut(base.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
        _fragments(window, prefix), "part long, other long, bucket long, key long, frag binary, shape int, low long, high long"
    ))
    trees = pieces.where("other is null").groupBy(F.pmod("part", F.lit(buckets)).alias("_group")).applyInArrow(_subtrees(window, prefix), "bucket long, key long, least binary")
    whole = pieces.where("other is not null").select("part", "other", "bucket", "low", "high")
    nodes = whole.groupBy("part", "other").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").drop("last")
    back = whole.join(nodes, ["part", "other"]).where("first < high")
    least = trees.select("*", F.lit(None).cast("long").alias("other"), F.lit(None).cast("long").alias("low")).unionByName(
        back.select("bucket", F.col("part").alias("key"), F.lit(None).cast("binary").alias("least"), "other", F.col("first").alias("low"))
    )
    return base.groupBy("bucket").cogroup(least.groupBy("bucket")).applyInArrow(
        _remove(window, prefix), "doc_id long, n_words long, n_removed long, kept string"
    )


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS q FROM g JOIN m ON g.h = m.h WHERE doc_id > low),
x AS (SELECT doc_id, list(q) AS gone, count(*) AS n FROM r GROUP BY doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS s FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.i = r.q WHERE r.q IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
