"""Personal data by bootstrapped contextual extraction (operator 13).

Base findings are of four kinds, each leftmost and non-overlapping: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits
that pass Luhn's test) and ``phone`` (with a plus sign, 9 to 15 digits). They are the seeds. Strings of a looser form of a kind (an
address with (at) and (dot), numbers with colons or of another range, a card number that fails the test, a phone number
without plus sign) say little alone: they are candidates.

A mention's lexical patterns are the one, two and three words before it and the two words behind it, if no more than four bytes
lie between. Mentions and patterns make a graph, an edge for each (kind, pattern, value) with its number of mentions,
combined before the shuffle. Rounds score it: a pattern's confidence is the share of all places of its words in the corpus
that known identifiers of the kind follow (or precede), if at least three different ones do; a value's score is one less
the product of what its patterns leave (noisy or). Values of ``accept`` or more are known in the next round and raise
further patterns, until none is added. Mentions of known values are reported beside the base findings.

Where it runs: one pass over the texts writes a row a document with its mentions, no text. Only patterns that could ever decide
(three values, one of them a candidate) are counted over the corpus: their numbers are broadcast in parts of at most
``part_patterns``, a pass a part; corpora without such patterns have no second pass. Scoring joins numbers only.

Defined results: null and empty texts have no findings; a null doc_id is passed through; repeated rows are judged one by
one, and copies weigh as they are many, while support counts different values; a string that two kinds would report is of
the kind with the higher score, then the first; candidates that overlap a base finding are none; an empty table gives an
empty one; other columns are not read. Patterns are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Words, cut, slices

KINDS = ("email", "ip", "card", "phone")
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits begins a match at its first digit or not at all, so that no text is searched twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"@| ?[(\[] ?(?i:at) ?[)\]] ?")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?(?i:dot) ?[)\]] ?)[A-Za-z0-9-]+)*")
_LOOSE = {
    1: re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:[.-][0-9]{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"),
    2: re.compile(r"(?<![0-9A-Za-z+])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9A-Za-z])"),
    3: re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _addresses(text: str, anchor: re.Pattern, host: re.Pattern) -> list[tuple[int, int]]:
    found, last = [], 0
    at = anchor.search(text)
    while at:
        start = at.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = host.match(text, at.end()) if start < at.start() else None
        if end:
            found.append((start, end.end()))
        last = end.end() if end else last
        at = anchor.search(text, end.end() if end else at.end())
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) of the base findings, by kind and start, in code points."""
    out = [(0, *x) for x in _addresses(text, re.compile("@"), _DOMAIN)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings of the looser forms that overlap no base finding, like ``base``."""
    digit = _DIGIT.search(text)
    found = [(0, *x) for x in _addresses(text, _AT, _HOST)] if "@" in text or _AT.search(text) else []
    if digit:
        found += [(k, *m.span()) for k, p in _LOOSE.items() for m in p.finditer(text)]
    if not found or not base:
        return found
    # base findings of different kinds may overlap: of those that start before a place the one that ends last decides
    order = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in order])
    ends = np.maximum.accumulate(np.array([e for _, e in order]))
    before = np.searchsorted(starts, [e for _, _, e in found])
    return [x for x, b in zip(found, before.tolist()) if not b or ends[b - 1] <= x[1]]


def value_of(rank: int, string: str) -> str:
    """The identifier that a mention gives: digits of cards and phones, others in lower case."""
    return re.sub(r"[^0-9]", "", string) if rank > 1 else string.lower()


def _places(text: str, at: list[int]) -> list[int]:
    """Byte places of code points."""
    if text.isascii():
        return at
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate(([0], np.cumsum(size)))[at].tolist()


#: Patterns: (words, whether they stand before the mention).
SIDES = ((1, True), (2, True), (3, True), (2, False))
_BEHIND = np.uint64(0x5DEECE66D1234567)
GAP = 4
#: Bytes of text that a task works on at a time; a longer text is a part of its own.
PART = 4 << 20


def _ids(words: Words) -> list[np.ndarray]:
    """Pattern numbers of each kind of pattern by its first word, zero where the document ends before."""
    out = []
    for n, before in SIDES:
        h, good = words.grams(n)
        out.append(np.where(good, h if before else h ^ _BEHIND, np.uint64(0)))
    return out


SCANNED = "row long, doc_id long, base array<struct<rank:int,start:int,end:int>>, mentions array<struct<rank:int,start:int,end:int,value:string,seed:boolean,patterns:array<struct<id:bigint,words:string>>>>"
_SPAN = [("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
_PATTERNS = pa.list_(pa.struct([("id", pa.int64()), ("words", pa.string())]))


def _scan(batches):
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in slices(batch, PART):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            mentions = [[(*x, True) for x in b] + [(*x, False) for x in candidates(t, b)] for t, b in zip(texts, base)]
            some = [i for i, m in enumerate(mentions) if m]
            words = Words([texts[i].encode() for i in some], LETTERS, lower=True)
            ids = _ids(words)
            out: list[list] = [[] for _ in texts]
            for k, i in enumerate(some):
                first, last, origin = int(words.first[k]), int(words.first[k + 1]), int(words.bounds[k])
                starts, ends = words.start[first:last], words.end[first:last]
                at = _places(texts[i], [p for _, s, e, _ in mentions[i] for p in (s, e)])
                for (rank, s, e, seed), a, b in zip(mentions[i], at[0::2], at[1::2]):
                    left = first + int(np.searchsorted(ends, a + origin, "right"))
                    right = first + int(np.searchsorted(starts, b + origin))
                    patterns = []
                    for (n, before), numbers in zip(SIDES, ids):
                        p = left - n if before else right
                        gap = a + origin - words.end[left - 1] if before and left > first else words.start[right] - b - origin if not before and right < last else GAP + 1
                        if first <= p <= last - n and gap <= GAP:
                            patterns.append({"id": int(numbers[p].view(np.int64)), "words": ("" if before else "… ") + words.joined(p, p + n).decode() + (" …" if before else "")})
                    out[i].append({"rank": rank, "start": s, "end": e, "value": value_of(rank, texts[i][s:e]), "seed": seed, "patterns": patterns})
            spans = [[{"rank": r, "start": s, "end": e} for r, s, e in b] for b in base]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + len(texts)), pa.int64()), part.column("doc_id"), pa.array(spans, pa.list_(pa.struct(_SPAN))),
                pa.array(out, pa.list_(pa.struct([*_SPAN, ("value", pa.string()), ("seed", pa.bool_()), ("patterns", _PATTERNS)]))),
            ], names=["row", "doc_id", "base", "mentions"])
            row += len(texts)


def _count(shared):
    def run(batches):
        wanted = shared.value
        for batch in batches:
            for part in slices(batch, PART):
                words = Words([(t or "").encode() for t in part.column("text").to_pylist()], LETTERS, lower=True)
                places = np.concatenate(_ids(words))
                at = np.minimum(np.searchsorted(wanted, places), len(wanted) - 1)
                n = np.bincount(at[wanted[at] == places], minlength=len(wanted))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(n[seen])], names=["id", "total"])

    return run


def pattern_totals(docs: DataFrame, ids: DataFrame, part_patterns: int = 4_000_000) -> DataFrame:
    """(id, total): how often the words of each pattern of ``ids`` (id) stand in the texts of ``docs``."""
    ids = cut(ids.select("id").distinct())
    parts = -(-ids.count() // part_patterns)
    out = docs.sparkSession.createDataFrame([], "id long, total long")
    for part in range(parts):
        own = ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow().column("id").to_numpy()
        if not len(own):
            continue
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(own.view(np.uint64)))
        out = out.unionByName(cut(docs.select("text").mapInArrow(_count(shared), "id long, total long").groupBy("id").agg(F.sum("total").alias("total"))))
        shared.destroy()
    return out


def score(graph: DataFrame, totals: DataFrame, support: int = 3, confidence: float = 0.5, accept: float = 0.8, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(known values (rank, value, score), patterns (rank, id, words, confidence)) of the graph (rank, id, value, n, seed, words)."""
    graph = cut(graph.join(totals, "id"))
    known, patterns, size = cut(graph.where("seed").select("rank", "value").distinct().withColumn("score", F.lit(1.0))), None, -1
    for _ in range(rounds):
        here = graph.join(known, ["rank", "value"])
        stated = here.groupBy("rank", "id").agg(F.min("words").alias("words"), F.count("*").alias("values"), (F.sum(F.col("n") * F.col("score")) / F.min("total")).alias("confidence"))
        patterns = cut(stated.where((F.col("values") >= support) & (F.col("confidence") >= confidence)).withColumn("confidence", F.least("confidence", F.lit(1 - 1e-6))))
        left = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        scores = graph.where("not seed").join(patterns.select("rank", "id", "confidence"), ["rank", "id"]).groupBy("rank", "value").agg((1 - left).alias("score"))
        seeds = graph.where("seed").select("rank", "value").distinct()
        found = scores.where(F.col("score") >= accept).join(seeds, ["rank", "value"], "left_anti")
        known = cut(seeds.withColumn("score", F.lit(1.0)).unionByName(found))
        before, size = size, known.count()
        if size == before:
            break
    return known, patterns


def find_pii(docs: DataFrame, support: int = 3, confidence: float = 0.5, accept: float = 0.8, part_patterns: int = 4_000_000) -> DataFrame:
    """(doc_id, base, spans) of ``docs`` (doc_id, text): base findings, and these with the discovered ones, as arrays of structs
    (rank, start, end), rank being a place in KINDS, in this order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = cut(docs.mapInArrow(_scan, SCANNED))
    mentions = scanned.where(F.size("mentions") > 0).select("row", F.inline("mentions"))
    edges = mentions.select("rank", "value", "seed", F.explode("patterns").alias("p")).groupBy("rank", F.col("p.id").alias("id"), "value").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed"), F.min("p.words").alias("words"))
    edges = cut(edges)
    # a pattern decides on a candidate only if it has one, and values enough
    able = edges.groupBy("rank", "id").agg(F.count("*").alias("values"), F.bool_or(~F.col("seed")).alias("open")).where((F.col("values") >= support) & F.col("open"))
    graph = cut(edges.join(able.select("rank", "id"), ["rank", "id"], "left_semi"))
    seeds = mentions.where("seed").select("rank", "value").distinct()
    known = seeds.withColumn("score", F.lit(1.0))
    if not graph.isEmpty():
        more, _ = score(graph, pattern_totals(docs, graph, part_patterns), support, confidence, accept)
        known = known.unionByName(more).groupBy("rank", "value").agg(F.max("score").alias("score"))
    more = mentions.where("not seed").join(known, ["rank", "value"])
    # of one string that several kinds would report, the best
    more = more.groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("rank")).alias("order"))).alias("m"))
    more = more.select("row", F.struct((-F.col("m.order")).cast("int").alias("rank"), "start", "end").alias("s")).groupBy("row").agg(F.collect_list("s").alias("more"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return scanned.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(n, range(len(KINDS))), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
