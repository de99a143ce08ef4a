"""Relational operators on tasks, memories, terms and users, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import bigram_codes, dice, distinct_words, language_pair_code, norm_text, strip, trigrams
from textloom.operators import dictionary, overlap
from textloom.storage import cut, written_bytes

Pair = tuple[str, str]


def day_rank(df: DataFrame, ts: str, tie: str, name: str = "position") -> DataFrame:
    """Global FIFO rank by (ts, tie): rank inside the day plus the counts of earlier days, so no task sorts everything."""
    df = df.withColumn("_day", F.to_date(ts))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = df.groupBy("_day").agg(F.count("*").alias("_n")).select(F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_day").orderBy(ts, tie))
    return df.withColumn(name, own).join(days, F.col("_day").eqNullSafe(F.col("_d"))).withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_day", "_d", "_before")


def wait_seconds(position: Column, most: Column, running: Column, average: Column) -> Column:
    slots = F.greatest(F.lit(0), most - running)
    return F.when(position <= slots, F.lit(0)).when(average.isNull(), None).otherwise((F.ceil((position - slots) / most) * average).cast("bigint"))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order. Rows of a key meet in one task only after a partial top-1."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], overwrite: list[str], keep_old_if_null: list[str] = (), keep_old: list[str] = ()) -> DataFrame:
    """``base`` with ``batch`` merged on keys: overwritten columns, columns that keep the old value when the new one is
    null, and columns that keep the old value; new keys are inserted. A batch holds a key once."""
    b, n = base.alias("b"), batch.alias("n")
    on = [F.col(f"b.{k}") == F.col(f"n.{k}") for k in keys]
    new = F.col(f"n.{keys[0]}").isNotNull()
    cols = [F.coalesce(f"b.{k}", f"n.{k}").alias(k) for k in keys]
    cols += [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in overwrite]
    cols += [F.coalesce(f"n.{c}", f"b.{c}").alias(c) for c in keep_old_if_null]
    cols += [F.coalesce(f"b.{c}", f"n.{c}").alias(c) for c in keep_old]
    return b.join(n, on, "full_outer").select(*cols)


def _bits(grams: Column) -> Column:
    """Four longs: a set of 256 bits, one or more for each gram's hash."""
    places = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(256)).cast("int"))
    word = lambda k: F.aggregate(F.filter(places, lambda p: F.shiftright(p, 6) == k), F.lit(0).cast("bigint"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p % 64)))
    return F.struct(*(word(k).alias(f"b{k}") for k in range(4)))


def _alone(x: str, y: str) -> Column:
    """A number that the grams of x that are not in y reach at least: bits of x that y lacks."""
    return sum((F.bit_count(F.col(f"{x}.bits.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.bits.b{k}")))) for k in range(4)), F.lit(0))


def element_sets(df: DataFrame, key: str, text: str, grams: Column) -> DataFrame:
    """(id, scope, text, grams, n, bits) of a side of a set join, written once; texts without elements go."""
    scope = F.col("scope") if "scope" in df.columns else F.lit("")
    g = df.select(F.col(key).alias("id"), scope.alias("scope"), F.col(text).alias("text"), grams.alias("grams")).where("size(grams) > 0")
    return cut(g.withColumn("n", F.size("grams")).withColumn("bits", _bits(F.col("grams"))))


def set_pairs(ls: DataFrame, rs: DataFrame, need: float) -> DataFrame:
    """Pairs (lid, rid) of one scope, among them all whose element sets have a Jaccard similarity of at least ``need``.

    Prefix filter: with elements in one order, the rarest of both sides first, a pair shares one of the first |A| - ceil(|A| need)
    + 1 of each side. The join is on those; its condition asks that sizes, the places of the shared element, and 256 hash bits
    of both sets let the threshold be reached, so that hardly a pair leaves it that is not one. A small side's prefixes are
    broadcast by the planner, which knows both written sides' sizes; larger ones are shuffled, hot elements split.
    """
    count = lambda df: df.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    freq = count(ls).unionByName(count(rs)).groupBy("g").agg(F.sum("df").alias("df"))

    def prefixes(df: DataFrame) -> DataFrame:
        ranked = df.select("id", F.explode("grams").alias("g")).join(freq, "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("order"))
        first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * need - 1e-9) + 1).cast("int"))
        return df.select("id", "scope", "n", "bits").join(ranked, "id").select("id", "scope", "n", "bits", F.posexplode(first).alias("pos", "o")).select("id", "scope", "n", "bits", "pos", "o.g")

    x, y = prefixes(ls).alias("x"), prefixes(rs).alias("y")
    overlap = (F.col("x.n") + F.col("y.n")) * (need / (1 + need)) - 1e-6
    near = (
        (F.col("x.g") == F.col("y.g")) & (F.col("x.scope") == F.col("y.scope")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * need - 1e-6)
        & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= overlap)
        & (F.col("x.n") - _alone("x", "y") >= overlap) & (F.col("y.n") - _alone("y", "x") >= overlap)
    )
    return x.join(y, near).select(F.col("x.id").alias("lid"), F.col("y.id").alias("rid")).distinct()


def _with_sets(pairs: DataFrame, ls: DataFrame, rs: DataFrame) -> DataFrame:
    side = lambda df, i, t, g: df.select(F.col("id").alias(i), F.col("text").alias(t), F.col("grams").alias(g))
    return pairs.join(side(rs, "rid", "rtext", "rg"), "rid").join(side(ls, "lid", "ltext", "lg"), "lid")


def _near(left: DataFrame, right: DataFrame, rows: int, words: bool, size: int, measure: Callable, least: float, most: int | None = None) -> DataFrame:
    """``overlap.near_pairs`` of (lid, ltext) and (rid, rtext), the right side written and of so many rows."""
    scope = lambda df: F.col("scope") if "scope" in df.columns else F.lit("")
    text = lambda t: F.array_join(distinct_words(F.col(t)), " ") if words else F.col(t)
    side = lambda df, i, t: df.select(i, scope(df).alias("scope"), text(t).alias("text")).where("text is not null")
    buckets, blocks = -(-left.count() // overlap.BUCKET), -(-rows // overlap.BLOCK)
    return overlap.near_pairs(side(left, "lid", "ltext"), side(right, "rid", "rtext"), size, words, measure, least, most, max(1, buckets), max(1, blocks))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All pairs (lid, rid, similarity) of (lid, ltext) and (rid, rtext) with bigram Dice of at least ``threshold``; where both
    sides have a column ``scope``, those of one scope. Texts without bigrams (blank or of one character) give no pair here.

    A right side of up to ``overlap.DENSE`` rows meets all texts by matrix products, without a row for an n-gram or a candidate
    ever being made; a larger one by the prefix filter of ``set_pairs``."""
    right = cut(right)
    rows = right.count()
    if rows <= overlap.DENSE:
        return _near(left, right, rows, False, 2, overlap.dice, threshold)
    ls, rs = element_sets(left, "lid", "ltext", bigram_codes(F.col("ltext"))), element_sets(right, "rid", "rtext", bigram_codes(F.col("rtext")))
    sim = dice(F.col("ltext"), F.col("rtext"), F.col("lg"), F.col("rg"))
    checked = _with_sets(set_pairs(ls, rs, threshold / (2 - threshold)), ls, rs).withColumn("similarity", sim)
    return checked.where(F.col("similarity") >= threshold).select("lid", "rid", "similarity")


def fuzzy_join(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The ``similar_pairs`` of both sides with their texts: (lid, rid, ltext, rtext, similarity)."""
    found = similar_pairs(left, right, threshold)
    text = lambda df, i, t: df.select(i, t)
    return found.join(text(right, "rid", "rtext"), "rid").join(text(left, "lid", "ltext"), "lid").select("lid", "rid", "ltext", "rtext", "similarity")


def trigram_top(left: DataFrame, right: DataFrame, most: int = 50, least: float = 0.3, steps: tuple[float, ...] = (0.8, 0.6, 0.45)) -> DataFrame:
    """(lid, rank, rid, similarity): for each text of ``left`` (lid, ltext) its ``most`` nearest of ``right`` (rid, rtext) by the
    Jaccard similarity of padded-word trigrams, ``least`` or more, ties to the smaller rid; with ``scope`` on both sides, of one
    scope. Texts without a word have no trigrams and no row.

    A right side of up to ``overlap.DENSE`` rows meets all texts by matrix products. For a larger one the threshold falls by
    ``steps`` and rises a text at a time: a step finds every pair at its threshold, and a text that has
    ``most`` of them is done, for its last place is at the threshold or above and no pair below can take it. Only texts with
    fewer go on to the next step, whose longer prefixes are the costly ones.
    """
    rank = F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("similarity"), "rid"))
    right = cut(right)
    rows = right.count()
    if rows <= overlap.DENSE:
        out = _near(left, right, rows, True, 3, overlap.jaccard, least, most)
        return out.withColumn("rank", rank).where(F.col("rank") <= most).select("lid", "rank", "rid", "similarity")
    ls, rs = element_sets(left, "lid", "ltext", trigrams(F.col("ltext"))), element_sets(right, "rid", "rtext", trigrams(F.col("rtext")))
    common = F.size(F.array_intersect("lg", "rg"))
    either = F.size("lg") + F.size("rg") - common
    parts, open_ = [], ls
    for step in [x for x in steps if x > least] + [least]:
        checked = _with_sets(set_pairs(open_, rs, step), open_, rs).select("lid", "rid", common.alias("common"), either.alias("either"))
        found = checked.where(F.col("common") >= F.col("either") * step - 1e-9)
        if step == least:
            parts.append(found)
            break
        found = cut(found)
        full = found.groupBy("lid").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("lid")
        parts.append(found.join(full, "lid", "left_semi"))
        open_ = cut(open_.join(full, open_["id"] == full["lid"], "left_anti"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = out.withColumn("similarity", F.col("common") / F.col("either"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select("lid", "rank", "rid", "similarity")


def memory_scopes(memory: DataFrame) -> DataFrame:
    """(scope, src, tm_id): the memory by normalised source within each language pair and, for unknown source languages, within
    all pairs of a target (``auto→target``); of equal sources the latest (largest) tm_id. ``memory`` has (tm_id, source_text,
    lang_pair)."""
    any_source = F.concat(F.lit("auto→"), F.split_part("lang_pair", F.lit("→"), F.lit(2)))
    m = memory.select("tm_id", norm_text(F.col("source_text")).alias("src"), F.explode(F.array("lang_pair", any_source)).alias("scope"))
    return m.where("src <> ''").groupBy("scope", "src").agg(F.max("tm_id").alias("tm_id"))


def scope_of(source: Column, target: Column) -> Column:
    """The scope that a request of two language codes looks into."""
    return F.concat(language_pair_code(source), F.lit("→"), language_pair_code(target))


def memory_lookup(segments: DataFrame, memory: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best memory of each distinct (scope, text): exact first, else the most similar one of at least ``threshold``.

    ``segments`` (text, scope), the scope a language pair or ``auto→target``; ``memory`` (tm_id, source_text, lang_pair). Gives
    (scope, key, tm_id, similarity, exact). A memory of another pair is never handed on. Of equal sources the latest (largest)
    tm_id stands; of equally similar sources the first (smallest). Texts of one character have no bigrams and are alike by
    definition: such a segment takes the first memory of one character. No candidate is left out for its number.
    """
    seg = cut(segments.select("scope", norm_text(F.col("text")).alias("key")).where("key <> ''").distinct())
    mem = cut(memory_scopes(memory))
    same = mem.withColumnRenamed("src", "key")
    exact = seg.join(same, ["scope", "key"]).select("scope", "key", "tm_id", F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    rest = seg.join(same, ["scope", "key"], "left_anti")
    # candidate rows carry hashes, not the text
    name = F.struct(F.xxhash64("scope", "key").alias("a"), F.hash("scope", "key").alias("b"))
    scoped = lambda df: df.withColumn("scope", F.xxhash64("scope"))
    rid = F.struct("tm_id", F.xxhash64("scope").alias("s"))
    found = similar_pairs(scoped(rest.select(name.alias("lid"), F.col("key").alias("ltext"), "scope")), scoped(mem.select(rid.alias("rid"), F.col("src").alias("rtext"), "scope")), threshold)
    best = cut(found.groupBy("lid").agg(F.max(F.struct("similarity", F.negative("rid.tm_id").alias("rid"))).alias("m")))
    fuzzy = rest.withColumn("lid", name).join(best, "lid").select("scope", "key", F.negative("m.rid").alias("tm_id"), F.bround("m.similarity", 3).alias("similarity"), F.lit(False).alias("exact"))
    one = mem.where("length(src) = 1").groupBy("scope").agg(F.min("tm_id").alias("tm_id"))
    short = rest.where("length(key) = 1").join(one, "scope").select("scope", "key", "tm_id", F.lit(1.0).alias("similarity"), F.lit(False).alias("exact"))
    return cut(exact.unionByName(fuzzy).unionByName(short))


def glossary_for_pairs(entries: DataFrame, wanted: DataFrame, dictionary: str = "法学") -> DataFrame:
    """Entries (id, source_term, target_term, lang_pair, domain, priority) for each wanted pair of language codes (src, tgt).

    Entries of the pair as they are, those of the reverse pair swapped; the source ``auto`` stands for every language. Entries
    of the ``dictionary`` domain are left out, those without a domain stay. An entry meets pairs by its languages, never all.
    """
    ends = F.split("lang_pair", "→")
    e = entries.where(F.col("domain").isNull() | (F.col("domain") != dictionary)).withColumn("a", ends[0]).withColumn("b", ends[1])
    swap = {"source_term": "target_term", "target_term": "source_term", "a": "b", "b": "a"}
    e = e.unionByName(e.select(*(F.col(swap.get(c, c)).alias(c) for c in e.columns)))
    both = e.withColumn("src", F.explode(F.array(F.col("a"), F.lit("auto")))).withColumn("tgt", F.col("b")).drop("a", "b")
    return both.join(wanted, ["src", "tgt"])


W = r"[\p{L}\p{N}_]"  # characters of words


MARK = "\x01"
TERM_BYTES = 8 << 20  # written bytes of a glossary up to which it is broadcast to the texts


def _marked(text: Column) -> Column:
    """Lower-case text with a mark at both edges of each word: what stands on word boundaries is then a plain substring."""
    return F.regexp_replace(F.translate(F.lower(text), MARK, "\x02"), f"({W}+)", f"{MARK}$1{MARK}")


def glossary_hits(segments: DataFrame, glossary: DataFrame, most: int = 40) -> DataFrame:
    """(seg_id, term, priority, ord) of the glossary's terms in segments (seg_id, text); glossary (term, priority, ord).

    Terms are stripped, and of equal ones the first (smallest ord) stands. An ASCII term of three characters or more is found
    on word boundaries, case-insensitively; another one of two or more wherever its characters stand. A term that is part of
    a longer hit of the segment goes, unless it is strict. Beyond ``most`` hits, strict and then longer terms are kept.

    No segment is compared with all terms, nor with those that begin alike: texts are walked along the terms' prefixes
    (``dictionary``), and the runs of characters that may be terms are joined with the terms. Which terms a term holds is found
    once, among terms, in the same way. A glossary of up to ``TERM_BYTES`` as written is broadcast; for a larger one the runs
    are shuffled. Terms are numbered in the order in which they are kept, so a segment's are an array of numbers.
    """
    bare = strip(F.col("term"))
    ascii_ = F.col("t").rlike(r"^[\x00-\x7F]*$")
    strict = F.col("priority").eqNullSafe("strict")
    terms = glossary.select(bare.alias("t"), "term", "priority", "ord").where(F.col("t") != "").groupBy("t").agg(F.min(F.struct("ord", "term", "priority")).alias("f"))
    terms = terms.where(F.length("t") >= F.when(ascii_, 3).otherwise(2)).select("t", "f.*", F.when(ascii_, "marked").otherwise("text").alias("column"))
    edge = lambda c: F.when(c.rlike(W), "").otherwise(MARK)
    bounded = F.concat(edge(F.left("t", F.lit(1))), _marked(F.col("t")), edge(F.right("t", F.lit(1))))
    terms = terms.withColumn("pattern", F.when(F.col("column") == "marked", bounded).otherwise(F.col("t")))
    terms = cut(terms.orderBy(~strict, F.desc(F.length("term")), "ord", "term", "t").withColumn("no", F.monotonically_increasing_id()))
    # strict terms stay wherever they are held
    inner = terms.where(~strict).select(F.col("t").alias("pattern"), F.col("no").alias("inner"), F.length("t").alias("size"))
    held = dictionary.held_patterns(terms.select("no", "t"), "no", {"t": dictionary.prefixes(terms.where(~strict).select("t"))})
    inside = held.join(inner, "pattern").join(terms.select("no", F.length("t").alias("whole")), "no").where("whole > size")
    holds = inside.groupBy("no").agg(F.collect_set("inner").alias("holds"))
    known = cut(terms.select("column", "pattern", "no").join(holds, "no", "left"))
    tables = {c: dictionary.prefixes(terms.where(F.col("column") == c).select("pattern")) for c in ("text", "marked")}
    text = F.col("text")
    sides = segments.select("seg_id", F.when(text.rlike(r"[^\x00-\x7F]"), text).alias("text"), _marked(text).alias("marked"))
    small = lambda df: F.broadcast(df) if written_bytes(df) <= TERM_BYTES else df
    hits = dictionary.held_patterns(sides, "seg_id", tables).join(small(known), ["column", "pattern"]).select("seg_id", "no", "holds")
    each = hits.groupBy("seg_id").agg(F.collect_set("no").alias("own"), F.flatten(F.collect_list("holds")).alias("held"))
    left = each.select("seg_id", F.explode(F.slice(F.array_sort(F.array_except("own", "held")), 1, most)).alias("no"))
    return left.join(small(terms.select("no", "term", "priority", "ord")), "no").select("seg_id", "term", "priority", "ord")


def pack_chunks(sizes: Column, most: int = 6000, tail: int = 1500) -> Column:
    """Greedy order-preserving packing of sizes: array of (n, size), the number of paragraphs and characters of each chunk.

    A paragraph that does not fit closes the chunk; one larger than ``most`` stands alone if no chunk is open, and a last
    chunk under ``tail`` joins the one before.
    """
    start = F.expr("struct(cast(array() as array<struct<n:bigint,size:bigint>>) as done, cast(0 as bigint) as n, cast(0 as bigint) as size)")

    def step(a, x):
        x = x.cast("bigint")
        one = lambda n, s: F.array(F.struct(n.cast("bigint").alias("n"), s.cast("bigint").alias("size")))
        state = lambda d, n, s: F.struct(d.alias("done"), n.cast("bigint").alias("n"), s.cast("bigint").alias("size"))
        alone = (x > most) & (a["n"] == 0)
        full = (a["n"] > 0) & (a["size"] + x > most)
        return (
            F.when(alone, state(F.concat(a["done"], one(F.lit(1), x)), F.lit(0), F.lit(0)))
            .when(full, state(F.concat(a["done"], one(a["n"], a["size"])), F.lit(1), x))
            .otherwise(state(a["done"], a["n"] + 1, a["size"] + x))
        )

    def finish(a):
        last = F.element_at(a["done"], -1)
        joined = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(F.struct((last["n"] + a["n"]).alias("n"), (last["size"] + a["size"]).alias("size"))))
        own = F.concat(a["done"], F.array(F.struct(a["n"].alias("n"), a["size"].alias("size"))))
        return F.when(a["n"] == 0, a["done"]).when((a["size"] < tail) & (F.size(a["done"]) > 0), joined).otherwise(own)

    return F.aggregate(sizes, start, step, finish)


def compare_and_set(held: DataFrame, requests: DataFrame) -> DataFrame:
    """``held`` (id, status, attempt) after ``requests`` (id, expected, attempt, new), one an id at most, with ``accepted``: a
    request is accepted where the row has the expected status and the request's attempt; other rows keep their status."""
    r = requests.select("id", "expected", F.col("attempt").alias("_attempt"), "new")
    ok = F.coalesce((F.col("expected") == F.col("status")) & (F.col("_attempt") == F.col("attempt")), F.lit(False))
    return held.join(r, "id", "left").withColumn("accepted", ok).withColumn("status", F.when(F.col("accepted"), F.col("new")).otherwise(F.col("status"))).drop("expected", "_attempt", "new")


def reverse_dedup(terms: DataFrame, pair: str, reverse: str, dictionary: str = "法学") -> DataFrame:
    """Terms (id, source_term, target_term, lang_pair, domain, priority, ...) with one of ``pair`` for each source, and
    ``reversed``: no dictionary term if there is another, then strict, the shortest target, the latest. The others of a source
    turn into terms of ``reverse``, one for each of their targets (the shortest source), where that one has no term yet."""
    own = F.col("lang_pair") == pair
    order = (F.col("domain").eqNullSafe(dictionary).cast("int"), (~F.col("priority").eqNullSafe("strict")).cast("int"), F.length("target_term"), F.desc("updated_at"), "id")
    ranked = terms.where(own).withColumn("_rank", F.row_number().over(Window.partitionBy("source_term").orderBy(*order)))
    kept = ranked.where("_rank = 1").drop("_rank").unionByName(terms.where(~F.coalesce(own, F.lit(False)))).withColumn("reversed", F.lit(False))
    there = terms.where(F.col("lang_pair") == reverse).select(F.col("source_term").alias("target_term"))
    turned = ranked.where("_rank > 1").drop("_rank").join(there, "target_term", "left_anti")
    turned = keep_latest(turned, ["target_term"], [F.length("source_term"), F.col("priority"), F.col("id")])
    swap = {"source_term": F.col("target_term"), "target_term": F.col("source_term"), "lang_pair": F.lit(reverse)}
    return kept.unionByName(turned.select(*(swap.get(c, F.col(c)).alias(c) for c in terms.columns), F.lit(True).alias("reversed")))


def directory_merge(accounts: DataFrame, employees: DataFrame, reserved: str = "admin") -> DataFrame:
    """What a directory's ``employees`` do to ``accounts``: (login, action, employed, ...), one row a login.

    A login's later rows stand for its earlier ones (``ord``); blank logins go. The reserved name, names of local accounts
    without a directory id, and ids that another name holds are conflicts and change nothing; an id that no account holds goes to
    the first login that has it. Others are inserted, or updated where a stated field, the id, the employment or the effective
    activity (the override before the employment) differs.
    """
    e = employees.withColumn("login", strip(F.col("login"))).where("login <> ''")
    fields = F.struct(*(c for c in e.columns if c not in ("login", "ord")))
    e = e.groupBy("login").agg(F.min("ord").alias("_first"), F.max_by(fields, "ord").alias("x")).select("login", "_first", "x.*")
    e = e.withColumn("employed", F.coalesce((F.col("status") == "A") & (F.col("service") == "在职"), F.lit(False)))
    own = accounts.select(F.col("username").alias("login"), F.lit(True).alias("known"), *(F.col(c).alias(f"own_{c}") for c in accounts.columns if c != "username"))
    holder = accounts.where("oa_id is not null").select(F.col("oa_id").alias("id"), F.col("username").alias("holder"))
    m = e.join(own, "login", "left").join(holder, "id", "left")
    bad = F.when(F.col("login") == reserved, "conflict_reserved").when(F.col("known") & (F.col("own_auth_source") != "oa") & F.col("own_oa_id").isNull(), "conflict_local")
    m = m.withColumn("bad", bad)
    free = m.where("bad is null and id is not null and holder is null").groupBy("id").agg(F.min("_first").alias("_turn"))
    m = m.join(free, "id", "left")
    bound = F.coalesce(F.col("holder") != F.col("login"), F.lit(False)) | (F.col("holder").isNull() & F.coalesce(F.col("_turn") < F.col("_first"), F.lit(False)))
    other = lambda a, b: ~F.col(a).eqNullSafe(b)
    changed = (
        (F.col("own_auth_source") != "oa") | ((F.coalesce("name", F.lit("")) != "") & other("own_display_name", F.col("name"))) | (F.col("department").isNotNull() & other("own_department", F.col("department")))
        | (F.col("id").isNotNull() & other("own_oa_id", F.col("id"))) | other("own_oa_employed", F.col("employed")) | other("own_is_active", F.coalesce("own_active_override", "employed"))
    )
    action = F.coalesce("bad", F.when(bound, "conflict_bound").when(F.col("known").isNull(), "insert").when(changed, "update").otherwise("unchanged"))
    return m.withColumn("action", action)


def overlap_anti_join(boxes: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes (page, x1, y1, x2, y2) of which no table box of the page covers more than ``share`` of the own area."""
    b, t = boxes.alias("b"), tables.alias("t")
    w = F.greatest(F.lit(0.0), F.least("b.x2", "t.x2") - F.greatest("b.x1", "t.x1"))
    h = F.greatest(F.lit(0.0), F.least("b.y2", "t.y2") - F.greatest("b.y1", "t.y1"))
    area = (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    return b.join(t, (F.col("b.page") == F.col("t.page")) & (area > 0) & (w * h > area * share), "left_anti")


def sorted_page(df: DataFrame, allowed: dict[str, str], default: str, sort_by: str, sort_order: str, key: str, size: int, page: int = 1) -> DataFrame:
    """A page of ``df`` with ``place`` (from 1 on this page), by the column that ``allowed`` has for ``sort_by``, else by ``default``.

    Descending only where ``sort_order`` is desc in any case; ties by ``key``. The page alone is numbered.
    """
    column = allowed.get(sort_by, default)
    order = [F.desc(column) if sort_order.lower() == "desc" else F.asc(column), F.asc(key)]
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
