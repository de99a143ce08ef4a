from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import core


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


def test_skip_rules(spark):
    for value, skip in (("2026-08-04", True), ("https://site.example", True), ("123,456.00%", True), ("Agreement", False), ("12:30", True), ("a@b.co", True), ("v1.2", True), ("3.5 million", True), ("  ", True), (None, True), ("合同", False)):
        assert one(spark, value, X.should_skip) is skip, value
    assert one(spark, "§", lambda c: X.should_skip(c, True)) is True
    assert one(spark, "合", lambda c: X.should_skip(c, True)) is False


def test_dice(spark):
    rows = [("", "a", 0.0), ("a", "a", 1.0), ("a", "b", 1.0), ("ab", "a", 0.0), ("abcd", "abce", 2 * 2 / 6), ("合同条款", "合同条款", 1.0)]
    got = spark.createDataFrame(rows, "a string, b string, e double").select(X.dice(F.col("a"), F.col("b")).alias("x"), "e").collect()
    assert all(abs(r.x - r.e) < 1e-12 for r in got)


def test_terms_and_cells(spark):
    assert one(spark, "n.contract;v.shrink", X.clean_term) == "contract"
    assert one(spark, "４８hours", X.clean_term) == "48hours"
    assert one(spark, "a, b", X.clean_term) == "a"
    assert one(spark, "=2+2", X.csv_safe) == "'=2+2"
    assert one(spark, "+8613800000000", X.csv_safe) == "'+8613800000000"
    assert one(spark, None, X.csv_safe) == ""
    for cell in ("@department", "\u3000=1+1", "\u00a0@x", " \t-5", "\u2003+1"):
        assert one(spark, cell, X.csv_safe) == "'" + cell
    for cell in ("plain", "a=1", "\u3000x", "1-2"):
        assert one(spark, cell, X.csv_safe) == cell
    assert one(spark, "<td>a <b>x</b></td><td> </td><TD>c</TD>", X.html_cells) == "a x | c"
    assert one(spark, "zh-Hant", X.language_pair_code) == "zh"
    assert one(spark, "zh-Hant", X.language_name) == "Traditional Chinese"
    assert one(spark, "", X.language_name) == "English"


def test_wait_seconds(spark):
    rows = [(1, 4, 2, 100.0, 0), (2, 4, 2, 100.0, 0), (3, 4, 2, 100.0, 100), (5, 4, 4, 100.0, 200), (1, 4, 4, None, None)]
    df = spark.createDataFrame(rows, "p int, m int, r int, a double, e int")
    assert all(r.x == r.e for r in df.select(core.wait_seconds(F.col("p"), F.col("m"), F.col("r"), F.col("a")).alias("x"), "e").collect())


def test_memory_lookup(spark):
    seg = spark.createDataFrame([(t, "en→zh") for t in ("legal clause", "legal clauses x", "nothing alike", "a")], "text string, scope string")
    mem = spark.createDataFrame([(1, "  LEGAL CLAUSE  "), (2, "legal clauses"), (3, "b")], "tm_id long, source_text string").withColumn("lang_pair", F.lit("en→zh"))
    got = {r.key: (r.tm_id, r.exact) for r in core.memory_lookup(seg, mem).collect()}
    assert got == {"legal clause": (1, True), "legal clauses x": (2, False), "a": (3, False)}
    # equally similar sources: the first; equal sources: the latest; a source below the threshold is none
    mem = spark.createDataFrame([(7, "abcdef y"), (5, "abcdef z"), (4, "unrelated memory"), (8, "Same"), (9, "same ")], "tm_id long, source_text string").withColumn("lang_pair", F.lit("en→zh"))
    seg = spark.createDataFrame([("abcdef x",), ("same",), ("quite another",)], "text string").withColumn("scope", F.lit("en→zh"))
    got = {r.key: (r.tm_id, r.similarity, r.exact) for r in core.memory_lookup(seg, mem).collect()}
    assert got == {"abcdef x": (5, 0.857, False), "same": (9, 1.0, True)}


def test_memory_lookup_by_language_pair(spark):
    """Two targets of one source; an unknown source language takes every pair of its target, and no pair of another."""
    mem = spark.createDataFrame([(1, "good day", "en→zh"), (2, "good day", "en→fr"), (3, "good day", "de→zh"), (4, "good days", "fr→zh"), (5, "x", "en→fr")], "tm_id long, source_text string, lang_pair string")
    seg = spark.createDataFrame([("good day", s, t) for s in ("en", "zh-Hant", "auto", "FR", "de") for t in ("zh-CN", "fr")] + [("y", "en", "zh"), ("y", "en", "fr")], "text string, s string, t string")
    seg = seg.select("text", core.scope_of(F.col("s"), F.col("t")).alias("scope"))
    got = {(r.scope, r.key): (r.tm_id, r.exact) for r in core.memory_lookup(seg, mem).collect()}
    assert got == {
        ("en→zh", "good day"): (1, True), ("en→fr", "good day"): (2, True), ("auto→zh", "good day"): (3, True), ("auto→fr", "good day"): (2, True),
        ("de→zh", "good day"): (3, True), ("fr→zh", "good day"): (4, False), ("en→fr", "y"): (5, False),
    }


def test_trigram_top_brute_force(spark):
    """Every step of the threshold, ties at the last place, scopes, and texts without words."""
    import random
    import re

    rng = random.Random(2)

    def grams(text):
        return {p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)}

    words = ["abc", "abd", "bcd", "xyz", "xy", "é"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    ls = [(i, text(), f"s{i % 2}") for i in range(60)] + [(60, "--", "s0"), (61, "Abc, ABC_abc", "s1")]
    rs = [(i, text(), f"s{i % 2}") for i in range(150)]
    for most, least in ((50, 0.3), (3, 0.3), (1, 0.5)):
        got = core.trigram_top(spark.createDataFrame(ls, "lid long, ltext string, scope string"), spark.createDataFrame(rs, "rid long, rtext string, scope string"), most, least)
        want = []
        for lid, a, s in ls:
            x = grams(a)
            near = sorted((-len(x & grams(b)) / len(x | grams(b)), rid) for rid, b, t in rs if s == t and x and grams(b) and len(x & grams(b)) >= least * len(x | grams(b)))
            want += [(lid, k + 1, rid, round(-sim, 9)) for k, (sim, rid) in enumerate(near[:most])]
        assert sorted((r.lid, r["rank"], r.rid, round(r.similarity, 9)) for r in got.collect()) == want


def test_fuzzy_join_brute_force(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcde f") for _ in range(rng.randint(1, 40))) for _ in range(25)] + ["合同违约条款责任", "合同违约条款的责任", "a", "b", "", "😀😀ab"]
    near = ["".join(c if rng.random() > 0.06 else rng.choice("abcxyz") for c in t) for t in base for _ in range(4)]
    ls, rs = list(enumerate(base + near)), list(enumerate(near[::2] + base[::3]))
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    for threshold in (0.8, 0.55):
        want = {(i, j) for i, a in ls for j, b in rs for x, y in [(grams(a), grams(b))] if x and y and 2 * len(x & y) >= threshold * (len(x) + len(y)) - 1e-12}
        got = core.fuzzy_join(spark.createDataFrame(ls, "lid long, ltext string"), spark.createDataFrame(rs, "rid long, rtext string"), threshold)
        assert {(r.lid, r.rid) for r in got.collect()} == want and len(want) > 100


def test_glossary_hits(spark):
    terms = ["act", "contract", "breach of contract", " breach ", "违约", "根本违约", "法", "a.b", "C++", "x (y)", "(z)", "--- ", "é", "ñ1", "Act", "an"]
    glossary = [(i, t, "strict" if t in ("act", "x (y)") else "preferred") for i, t in enumerate(terms)] + [(99, "act", "preferred")]
    texts = {
        1: "The ACTUAL act was a Breach  of contract", 2: "material breach of contract, contract", 3: "构成根本违约。", 4: "违约 and 法", 5: "a.b aXb C++ x (y) (z) w(z)w a---b",
        6: "", 7: None, 8: "Ñ1 ñ1 é", 9: "act_ react ACT",
    }
    got = {}
    df = spark.createDataFrame(list(texts.items()), "seg_id long, text string")
    for r in core.glossary_hits(df, spark.createDataFrame(glossary, "ord long, term string, priority string")).orderBy("seg_id", "ord").collect():
        got.setdefault(r.seg_id, []).append(r.term)
    assert got == {1: ["act", "contract", " breach ", "Act"], 2: ["breach of contract"], 3: ["根本违约"], 4: ["违约"], 5: ["a.b", "(z)", "--- "], 8: ["ñ1"], 9: ["act", "Act"]}
    large = core.TERM_BYTES
    core.TERM_BYTES = 0  # a glossary that is not broadcast
    try:
        rows = core.glossary_hits(df, spark.createDataFrame(glossary, "ord long, term string, priority string")).collect()
    finally:
        core.TERM_BYTES = large
    assert sorted((r.seg_id, r.ord, r.term) for r in rows) == sorted((k, min(i for i, t, _ in glossary if t.strip() == x.strip()), x) for k, v in got.items() for x in v)
    # a family of terms that share a common word meets each text by the other one, and the shorter term goes where a longer one hits
    family = [(i, f"agreement {'w' + str(i)}", "preferred") for i in range(300)] + [(900, "agreement", "preferred"), (901, "w17", "strict")]
    said = [(i, f"the agreement w{i} and an agreement w{i + 1}x" if i % 2 else "an agreement") for i in range(20)]
    hit = core.glossary_hits(spark.createDataFrame(said, "seg_id long, text string"), spark.createDataFrame(family, "ord long, term string, priority string")).collect()
    want = {(i, f"agreement w{i}") for i in range(1, 20, 2)} | {(i, "agreement") for i in range(0, 20, 2)} | {(17, "w17")}
    assert {(r.seg_id, r.term) for r in hit} == want and len(hit) == len(want)
    many = [(i, f"t{i:02}" + "x" * (i % 5), "strict" if i % 7 == 0 else "preferred") for i in range(60)]
    one = spark.createDataFrame([(1, " ".join(t for _, t, _ in many))], "seg_id long, text string")
    kept = [(r.ord, r.term) for r in core.glossary_hits(one, spark.createDataFrame(many, "ord long, term string, priority string")).collect()]
    want = sorted(many, key=lambda m: (m[2] != "strict", -len(m[1]), m[0]))[:40]
    assert sorted(kept) == sorted((i, t) for i, t, _ in want)


def test_upsert_keeps_old_where_new_is_null(spark):
    base = spark.createDataFrame([(1, "a", "d"), (2, "b", None)], "k int, v string, dom string")
    batch = spark.createDataFrame([(1, None, None), (3, "c", "e")], "k int, v string, dom string")
    got = sorted(map(tuple, core.upsert(base, batch, ["k"], ["v"], keep_old_if_null=["dom"]).collect()))
    assert got == [(1, None, "d"), (2, "b", None), (3, "c", "e")]
