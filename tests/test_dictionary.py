"""Patterns in texts: every pattern is found, and terms that begin alike cost a text nothing."""

import random

import pyarrow as pa

from textloom.operators import core, dictionary


def test_runs_brute_force():
    rng = random.Random(1)
    for alphabet in ("ab", "aé😀违 ", "abcdefgh\x01"):
        text = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
        patterns, texts = {text(6) for _ in range(30)} - {""}, [text(40) for _ in range(30)] + [None, ""]
        table = dictionary.Prefixes.empty(16)
        table.add(pa.array(sorted(patterns)[::2]))
        table.add(pa.array(["", None, *sorted(patterns)[1::2]], pa.string()))
        for part in (pa.array(texts, pa.string()), pa.array(["zz", *texts], pa.string()).slice(1)):
            row, runs = dictionary._runs(part, table)
            got = [(r, s) for r, s in zip(row.tolist(), runs) if s in patterns]
            assert sorted(got) == sorted((i, t[a:b]) for i, t in enumerate(texts) if t for a in range(len(t)) for b in range(a + 1, len(t) + 1) if t[a:b] in patterns)
            assert list(row) == sorted(row)


def test_terms_that_begin_alike_make_no_rows(spark):
    """each of the terms with a text's four characters was a row of that text, so rows grew with texts times terms."""
    terms = spark.createDataFrame([(i, f"ónciá {i:04}", "preferred") for i in range(2000)] + [(5000, "ónci", "preferred"), (5001, "ci", "strict"), (5002, "ñ1", None)], "ord long, term string, priority string").cache()
    texts = spark.createDataFrame([(i, f"la ónciá {i:04} y ónci{i}, ñ1") for i in range(0, 40, 2)] + [(101, None), (102, "ASCII")], "seg_id long, text string")
    table = dictionary.prefixes(terms.select("term"))
    rows = dictionary.held_patterns(texts, "seg_id", {"text": table}).collect()
    wide = {"ónci", "ci", "ñ1"}
    assert {(r.seg_id, r.pattern) for r in rows} >= {(i, x) for i in range(0, 40, 2) for x in wide | {f"ónciá {i:04}"}} and len(rows) <= 20 * 6
    got = {(r.seg_id, r.term) for r in core.glossary_hits(texts, terms).collect()}
    # 'ónci' is part of a longer hit, 'ci' as an ASCII term of two characters is none
    assert got == {(i, x) for i in range(0, 40, 2) for x in ("ñ1", f"ónciá {i:04}")}


def test_glossary_hits_brute_force(spark):
    rng = random.Random(6)
    syllables = ["é", "öa", "ci", "违约", "ó", "n"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(rng.randint(1, n)))
    terms = sorted({t for t in (word(4) + rng.choice(["", " " + word(2)]) for _ in range(120)) if len(t) > 1 and not t.isascii()})
    rng.shuffle(terms)
    glossary = [(i, t, rng.choice(["strict", "preferred", None])) for i, t in enumerate(terms)]
    texts = [(i, " ".join(word(6) for _ in range(rng.randint(0, 12)))) for i in range(50)]
    df, g = spark.createDataFrame(texts, "seg_id long, text string"), spark.createDataFrame(glossary, "ord long, term string, priority string")
    for most in (40, 5):
        want = set()
        for i, text in texts:
            hit = [(o, t, p) for o, t, p in glossary if t in text]
            left = [(o, t, p) for o, t, p in hit if p == "strict" or not any(len(u) > len(t) and t in u for _, u, _ in hit)]
            if len(left) > most:
                left = sorted(left, key=lambda x: (x[2] != "strict", -len(x[1]), x[0]))[:most]
            want |= {(i, o, t, p) for o, t, p in left}
        rows = core.glossary_hits(df, g, most).collect()
        assert {(r.seg_id, r.ord, r.term, r.priority) for r in rows} == want and len(rows) == len(want)
