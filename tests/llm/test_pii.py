import collections
import hashlib
import re

import numpy as np

from textloom.llm import pii

SF = "/root/testdata/sf0.001"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_rule(text):
    return [(k, *m.span()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text or "") if holds(kind, m.group())]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_base_rules():
    rng = np.random.default_rng(4)
    found = collections.Counter()
    for size, letters in ((60, "a1.@-+ "), (60, "0123456789 -"), (40, "12.3"), (60, "+0123456 ()-."), (50, "aé@b.c-_%(")):
        for _ in range(1500):
            text = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(0, size)))
            assert pii.base_spans(text) == by_rule(text), text
            found.update(k for k, _, _ in by_rule(text))
    assert set(found) == {0, 1, 2, 3}
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "+1 " * 100_000, "a@" * 100_000, "+1" + " " * 300_000, "[at" * 50_000):
        pii.candidates(text, pii.base_spans(text))  # none takes quadratic time


def test_query_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.op13(spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base, r = by_rule(text), got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


CONTEXT = [
    *(f"Please call me at +1 (555) 555-01{i:02} tomorrow, thanks {i}." for i in range(20)),
    *(f"my card number: 4539 1488 0343 64{i:02}" for i in range(100) if holds("card", f"45391488034364{i:02}")),
    *(f"Reach the server by 10.0.0.{i} or not" for i in range(5)),
    *(f"Write to user{i}@example.com soon" for i in range(5)),
    "Please call me at (555) 555 0142 tonight", "If lost, phone back on 555-777-0142 please", "ring up 555-777-0143 or call me at 555-777-0143",
    "Write to jane.roe (at) example (dot) org soon", "my card number: 4539 1488 0343 6400 and no more", "Reach the server by 2001:db8:0:1::17 today",
    "Lot 5557770199 of 300 was sold at 12:30:45", "order 555-777-0177 came", "It is 5557770188", "call me at home", "the at of and", "Tel 1 555 555 0103",
    *(f"ring up 555-888-0{i}00 or call me at 555-888-0{i}00" for i in range(1, 5)), "ring up 555-888-0999 now", *(f"to the {i}" for i in range(40)),
]


def expected(texts, support=3, confidence=0.5, accept=0.8):
    """The same graph and rounds in plain Python, over words found by patterns of their own."""
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+", t)] for t in texts]
    totals, edges, mentions = collections.Counter(), collections.Counter(), []
    sides = [(1, True), (2, True), (3, True), (2, False)]
    for w in words:
        for n, before in sides:
            totals.update((n, before, *(x[2] for x in w[p : p + n])) for p in range(len(w) - n + 1))
    for i, (t, w) in enumerate(zip(texts, words)):
        base = by_rule(t)
        for k, s, e, seed in [(*x, True) for x in base] + [(*x, False) for x in pii.candidates(t, base)]:
            value = re.sub(r"\D", "", t[s:e]) if k > 1 else t[s:e].lower()
            mentions.append((i, k, s, e, value, seed))
            left, right = [x for x in w if x[1] <= s], [x for x in w if x[0] >= e]
            for n, before in sides:
                own = left[-n:] if before else right[:n]
                if len(own) == n and (s - own[-1][1] if before else own[0][0] - e) <= 4:
                    edges[k, (n, before, *(x[2] for x in own)), value] += 1
    seeds = {(k, v) for _, k, _, _, v, seed in mentions if seed}
    known = dict.fromkeys(seeds, 1.0)
    for _ in range(8):
        here = collections.defaultdict(list)
        for (k, p, v), n in edges.items():
            if (k, v) in known:
                here[k, p].append(n * known[k, v])
        sure = {kp: min(sum(x) / totals[kp[1]], 1 - 1e-6) for kp, x in here.items() if len(x) >= support and sum(x) / totals[kp[1]] >= confidence}
        left = collections.defaultdict(lambda: 1.0)
        for k, p, v in edges:
            left[k, v] *= 1 - sure.get((k, p), 0)
        new = dict.fromkeys(seeds, 1.0) | {kv: 1 - x for kv, x in left.items() if 1 - x >= accept and kv not in seeds}
        if set(new) == set(known):
            break
        known = new
    out = []
    for i, t in enumerate(texts):
        best = {}
        for j, k, s, e, v, seed in mentions:
            if j == i and not seed and (k, v) in known:
                best[s, e] = max(best.get((s, e), (0, -9)), (known[k, v], -k))
        out.append(joined(sorted(by_rule(t) + [(-k, s, e) for (s, e), (_, k) in best.items()])))
    return out


def test_discovered_identifiers(spark, tmp_path):
    rows = list(enumerate(CONTEXT))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in pii.op13(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == expected(CONTEXT)
    at = lambda part: got[next(i for i, t in rows if part in t)]
    assert at("call me at (555) 555 0142") == "phone:18:32" and at("jane.roe") == "email:9:40" and at("6400 and") == "card:16:35" and at("2001") == "ip:20:36"
    assert at("Tel 1") == "phone:4:18"  # a known number in another form
    # found by a pattern that only discovered numbers could raise
    assert at("0999 now") == "phone:8:20"
    assert not any(map(at, ("Lot", "order", "It is", "call me at home", "phone back")))
    part = pii.find_pii(spark.read.parquet(str(tmp_path / "documents.parquet")), part_patterns=3)
    assert {r.doc_id: joined(tuple(s) for s in r.spans) for r in part.collect()} == got


def test_odd_rows(spark, tmp_path):
    long = "é " * 300_000 + "a@b.cd " + "1 " * 100_000
    rows = [(1, None, "x"), (None, "mail a@b.cd", "x"), (2, "", None), (2, "日本 a@b.cd 127.0.0.1", "y"), (2, "日本 a@b.cd 127.0.0.1", "y"), (3, long, "z"), (4, "𝒳 +1 222 333 4444", "z")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base string, row int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.spans) for r in pii.op13(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, ""), (None, "email:5:11"), (2, ""), (2, "email:3:9,ip:10:19"), (2, "email:3:9,ip:10:19"), (3, "email:600000:600006"), (4, "phone:2:17")], key=repr)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pii.op13(spark, str(tmp_path / "none")).count() == 0
