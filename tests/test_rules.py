import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import typed
from textloom.operators import chains, core, integrity


@pytest.mark.parametrize("parts", (1, 7))
def test_request_chains_brute_force(spark, parts):
    """One task with a third of all requests, ids without requests, unknown and null ids, null attempts."""
    rng = random.Random(parts)
    states, attempts = ["queued", "running", "done"], [None, "a", "b"]
    held = [(i, rng.choice(states), rng.choice(attempts)) for i in range(30)]
    requests = [(i, seq, rng.choice(states), rng.choice(attempts), rng.choice(states), rng.choice(attempts)) for i in [*range(20), 99, None] for seq in range(2000 if i == 3 else rng.randint(1, 60))]
    now, want = {i: (s, a) for i, s, a in held}, []
    for i, seq, e, a, s, b in sorted(requests, key=lambda r: r[1]):
        ok = i in now and now[i] == (e, a)
        if ok:
            now[i] = (s, b)
        want.append((i, seq, ok, *now.get(i, (None, None))))
    rng.shuffle(requests)
    got = chains.request_chains(spark.createDataFrame(held, "id long, status string, attempt string"), spark.createDataFrame(requests, "id long, seq long, expected string, attempt string, new string, new_attempt string"), parts)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert chains.request_chains(spark.createDataFrame(held, "id long, status string, attempt string"), spark.createDataFrame([], "id long, seq long, expected string, attempt string, new string, new_attempt string"), parts).count() == 0


def test_transition_maps_are_associative():
    rng = random.Random(0)
    states = [(s, a) for s in "xyz" for a in (None, "1")]
    for _ in range(200):
        steps = [(rng.choice(states), rng.choice(states)) for _ in range(rng.randint(0, 9))]
        whole = chains.TransitionMap()
        for s in steps:
            whole.then(*s)
        for state in states:
            end = state
            for e, n in steps:
                end = n if end == e else end
            assert whole.ends.get(state, state) == end


def titles(sheets, most=31):
    taken, out = {}, []
    for book, idx, title, original in sorted(sheets, key=lambda r: (r[0], r[1])):
        final = original
        if title:
            final = re.sub(r"[\\/*?:\[\]]", "_", title.strip()).strip("'")[:most].strip()
            if not final or final.lower() == "history":
                final = original
            base, n = final, 2
            while final.lower() in taken.setdefault(book, set()):
                final, n = base[: most - len(f"_{n}")] + f"_{n}", n + 1
            taken[book].add(final.lower())
        out.append((book, idx, final))
    return out


def test_sheet_titles_brute_force(spark):
    """Collisions by case, after truncation, with titles that look like numbered ones, at every length."""
    rng = random.Random(5)
    stems = ["A", "a_2", "ab" * 16, "AB" * 15 + "a_2", "x" * 24, "x" * 23, "X" * 23 + "_1", "y" * 29 + "_2", "Straße", "ΣΑΣ", "σας", "_2", "a_", "[b]", "'q'", " History", "", None, "  ", "long title of a sheet that goes on"]
    sheets = [(f"b{rng.randint(0, 2)}", i, rng.choice(stems), f"Sheet{i % 5}") for i in range(600)]
    sheets += [("hot", i, "same title of a sheet, over and over", "S") for i in range(1200)]
    got = chains.sheet_titles(spark.createDataFrame(sheets, "book string, idx long, title string, original string"))
    assert sorted(map(tuple, got.collect())) == sorted(titles(sheets))


def test_fold_batch_in_order(spark):
    rows = [("k", 1, "a", "d1", "n1"), ("k", 2, None, None, "n2"), ("k", 3, "c", None, None), ("l", 1, "x", None, None), ("l", 2, None, "d", "n")]
    batch = chains.fold_batch(spark.createDataFrame(rows, "key string, ord int, value string, domain string, note string"), ["key"], ["ord"], ["value"], ["domain"], ["note"])
    assert sorted(map(tuple, batch.select("key", "value", "domain", "note").collect())) == [("k", "c", "d1", "n1"), ("l", None, "d", None)]
    base = spark.createDataFrame([("l", "old", "old", "old"), ("m", "m", "m", "m")], "key string, value string, domain string, note string")
    assert sorted(map(tuple, core.upsert(base, batch, ["key"], ["value"], ["domain"], ["note"]).select("key", "value", "domain", "note").collect())) == [("k", "c", "d1", "n1"), ("l", None, "d", "old"), ("m", "m", "m", "m")]


def test_chunk_schedule(spark):
    chunks = [(1, 0, 20_000), (1, 1, 11_000), (1, 2, 5), (2, 0, 30_000), (3, 0, 1), (3, 1, 1)]
    got = chains.chunk_schedule(spark.createDataFrame(chunks, "doc_id long, chunk long, size long")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "1", 0, None), (1, 1, "1", 1, 0), (1, 2, "1", 2, 1), (2, 0, "2:0", 0, None), (3, 0, "3:0", 0, None), (3, 1, "3:1", 0, None)]


TASKS = [(1, "u"), (2, "u"), (3, "v")]
FILES = [(10, 1, None), (11, 1, 10), (12, 2, 11), (13, 3, None), (14, None, 12)]
MEMORY = [(20, 1), (21, 3), (22, None)]


def delete(spark, tasks, restrict=False):
    tables = {"tasks": spark.createDataFrame(TASKS, "id long, owner string"), "files": spark.createDataFrame(FILES, "id long, task long, origin long"), "memory": spark.createDataFrame(MEMORY, "id long, task long")}
    links = [integrity.Link("files", "task", "tasks", "id", "cascade"), integrity.Link("files", "origin", "files", "id", "cascade"), integrity.Link("memory", "task", "tasks", "id", "restrict" if restrict else "null")]
    out = integrity.delete_along(tables, dict.fromkeys(tables, "id"), links, {"tasks": spark.createDataFrame([(x,) for x in tasks], "id long")})
    return {name: sorted(map(tuple, df.collect()), key=repr) for name, df in out.items()}


def test_deletes_along_links(spark):
    got = delete(spark, [1])
    # a file made of a file made of a deleted task's file goes with it, and so on
    assert got == {"tasks": [(2, "u"), (3, "v")], "files": [(13, 3, None)], "memory": sorted([(20, None), (21, 3), (22, None)], key=repr)}
    assert delete(spark, [2], restrict=True)["files"] == sorted([(10, 1, None), (11, 1, 10), (13, 3, None)], key=repr)
    with pytest.raises(integrity.Restricted):
        delete(spark, [1], restrict=True)
    assert delete(spark, [])["files"] == sorted(FILES, key=repr)


def test_violations(spark):
    tables = {
        "users": spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, True), (None, True)], "name string, admin boolean"),
        "models": spark.createDataFrame([("vl", True, "u1"), ("vl", True, "a"), ("tr", True, "b"), ("tr", False, None)], "type string, active boolean, owner string"),
    }
    rules = [
        integrity.Constraint("unique", "users", ("name",)), integrity.Constraint("single", "models", ("type",), "active"), integrity.Constraint("reference", "models", ("owner",), parent=("users", "name")),
        integrity.Constraint("distribution", "models", ("type",), expected={"vl": 2, "tr": 1, "ocr": 1}), integrity.Constraint("check", "models", ("type", "active"), "type <> 'tr' OR active"),
    ]
    assert sorted(map(tuple, integrity.violations(tables, rules).collect())) == [
        ("check", "models", "type,active", '{"type":"tr","active":false}', 1), ("distribution", "models", "type", '{"type":"ocr"}', 0), ("distribution", "models", "type", '{"type":"tr"}', 2),
        ("reference", "models", "owner", '{"owner":"u1"}', 1), ("single", "models", "type", '{"type":"vl"}', 2), ("unique", "users", "name", '{"name":"a"}', 2),
    ]


def test_published_together(spark, tmp_path):
    """A writer that fails between two tables leaves readers with the state before, whole."""
    folder, frame = str(tmp_path / "state"), lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    seen = lambda: {name: sorted(r.v for r in df.collect()) for name, df in integrity.published(spark, folder).items()}
    assert seen() == {}
    integrity.publish(folder, {"terms": frame("t1"), "memory": frame("m1"), "status": frame("open")})

    def fails():
        raise OSError("lost")

    with pytest.raises(OSError):
        integrity.publish(folder, {"terms": frame("t1", "t2"), "memory": fails, "status": frame("adopted")})
    assert seen() == {"terms": ["t1"], "memory": ["m1"], "status": ["open"]}
    integrity.publish(folder, {"terms": frame("t1", "t2"), "status": frame("adopted")})
    assert seen() == {"terms": ["t1", "t2"], "memory": ["m1"], "status": ["adopted"]}


def test_typed_rows(spark):
    rows = [
        ("TRUE", "", "2026-08-04T01:02:03Z", "{0F0E0D0C-0B0A-0908-0706-050403020100}", "vl", "x"), ("1", None, "2026-08-04 01:02:03.5+08:00", "urn:uuid:0f0e0d0c0b0a09080706050403020100", "translation", "y"),
        ("yes", "0", "2026-08-04T01:02:03", "0f0e", "ocr", ""), (None, "maybe", "2026-02-30T00:00:00Z", "", "", None),
    ]
    df = spark.createDataFrame(rows, "flag string, choice string, at string, id string, kind string, note string")
    fields = {"flag": typed.Field("bool"), "choice": typed.Field("bool", False), "at": typed.Field("time"), "id": typed.Field("uuid"), "kind": typed.Field("enum", values=("translation", "vl")), "note": typed.Field("text")}
    parsed = typed.parse(df, fields)
    good, bad = typed.split(parsed)
    text = good.select(*(typed.canonical(F.col(c), f.kind).alias(c) for c, f in fields.items()))
    name = "0f0e0d0c-0b0a-0908-0706-050403020100"
    assert sorted(map(tuple, text.collect())) == [("true", "", "2026-08-03T17:02:03.500000+00:00", name, "translation", "y"), ("true", "", "2026-08-04T01:02:03+00:00", name, "vl", "x")]
    codes = [[f"{e['column']}:{e['code']}" for e in r.errors] for r in bad.collect()]
    assert sorted(codes) == sorted([["flag:bool", "at:zone", "id:uuid", "kind:enum", "note:empty"], ["flag:empty", "choice:bool", "at:time", "id:empty", "kind:empty", "note:empty"]])
    # what is written canonically is read as the same
    again = typed.parse(text, fields)
    assert sorted(map(tuple, typed.split(again)[0].collect())) == sorted(map(tuple, good.collect()))
