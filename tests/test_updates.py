import csv
import io

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same
from textloom import plans
from textloom.functions import layout
from textloom.operators import core, patches

SF = "/root/testdata/sf0.001"


def brute(rows, asked):
    """The batch rule in plain Python: rows {id: (pair, slot, note)}, asked [(id, seq, patch dict)]."""
    merged, at = {}, {}
    for i, seq, patch in sorted(asked, key=lambda x: x[1]):
        merged.setdefault(i, {}).update(patch)
        at.setdefault(i, seq)
    new = {i: (r[0], merged.get(i, {}).get("slot", r[1]), merged.get(i, {}).get("note", r[2])) for i, r in rows.items()}
    moved = {i for i in rows if new[i][1] != rows[i][1]}
    refused = set()
    while True:
        held = {}
        for i in rows:
            m = i in moved and i not in refused
            slot = new[i][1] if m else rows[i][1]
            if slot is not None:
                held.setdefault((rows[i][0], slot), []).append((m, at[i] if m else 0, i))
        more = {x[2] for v in held.values() for x in sorted(v)[1:] if x[0]}
        if not more:
            break
        refused |= more
    out = {i: (*(rows[i] if i in refused else new[i]), "conflict" if i in refused else "applied" if i in merged else None) for i in rows}
    return out | {i: (None, p.get("slot"), p.get("note"), "missing") for i, p in merged.items() if i not in rows}


@pytest.mark.parametrize("seed", range(3))
def test_patches_brute_force(spark, seed):
    import json
    import random

    r = random.Random(seed)
    rows = {i: (r.choice("ab"), i // 2 if i % 5 else None, "n") for i in range(0, 40, 2)}
    asked = [(r.choice([*rows, 99]), n, r.choice([{}, {"note": None}, {"note": "x"}, {"slot": r.randrange(20)}, {"slot": r.randrange(20), "note": f"{n}"}, {"slot": None}])) for n in range(40)]
    base = spark.createDataFrame([(i, *x) for i, x in rows.items()], "id long, pair string, slot long, note string")
    got = patches.patched(base, spark.createDataFrame([(i, n, json.dumps(p)) for i, n, p in asked], "id long, n int, patch string"), "id", ["n"], ["slot", "note"], ["pair", "slot"])
    assert {x.id: (x.pair, x.slot, x.note, x.outcome) for x in got.collect()} == brute(rows, asked)


def test_patches_odd_input(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 3, "c"), (4, None, None)], "id long, slot long, note string")
    asked = [(1, 0, '{"note": "z", "other": 5}'), (2, 0, "[1]"), (2, 1, None), (None, 2, '{"note": "no"}'), (4, 3, '{"slot": "nine"}'), (1, 1, '{"note": "y"}'), (1, 1, '{"note": "y"}')]
    got = patches.patched(base, spark.createDataFrame(asked, "id long, n int, patch string"), "id", ["n"], ["slot", "note"], ["slot"])
    rows = {(r.id, r.slot, r.note, r.outcome) for r in got.collect()}
    assert rows == {(1, 1, "y", "applied"), (2, 1, "b", "applied"), (None, 3, "c", None), (4, None, None, "applied")}
    none = spark.createDataFrame([], "id long, n int, patch string")
    assert patches.patched(base, none, "id", ["n"], ["slot"], ["slot"]).where("outcome is not null").count() == 0
    assert patches.patched(base.limit(0), none, "id", ["n"], ["slot"], ["slot"]).count() == 0


def test_long_chain_of_refusals_takes_few_rounds(spark, monkeypatch):
    import json

    n, written = 60, []
    monkeypatch.setattr(patches, "cut", lambda df, f=patches.cut: written.append(1) or f(df))
    rows = {i: ("a", i, "n") for i in range(2 * n + 3)}
    asked = [(i, i, {"slot": i + 1}) for i in range(n)]  # row n keeps its slot, so each is refused after its successor
    asked += [(i, i, {"slot": i + 1, "note": "x"}) for i in range(n + 1, 2 * n + 2)] + [(2 * n + 2, 2 * n + 2, {"slot": n + 1})]  # a ring
    base = spark.createDataFrame([(i, *x) for i, x in rows.items()], "id long, pair string, slot long, note string")
    got = patches.patched(base, spark.createDataFrame([(i, k, json.dumps(p)) for i, k, p in asked], "id long, n int, patch string"), "id", ["n"], ["slot", "note"], ["pair", "slot"])
    out = {x.id: (x.pair, x.slot, x.note, x.outcome) for x in got.collect()}
    assert out == brute(rows, asked) and [out[0][3], out[n][3], out[n + 1][3]] == ["conflict", None, "applied"]
    assert len(written) < n / 2


def test_patches_name_what_their_json_names(spark):
    texts = {
        '{"\\u006eote": "x"}': "x", '{"a": {"note": 1}}': "old", '{"a": "\\"note\\""}': "old", '{"note": "x"': "old", '["note"]': "old", '"note"': "old", "note": "old", "": "old",
        ' \n{"note" : 7}': "7", '{"note": 1, "note": 2}': "old", '{"note": null}': None, '{"note": ""}': "", '{"Note": "x"}': "old", '{"note": [1, null]}': "[1,null]", '{"note": true}': "true",
    }
    base = spark.createDataFrame([(i, "old", "{}") for i in range(len(texts))], "id int, note string, v string").withColumn("v", F.parse_json("v"))
    asked = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)] + [(0, 1, '{"v": {"b": [1.50, null]}}'), (1, 1, '{"v": null}')], "id int, n int, patch string")
    got = patches.patched(base, asked, "id", ["n"], ["note", "v"], ["id"]).select("id", "note", F.to_json("v").alias("v"), "outcome").collect()
    assert {r.id: r.note for r in got} == dict(enumerate(texts.values())) and {r.outcome for r in got} == {"applied"}
    assert [r.v for r in sorted(got)][:3] == ['{"b":[1.5,null]}', "null", "{}"]


def test_fitted(spark):
    df = spark.createDataFrame([(" A ", 1)], "source string, `x.y` int")
    got = patches.fitted(df, {"source": None, "key": "lower(trim(source))", "x.y": F.lit(9), "made": F.lit(2)}).collect()
    assert [tuple(r) for r in got] == [(" A ", "a", 1, 2)]
    with pytest.raises(ValueError, match="missing: z"):
        patches.fitted(df, {"z": None})


def test_csv_lines_as_the_library_writes_them(spark):
    rows = [("a", "b;c"), ('q"q', None), ("x\ny", " z "), ("", ""), ("\r", ","), ("é", "\t")]
    for x in (";", ",", "\t"):
        df = spark.createDataFrame(rows, "a string, b string")
        out = io.StringIO()
        csv.writer(out, delimiter=x, lineterminator="\n").writerows(rows)
        got = [r[0] for r in df.select(layout.csv_line([F.col("a"), F.col("b")], F.lit(x), F.lit(False))).collect()]
        assert "\n".join(got) + "\n" == out.getvalue()
        assert list(csv.reader(io.StringIO("\n".join(got), newline=""), delimiter=x)) == [[c or "" for c in r] for r in rows]
    one = spark.createDataFrame([("",), ("\ufeffa",)], "a string").select(layout.csv_line([F.col("a")], F.lit(","), F.lit(True)))
    assert [r[0] for r in one.collect()] == ['\ufeff""', "\ufeffa"]


def test_boxes_and_languages(spark):
    quads = [[(9, 1), (1, 9), (5, 5), (2, 2)], [(1, 1), (1.01, 9)], [(-5, 3), (50, 90)], [], None, [(1, None), (2, 2)]]
    df = spark.createDataFrame([(i, q and [(float(x), None if y is None else float(y)) for x, y in q]) for i, q in enumerate(quads)], "i int, q array<struct<x:double,y:double>>")
    got = {r.i: r.b and tuple(r.b) for r in df.select("i", layout.box(F.col("q"), F.lit(10), F.lit(10), 0.005).alias("b")).collect()}
    assert got == {0: (0.1, 0.1, 0.9, 0.9), 1: None, 2: (0.0, 0.3, 1.0, 1.0), 3: None, 4: None, 5: None}
    assert df.select(layout.box(F.col("q"), F.lit(0), F.lit(10), 0.005).alias("b")).where("b is not null").count() == 0
    pairs = spark.createDataFrame([("de",), ("ja → en",), ("xx→de",), (None,), ("",), ("zh",)], "p string")
    assert [r[0] for r in pairs.select(layout.recogniser(F.col("p"))).collect()] == ["german", "japan", "ch", "ch", "ch", "ch"]


def test_pages_and_conflict_order(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "k int, v string")
    page = lambda *a, **k: [(r.k, r.place) for r in core.sorted_page(df, {"v": "v"}, "k", *a, "k", 2, **k).orderBy("place").collect()]
    assert page("v", "ASC") == [(2, 1), (3, 2)] and page("v", "Desc") == [(1, 1), (2, 2)] and page("k; --", "desc") == [(3, 1), (2, 2)] and page("v", "asc", page=2) == [(1, 1)]
    rows = [tuple(r) for r in plans.queries()["u6_all_conflicts"](spark, SF).collect()]
    assert rows == sorted(rows) and len(rows) > 10


def test_refusal_rounds_settle_within_the_sql(spark):
    from textloom.plans import updates

    con, sql = connect(SF), plans.oracle_sql()["d4_partial_updates"]
    fewer = sql.replace(f"(SELECT id FROM r{updates.ROUNDS}) AS no", f"(SELECT id FROM r{updates.ROUNDS - 1}) AS no")
    assert fewer != sql and sorted(con.sql(fewer).fetchall(), key=repr) == sorted(con.sql(sql).fetchall(), key=repr)
    same(plans.queries()["d4_partial_updates"](spark, SF), con, sql)
