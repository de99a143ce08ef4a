import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import sheets
from textloom.sources import csv_cells, termbases
from textloom.streaming import limiter

SF = "/root/testdata/sf0.001"


def test_sheets(spark):
    rows = [[None, "B2", "律师", '=IF(B1="B2","yes","no")'], ["free", "B2", "普通员工", '=COUNTIF(C1:C2,"律师")'], ["律师", "12,3", " ", None]]
    cells = [("a", 1, r + 1, c + 1, "formula" if v.startswith("=") else "text", None if v.startswith("=") else v, v if v.startswith("=") else None) for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    cells.append(("a", 1, None, None, "sheet_name", "S 1", None))
    df = spark.createDataFrame(cells, "path string, sheet int, row int, col int, kind string, value string, formula string")
    got = {(r.row, r.col, r.value) for r in sheets.translatable_cells(df).collect()}
    # B1 and C1 are looked up; B2 and A3 equal a formula's text outside its ranges
    assert got == {(2, 1, "free"), (2, 2, "B2"), (2, 3, "普通员工"), (3, 1, "律师")}


@pytest.mark.parametrize("formula, texts, ranges", [
    ('=IF(C1="A1","say ""x""","")', ["A1", 'say "x"'], [(None, 1, 3, 1, 3)]),
    ("=SUM($B$4:A2)+LOG10(Z9)", [], [(None, 2, 1, 4, 2), (None, 9, 26, 9, 26)]),
    ("""='It''s "x"'!A1+Two!AA10:AB11""", [], [("It's \"x\"", 1, 1, 1, 1), ("Two", 10, 27, 11, 28)]),
    ("=A:A+total_1+1", [], []), (None, None, None),
])
def test_formula_tokens(spark, formula, texts, ranges):
    row = spark.createDataFrame([(formula,)], "f string").select(sheets.formula_literals(F.col("f")).alias("t"), sheets.formula_ranges(F.col("f")).alias("r")).first()
    assert row.t == texts and (row.r is None if ranges is None else [tuple(x) for x in row.r] == ranges)


@pytest.mark.parametrize("line, want", [("a;b", ["a", "b"]), ("1;c", ["1", "c"]), ('a;"b;c"', ["a", "b;c"]), ("", []), (None, []), ("q", ["q"])])
def test_csv(spark, line, want):
    cells = csv_cells.csv_cells(spark.createDataFrame([("f", 0, line)], "path string, row long, line string"), 3, ";")
    assert [(r.col, r.value) for r in cells.orderBy("col").collect()] == list(enumerate(want))
    assert csv_cells.translatable(cells).count() == sum(v != "1" for v in want)


def test_limiter_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('error', 'signup')").withColumn("g", F.col("user_id") % 3)
    for i in range(2):  # two triggers, in order of time
        ev.withColumn("h", F.ntile(2).over(Window.orderBy("ts", "event_id")) - 1).where(F.col("h") == i).drop("h").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = ("g", F.col("event_type") == "error", 90000.0, 4, 40000.0)
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limiter.limit_stream(source, *args).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, limiter.limit_attempts(ev, *args).collect()))


def test_termbases(spark):
    concepts = spark.createDataFrame([("m", 1, 7), ("m", 2, 8), ("o", 1, 1), ("o", 3, 3)], "path string, id int, entry int")
    langs = spark.createDataFrame([("m", 1, "en-US", 1), ("m", 2, "zh-TW", 1), ("m", 3, "fr", 1), ("m", 4, "de", 2), ("m", 5, "fr", 2), ("m", 6, "it", 9), ("o", 1, "en", 1), ("o", 2, "zh", 1), ("o", 3, "en", 3), ("o", 4, "zh", 3)], "path string, id int, lang string, concept_id int")
    terms = spark.createDataFrame([("m", 0, 1, "law"), ("m", 1, 2, "法"), ("m", 2, 3, "loi"), ("m", 3, 4, "Recht"), ("m", 4, 5, "droit"), ("m", 5, 6, "diritto"), ("o", 0, 1, " contract "), ("o", 1, 2, "合同"), ("o", 2, 3, "a"), ("o", 3, 4, None)], "path string, pos int, lang_id int, term string")
    pairs = termbases.term_pairs(termbases.termbase_terms(concepts, langs, terms))
    assert {(r.path, r.source_term, r.target_term, r.lang_pair) for r in pairs.collect()} == {("o", "合同", "contract", "zh→en"), ("m", "法", "law", "zh→en"), ("m", "法", "loi", "zh→fr"), ("m", "Recht", "droit", "de→fr")}


def test_import_rows(spark):
    rows = [("f", 0, ["source_term", "target_term"]), ("f", 1, [" a ", "b"]), ("f", 2, ["A", "c", "", "d", "STRICT", "n"]), ("f", 3, ["x"]), ("f", 4, ["y", " "]), ("f", 5, ["a", "z", "en→zh", ""]), ("g", 0, ["p", "q"])]
    got = termbases.import_rows(spark.createDataFrame(rows, "path string, row long, fields array<string>"), "general").orderBy("path", "row").drop("path").collect()
    assert [tuple(r) for r in got] == [
        (2, "A", "c", "zh→en", "d", "strict", "n", False), (3, "x", "", "zh→en", "general", "preferred", None, True), (4, "y", "", "zh→en", "general", "preferred", None, True),
        (5, "a", "z", "en→zh", "general", "preferred", None, False), (0, "p", "q", "zh→en", "general", "preferred", None, False),
    ]
