"""Every operator on rows with nulls, ties, a long text and columns whose names are those that operators like to use."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, html_text, line_dedup, merkle, minhash, mixing, pii, quality_cnn, runs, secret_scan, substring_dedup, token_count, topk

NAMES = (
    "__tc_tokens", "__QC_score", "__qc_score_", "__ld_doc", "__ld_txt", "__ld_pos", "__ld_removed", "__dc_words", "__dc_hits", "__dc_items", "__nd_id", "__mx_doc", "__mx_source",
    "__mx_size", "__mx_row", "__mxr_size", "__pr_runs", "row", "base", "spans", "pos", "tree", "digest", "fp", "key", "doc", "n", "id",
)
LINES = "a line of words that stands in some documents\nand another line beside it"
LONG = " ".join(f"w{i % 4999}" for i in range(200_000))
ROWS = [(1, LINES, "s"), (2, LINES, "s"), (2, LINES, "s"), (None, LINES, None), (3, None, None), (4, "", "t"), (5, LONG, "t"), (6, "call +1 222 333 4444", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "en", 5, *([i] * len(NAMES))) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "nothing of this"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def model():
    return quality_cnn.train([b"good text", b"!!!"] * 20, __import__("numpy").array([1, 0] * 20))


@pytest.mark.parametrize("rows", (len(ROWS), 0))
def test_columns_pass(spark, docs, bench, model, rows):
    df = docs.limit(rows) if not rows else docs
    outs = [
        (token_count.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")), 1), (quality_cnn.score_quality(df, model), 1), (line_dedup.dedup_lines(df), 1),
        (decontaminate.mark_contamination(df, bench), 3), (decontaminate.decontaminate(df, bench), 0), (runs.mark_runs(df)[0], 3),
        (corpus_pipeline.lines(spark, df, ""), 0), (corpus_pipeline.near(spark, df, ""), 0),
    ]
    for out, more in outs:
        assert out.columns[: len(df.columns)] == df.columns and len(out.columns) == len(df.columns) + more
        got = out.select(*df.columns).collect()  # every column can be read by its name
        assert all(r["row"] == r["__ld_pos"] == r["__qc_score_"] for r in got)
        assert len(got) <= rows and (rows == 0 or len(got) > 4)


@pytest.mark.parametrize("rows", (len(ROWS), 0))
def test_rows_are_whole(spark, docs, rows):
    df = docs.limit(rows) if not rows else docs
    leaves = df.select(F.col("lang").alias("tree"), "doc_id", merkle.leaf_digests(df).alias("digest")).withColumn("now", F.col("digest"))
    assert merkle.verify(merkle.build_manifest(leaves)).where("verified").count() == rows
    for out in (pii.find_pii(df), secret_scan.scan_secrets(df), minhash.near_duplicates(df), substring_dedup.dedup_substrings(df), mixing.mix_sources(df)):
        assert out.count() == rows


def test_mix_keeps_columns(spark, docs):
    out = corpus_pipeline.mix(spark, docs.drop("size"), "")
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(ROWS)
    assert all(r["row"] == r["__mx_row"] for r in out.select(*docs.columns).collect())


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "<html><p>some text of a page</p>" + "<p>more words of it</p>" * 20_000, 4)], "page_id long, url string, html string, __ht_x int")
    got = {r.page_id: r["__ht_text"] for r in html_text.extract_text(pages).collect()}
    assert got[1] == "" and got[2].endswith("more words of it") and len(got[2]) > 300_000
    vectors = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, None, 2), (3, [0.5, 0.125], 3), (50, [1.0, 0.5], 4)], "vec_id long, embedding array<float>, query_id int")
    ints = topk.quantised(vectors)
    assert ints.count() == 3
