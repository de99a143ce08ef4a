import os
import random

import pytest
from pyspark.sql import functions as F

from textloom import plans
from textloom.functions.json_repair import ocr_items
from textloom.sources import bundle, text_files
from textloom.streaming import limiter

SF = "/root/testdata/sf0.001"


def test_charsets(spark, tmp_path):
    want = {"a": b"\xef\xbb\xbf" + "¡Hola!".encode(), "b": "你好".encode("gb18030"), "c": "plain é".encode(), "d": b"\xff\xff", "e": b""}
    for k, v in want.items():
        (tmp_path / k).write_bytes(v)
    got = {os.path.basename(r.path): r.text for r in text_files.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "¡Hola!", "b": "你好", "c": "plain é", "d": "ÿÿ"}


def blocks(text):
    out, buf, fenced = [], None, False
    for x in text.split("\n"):
        fence = x.strip(" ").startswith("```")
        if fence or fenced or not x.strip(" "):
            if buf is not None:
                out.append((buf, True))
            buf = None
            out.append((x, False))
            fenced ^= fence
        else:
            buf = x if buf is None else buf + "\n" + x
    return out if buf is None else [*out, (buf, True)]


@pytest.mark.parametrize("text", ["", "a\nb\n\nc", "a\n```py\nx\n\ny\n```\nb", "\n\n", "```\nopen"])
def test_markdown(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(text_files.markdown_blocks(F.col("t"))).first()[0]
    assert [tuple(x) for x in got] == blocks(text)


def test_markdown_random(spark):
    rng = random.Random(5)
    line = ["a", "b c", "", "  ", "```", "  ```py", "x ``` y", "\r", "c\u2028d", "é", "``", "\t"]
    texts = ["\n".join(rng.choice(line) for _ in range(rng.randrange(12))) for _ in range(600)]
    texts += ["\n".join(rng.choice(line) for _ in range(100_000)), "\n".join(["a"] * 100_000)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text_files.markdown_blocks(F.col("t")).alias("b")).collect()
    assert {r.i: [tuple(x) for x in r.b] for r in got} == {i: blocks(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(text_files.markdown_blocks(F.col("t"))).first()[0] is None


def test_markdown_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()
    rows = plans.queries()["s7_markdown_blocks"](spark, SF).orderBy("doc_id", "block").collect()
    assert [(r.doc_id, r.text, r.translatable) for r in rows] == [(d.doc_id, *b) for d in sorted(docs, key=lambda d: d.doc_id) for b in blocks(d.text)]


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, ""), (3, None)], "k int, v string")
    bundle.export({"t": df}, str(tmp_path / "b"))
    assert sorted(map(tuple, bundle.load(spark, str(tmp_path / "b"), {"t": "k int, v string"})["t"].collect())) == sorted(map(tuple, df.collect()))
    part = next(p for p in (tmp_path / "b" / "t").iterdir() if p.name.startswith("part-"))
    part.write_bytes(part.read_bytes() + b"9,x\n")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(bundle.BundleError):
        bundle.load(spark, str(tmp_path / "b"), {"t": "k int, v string"})


@pytest.mark.parametrize("answer, want", [
    (None, []), ("", []), ("nothing", []), ("[]", []), ('[{"bbox": [1, 2, 3], "text": "a"}, {"bbox": [1, 2, 3, 4], "text": " "}]', []),
    ('```json\n[{"bbox": [1, 2, 3, 4.5], "text": "a"}]\n```', [([1, 2, 3, 4.5], "a")]),
    ('[{"bbox": [[1, 2, 3, 4, "text": "a"},]', [([1, 2, 3, 4], "a")]),
    ('[{"bbox": [1, 2, 3, 4], "text": "a"}, {"bbox": [5', [([1, 2, 3, 4], "a")]),
    ('{"bbox": [1, 2, 3, 4], "text": "a"}', []), ('{"bbox": 1, 2, 3, 4, "text": "a"}', [([1, 2, 3, 4], "a")]),
    ('"bbox": [1, 2, 3, 4], "text": "a"\n"bbox": [5, 6, 7, 8], "text": "b"', [([1, 2, 3, 4], "a"), ([5, 6, 7, 8], "b")]),
])
def test_repair(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(ocr_items(F.col("a"))).first()[0]
    assert [(x.bbox, x.text) for x in got] == want


def decide(tries, window, most, lock):
    """Plain rule: list of failures since the window's anchor, one key."""
    fails, locked, out = [], None, {}
    for i, t, bad in sorted(tries, key=lambda x: (x[1], x[0])):
        if locked is not None and t < locked:
            out[i] = "rejected"
            continue
        if not bad:
            fails, locked, out[i] = [], None, "success"
            continue
        fails = [*fails, t] if fails and t < fails[0] + window else [t]
        out[i] = "failure"
        if len(fails) >= most:
            fails, locked, out[i] = [], t + lock, "locked"
    return out


def test_limiter(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('error', 'signup')").withColumn("g", F.col("user_id") % 3)
    want, groups = {}, {}
    for r in ev.collect():
        groups.setdefault(r.g, []).append((r.event_id, r.ts.timestamp(), r.event_type == "error"))
    for g in groups.values():
        want |= decide(g, 90000, 4, 40000)
    got = {r.event_id: r.decision for r in limiter.limit_attempts(ev, "g", F.col("event_type") == "error", 90000.0, 4, 40000.0).collect()}
    assert got == want and {"rejected", "locked", "failure", "success"} == set(got.values())
