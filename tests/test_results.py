"""Files in and out, answers of models, paths: small cases against plain code."""

import base64
import json
import os
import posixpath
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import assets, enrich, recognise, render, validate
from quire.sinks import files as sinks
from quire.sources import files, payload


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_files_are_typed_and_read(spark, tmp_path):
    for name in ("a.PDF", "b.b.jpeg", "sub/c.png", "d.txt", "e"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    taken, rejected = files.scan(spark, str(tmp_path / "in"))
    assert rows(taken, "file_name", "file_type") == [("a.PDF", "pdf"), ("b.b.jpeg", "image"), ("c.png", "image")]
    assert {bytes(r["content"]) for r in taken.collect()} == {b"a.PDF", b"b.b.jpeg", b"sub/c.png"}
    assert {os.path.basename(r["path"]): r["reject"] for r in rejected.collect()} == {"d.txt": "unsupported type .txt", "e": "unsupported type "}
    counts = taken.filter("file_type = 'pdf'").select("path", F.lit(3).alias("total_pages"))
    assert rows(files.pages(taken, counts), "file_name", "page") == [("a.PDF", 1), ("a.PDF", 2), ("a.PDF", 3), ("b.b.jpeg", 1), ("c.png", 1)]


def test_payload_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.json").write_text('{"elements":\n[{"text": "hello", "type": "Text"}]}')
    (tmp_path / "two.json").write_text('{"content": "alone"}')
    (tmp_path / "three.txt").write_text("no")
    found = payload.elements(payload.sources(files.payload_files(spark, str(tmp_path))))
    assert rows(found, "doc_id", "id", "text") == [("one", "element_1", "hello"), ("two", "element_1", "alone")]


def test_results_are_written_and_read(spark, tmp_path):
    out = str(tmp_path)
    df = spark.createDataFrame([(1, "# a\n\nb", "r"), (2, None, "r")], "doc_id long, markdown string, raw string")
    sinks.write_markdown(df, out)
    found = spark.read.text(f"{out}/markdown", wholetext=True).collect()
    assert sorted((r["doc"], r["value"].rstrip("\n")) for r in found) == [(1, "# a\n\nb"), (2, "")]
    sinks.write_report(df, out)
    assert "raw" not in spark.read.json(f"{out}/render_report").columns
    path = sinks.write_stage(df, out, "validated")
    assert path.endswith("05_validated") and spark.read.parquet(path).columns == ["doc_id", "markdown"]
    made = spark.createDataFrame([(1, "r1", "a\\b.png"), (1, "r2", "c/b.png"), (1, "r3", None), (2, "r1", "gone.png")], "doc_id long, ref_id string, path string")
    kept = spark.createDataFrame([("a/b.png", b"one"), ("c/b.png", b"two")], "path string, content binary")
    assert rows(sinks.service_images(made, kept), "doc_id", "filename", "data") == [(1, "b.png", base64.b64encode(b"one").decode())]
    text = spark.createDataFrame([("x ![a](p/q/r.png) ![](b.png) ![c](k\\l.png) (d/e)",), (None,)], "m string")
    assert [r[0] for r in text.select(sinks.by_file_name(F.col("m"))).collect()] == ["x ![a](r.png) ![](b.png) ![c](l.png) (d/e)", ""]


def test_relative_paths_like_posix(spark):
    rng = random.Random(1)
    part = lambda: "/".join(rng.choice(["a", "b", "..", ".", "c"]) for _ in range(rng.randint(1, 5)))
    cases = [(rng.choice(["", "/"]) + part(), "/" + part(), "/w/x") for _ in range(300)]
    got = spark.createDataFrame(cases, "p string, f string, b string").select("p", "f", assets.relative_path(F.col("p"), F.col("f"), F.col("b")).alias("r")).collect()
    for r in got:
        want = posixpath.relpath(posixpath.normpath(posixpath.join("/w/x", r["p"])), posixpath.normpath(r["f"]))
        assert r["r"] == want, r


@pytest.mark.parametrize("said,want", [("x [1, 2] y", "[1, 2]"), ("{a} {\"b\": [1]} {}", '{"b": [1]}'), ("none", None), (None, None), ("[" * 50_000, None), ('"{1}" [', None)])
def test_first_json(said, want):
    got = enrich.first_json(said)
    assert got == want and (got is None or json.loads(got) is not None)


def test_failures_warn_and_change_nothing(spark):
    class Fails:
        def generate_json(self, task, payload):
            raise RuntimeError(f"{task} is off")

    nodes = spark.createDataFrame([(1, "n1", 0, "한국어 문장은 영어가 아니며 충분히 길다"), (1, "n2", 1, "infor- mation in an english sentence")], "doc_id long, node_id string, pos int, text string")
    out = enrich.repair_contents(nodes, Fails, enrich.Config("content"))
    counts = out["counts"].collect()[0]
    assert counts["failed"] == counts["requests"] == counts["missing"] == 1 and counts["rule"] == 1
    assert rows(out["warnings"], "code", "detail") == [("llm_content_failed", "RuntimeError: content_repair is off")]
    assert rows(out["nodes"], "node_id", "new_text")[1] == ("n2", "information in an english sentence")
    off = enrich.repair_contents(nodes, Fails, enrich.Config())
    assert off["warnings"].count() == 0 and rows(off["nodes"], "new_text") == rows(nodes, "text")


def test_table_ids(spark):
    df = spark.createDataFrame([(2, "7"), (2, " x1 "), (3, None), (3, ""), (1, "7a")], "p int, g string")
    assert [r[0] for r in df.select(recognise.table_id(F.col("p"), F.col("g"))).collect()] == ["p2_table_7", "x1", "p3_table_unknown", "p3_table_unknown", "7a"]


def test_only_validated_documents_are_rendered():
    render.guarded("validated")
    for stage in ("structured", None):
        with pytest.raises(ValueError):
            render.guarded(stage)


def test_merged_warnings_keep_the_first(spark):
    schema = "doc_id long, nth int, level string, code string, page int, ids string, message string, metadata map<string,string>"
    a = spark.createDataFrame([(1, 0, "warning", "x", 1, "a", "m", {"k": "1", "j": "2"}), (1, 1, "warning", "y", None, "", "m", {})], schema)
    b = spark.createDataFrame([(1, 0, "warning", "x", 1, "a", "m", {"j": "2", "k": "1"}), (1, 1, "info", "x", 1, "a", "m", {"j": "2", "k": "1"})], schema)
    got = rows(validate.merged(a, b), "nth", "level", "code")
    assert got == [(1, "warning", "x"), (2, "warning", "y"), (3, "info", "x")]


def test_cleanup_counts_like_a_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", " ", "\n", "\n", "\t", "\r\n"], k=rng.randint(0, 14))) for _ in range(300)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", render.cleanup(F.col("t")).alias("c")).collect():
        lines = r["t"].replace("\r\n", "\n").split("\n")
        bare = [x.rstrip(" \t") for x in lines]
        kept = [x for k, x in enumerate(bare) if not (x == "" and k and bare[k - 1] == "")]
        inner = list(kept)
        while inner and inner[0] == "":
            inner.pop(0)
        while inner and inner[-1] == "":
            inner.pop()
        want = (sum(x != y for x, y in zip(lines, bare)), len(lines) - len(kept), len(kept) - len(inner), len(lines), len(inner)) if r["t"] else (0,) * 5
        assert tuple(r["c"]) == want, repr(r["t"])


def test_cleanup_takes_time_in_proportion(spark):
    many = 20_000
    texts = [("a \n\n\n" * many, (many, many + 1, 1, 3 * many + 1, 2 * many - 1)), ("x" + " " * 200_000 + "y", (0, 0, 0, 1, 1)), ("a \u2028\n b\t", (1, 0, 0, 2, 2)), ("a  \u0085", (0, 0, 0, 1, 1)), (None, (0,) * 5)]
    began = time.time()
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, t string").select("k", render.cleanup(F.col("t")).alias("c")).collect()
    assert time.time() - began < 30
    assert {r["k"]: tuple(r["c"]) for r in got} == {k: want for k, (_, want) in enumerate(texts)}
