"""The driver's contract."""

import importlib.util
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quire.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "markdown"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.ORACLE) >= 50


@pytest.mark.parametrize("name", ["q_layout_elements", "q_repeated_margins", "q_page_stats", "q_caption_links", "q_note_links", "q_paragraphs", "q_section_tree", "q_list_numbering", "q_validate_next", "q_warning_rollup", "q_render_document", "q_repair_guard", "q_grid_markdown", "q_payload_elements", "q_recognised_text", "q_payload_shapes", "q_payload_tables", "q_refs_merge", "q_caption_link_apply", "q_semantic_counts", "q_repair_counts", "q_single_repairs", "q_validate_parents", "q_validate_references", "q_render_warnings", "q_render_cleanup", "q_asset_paths", "q_stage_diff"])
def test_like_other_engine(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    other = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        other.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = other.execute(catalogue.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(row[k] for k in at) for row in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_grids_hold_whole_texts(spark, sf):
    texts = catalogue.grids(spark, sf)[0].select("table_id", "text_no", "text").collect()
    found = {}
    for r in texts:
        doc, part = r["table_id"].split("-")
        found.setdefault(int(doc), {})[int(part), r["text_no"]] = r["text"]
    for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").collect():
        got, want = [t for _, t in sorted(found[r["doc_id"]].items())], r["text"].split(" ")
        assert got[: len(want)] == want and set(got[len(want) :]) <= {""}


def test_grids_move_nothing(spark, sf):
    """A table's texts, rows and columns are one row; exchanges of single cells wrote several times the input."""
    df = catalogue.QUERIES["q_grid_markdown"](spark, sf)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_grids_of_odd_documents(spark, tmp_path):
    texts = [(1, ""), (2, "a"), (3, None), (4, " ".join(["w"] * 12)), (5, " ".join(f"w{k}" for k in range(13))), (None, "x y")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["table_id"]: r["markdown"] for r in catalogue.QUERIES["q_grid_markdown"](spark, str(tmp_path)).collect()}
    assert set(got) == {"1-0", "2-0", "4-0", "5-0", "5-1", None}
    assert got["5-1"].split("\n")[0] == "| w12 |  |  |" and got[None].split("\n")[0] == "| x | y |  |"


def test_hyphens_of_all_lines(spark, tmp_path):
    texts = [(1, "the infor-  mation here\nsee them a- b- c"), (2, "see th\nnothing\n\nX- y -z- Z"), (3, None), (4, "e the e th-\u2003en")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["pos"], r["repaired"]) for r in catalogue.QUERIES["q_hyphen_repair"](spark, str(tmp_path)).collect())
    mend = lambda t: re.sub(r"(?<=[A-Za-z])-\s+(?=[a-z])", "", t.replace("e th", "e- th"))
    assert got == [(i, k, mend(line)) for i, t in texts if t is not None for k, line in enumerate(t.split("\n"))]
    assert (1, 0, "the information here") in got


def test_answers_are_whole_lines(spark, tmp_path):
    texts = [(1, "a\nI think so\nxxx\nb\nVARCO VISION\n. and -"), (2, "c\nVARCOVISION\n_")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["q_recognised_text"](spark, str(tmp_path)).orderBy("doc_id", "pos").collect()
    assert [r["believed"] for r in got] == ["", "I think so", "", "", "", ". and -", "", "", ""]


def test_nothing_else_needs_the_optional_folder():
    if importlib.util.find_spec("quire.llm") is None:
        pytest.skip("it is gone already")
    code = "import sys; sys.modules['quire.llm'] = None\nimport quire.plans.catalogue, quire.streaming.landing, quire.sources.payload; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr
