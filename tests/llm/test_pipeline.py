"""The pipeline's stages, and the entry points with and without this subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from pairstrand.llm import stages

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels only: stages take their documents from the stage before."""
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_columns_and_take_odd_rows(spark, docs, no_docs, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for what, given in (("odd", docs), ("none", no_docs)):
            out = stage(spark, given, folder)
            out.write.parquet(str(tmp_path / f"{k}-{what}"))
            if name != "packing":
                assert out.columns == given.columns
                assert out.count() <= given.count()


def test_decisions_take_effect(spark, docs, folder):
    exact = stages.exact_stage(spark, docs, folder)
    near = stages.near_stage(spark, exact, folder)
    assert 9 in {r["doc_id"] for r in exact.collect()}
    kept = [r["doc_id"] for r in near.collect()]
    assert not {8, 9} <= set(kept)  # near copies of each other
    cut = {r["doc_id"]: r for r in stages.suffix_stage(spark, docs, folder).collect()}
    assert cut[13]["text"] == "" and cut[13]["n_chars"] == 0
    assert cut[1]["text"] is None and cut[4]["text"] == "one"


def test_suffix_stage_drops_cut_characters(spark, folder):
    passage = "".join(f"{i:04d}é" for i in range(100))
    df = spark.createDataFrame([(1, "ü" + passage + "tail"), (2, "x" + passage + "end")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in stages.suffix_stage(spark, df, folder).collect()}
    assert got == {1: "ütail", 2: "xend"}


def test_suffix_stage_empties_copies_that_share_a_passage(spark, folder):
    passage = "".join(f"{i:04d}" for i in range(100))
    copy = "".join(f"<{i}>" for i in range(500, 600)) + passage
    df = spark.createDataFrame([(1, copy), (2, copy), (3, "x" + passage + "end")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in stages.suffix_stage(spark, df, folder).collect()} == {1: "", 2: "", 3: "xend"}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")}


def test_entry_works_without_the_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline file still imports, with the other queries."""
    import shutil

    shutil.copytree(ROOT / "pairstrand", tmp_path / "pairstrand", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
