"""The pipeline's stages on odd rows, and on the smallest tables against brute force."""

import corpus_pipeline as cp
import pytest

from graphloom.llm import toxicity
from graphloom.llm.catalog import QUERIES

from .test_documents import brute_components


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('sf')}"
    docs.write.parquet(f"{where}/documents.parquet")
    marks = [(i, 0, int(60 <= i < 70)) for i in range(70)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_take_odd_rows_and_keep_columns(spark, docs, clashing, empty, sf_dir):
    for frame in (docs, clashing, empty):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, frame, sf_dir)
            assert out.columns == frame.columns, name
            assert out.count() <= 2 * frame.count()
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_near_duplicates_leave_one_each(spark, docs, rows, sf_dir):
    kept = cp.drop_near_duplicates(spark, docs, sf_dir).collect()
    named = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    expected = brute_components(rows, 5, 80)
    assert sorted(set(named)) == sorted({i for i, c in expected.items() if i == c})
    assert len(named) == len(set(named)) + 1  # one id has two texts that are unlike
    assert sum(r["doc_id"] is None for r in kept) == sum(r[0] is None for r in rows)


def test_toxic_documents_go(spark, docs, sf_dir):
    kept = {r["doc_id"] for r in cp.drop_toxic(spark, docs, sf_dir).collect()}
    scores = toxicity.score_documents(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"]).collect()
    assert kept == {r["doc_id"] for r in scores if r["score"] < 0.3}


def test_whole_pipeline(spark, data):
    out = QUERIES["pipeline"](spark, data)
    assert {"doc_id", "ids", "n_pieces"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "sentencepiece"]
