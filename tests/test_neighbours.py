"""Nearest neighbours by blocks: the same rows as exhaustive comparison, and work that grows with the table."""

import numpy as np
import pytest

from graphloom.catalog import QUERIES
from graphloom.operators import knn


def shuffled(spark, run):
    """MB that ``run`` writes to shuffles and spills."""
    sc = spark.sparkContext._jsc.sc()
    spark.sparkContext.setJobGroup("shuffled", "shuffled")
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup("shuffled"))
    run()
    sc.listenerBus().waitUntilEmpty()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("shuffled") if j not in before]
    stages = {s for j in jobs for s in j.stageIds if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks}
    told = [sc.statusStore().lastStageAttempt(s) for s in stages]
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in told) / 1e6


@pytest.mark.parametrize("name", ["knn_graph", "fitted_graph", "fuzzy_collapse", "fuzzy_mass"])
def test_shuffle_grows_with_the_table(spark, tmp_path, name):
    """Blocks that each met every block grew it nine times for three times the points."""
    rng, mb = np.random.default_rng(5), []
    for n in (4_000, 12_000):
        rows = [(i, v) for i, v in enumerate(rng.standard_normal((n, 16)).tolist())]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        mb.append(shuffled(spark, lambda n=n: QUERIES[name](spark, f"{tmp_path}/{n}").collect()))
    assert 0 < mb[0] and mb[1] < 4 * mb[0], mb


@pytest.mark.parametrize("block_rows", [1, 7, 4096])
def test_neighbours_are_those_of_exhaustive_comparison(spark, block_rows):
    """Copies, ties, vectors of several lengths, ids that repeat, and rows without an id or a vector."""
    rng = np.random.default_rng(6)
    vectors = [rng.integers(0, 3, 3).astype(float).tolist() for _ in range(40)] + [rng.standard_normal(2).tolist() for _ in range(9)]
    rows = [(i * 3 % 49, v) for i, v in enumerate(vectors)] + [(100, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 2.0]), (101, None), (None, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v is not None]
    found = {}
    for i, v in kept:
        found.setdefault(i, []).extend((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in kept if j != i and len(v) == len(w))
    wanted = sorted((i, j, d, r) for i, near in found.items() for r, (d, j) in enumerate(sorted(near)[:4]))
    assert sorted(map(tuple, knn.knn_edges(points, 4, block_rows=block_rows).collect())) == wanted
    assert knn.knn_edges(points.limit(1), 4, block_rows=block_rows).count() == 0


def test_a_block_stays_small_whatever_comes(spark):
    """A point at the same place as all others has as many ties as there are points."""
    points = spark.range(3_000).selectExpr("id", "array(1.0D, 2.0D) as vector")
    got = knn.knn_edges(points, 2).groupBy("src").agg({"dst": "max", "distance": "max"}).collect()
    assert len(got) == 3_000 and all(r["max(dst)"] <= 2 and r["max(distance)"] == 0 for r in got)
