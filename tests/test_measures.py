import pytest
from helpers import column, graph, ids

from graphloom import testgraphs
from graphloom.catalog import QUERIES
from graphloom.graph import Graph, GraphError
from graphloom.operators import communities, generators, iterative, knn, measures


def test_degree_and_strength(spark):
    star = graph(spark, 4, [(0, 1, 2.0), (0, 2, 3.0), (0, 3, 4.0)], False, ", w double")
    assert column(measures.degree(star), "degree") == [3, 1, 1, 1]
    assert column(measures.strength(star, "w"), "strength") == [9, 2, 3, 4]
    assert column(measures.strength(star, "w", measure="avg"), "strength")[0] == 3
    two = graph(spark, 3, [(0, 1, 2.0), (2, 1, 5.0)], True, ", w double")
    assert column(measures.degree(two, "in"), "degree")[1] == 2 and column(measures.degree(two, "out"), "degree") == [1, 0, 1]
    assert column(measures.strength(two, "w", "in"), "strength")[1] == 7
    assert column(measures.degree(graph(spark, 1, [(0, 0)])), "degree") == [2]
    with pytest.raises(GraphError):
        measures.strength(two, "missing")


@pytest.mark.parametrize("variant", ["unweighted", "onnela", "newman"])
def test_clustering(spark, variant):
    assert column(measures.clustering(graph(spark, 3, [(0, 1), (1, 2), (0, 2)]), None, variant), "clustering") == pytest.approx([1, 1, 1])
    twice = column(measures.clustering(graph(spark, 3, [(0, 1), (1, 2), (0, 2), (0, 2)]), None, variant), "clustering")
    # parallel edges add up, while Onnela's weights are measured by the largest single edge
    assert twice == pytest.approx([2 ** (1 / 3)] * 3 if variant == "onnela" else [1, 1, 1])
    assert column(measures.clustering(graph(spark, 3, [(0, 1), (1, 2)]), None, variant), "clustering") == [0, 0, 0]


def test_betweenness(spark):
    path = graph(spark, 4, [(0, 1), (1, 2), (2, 3)])
    assert column(iterative.betweenness_centrality(path), "betweenness") == pytest.approx([0, 2 / 3, 2 / 3, 0])
    diamond = graph(spark, 4, [(0, 1, 1.0), (1, 3, 1.0), (0, 2, 1.0), (2, 3, 10.0)], False, ", w double")
    whole = column(iterative.betweenness_centrality(diamond, "w", normalize=False), "betweenness")
    assert whole[1] > whole[2]
    half = iterative.betweenness_centrality(diamond, "w", [0, 1], normalize=False).withColumnRenamed("betweenness", "value")
    assert column(iterative.betweenness_centrality(diamond, "w", [2, 3], normalize=False, prior=half), "betweenness") == pytest.approx(whole)


def test_cores_and_components(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)])
    assert column(iterative.coreness(g), "coreness") == [2, 2, 2, 1, 1, 0]
    session = iterative.Session(iterative._coreness_rounds(g, "both"))
    seen = []
    assert column(session.run(lambda phase, p: seen.append(p)), "coreness") == [2, 2, 2, 1, 1, 0] and seen == sorted(seen)
    d = graph(spark, 6, [(0, 1), (1, 0), (1, 2), (3, 4), (4, 3)], True)
    assert column(iterative.weak_components(d), "component") == [1, 1, 1, 2, 2, 3]
    assert column(iterative.strong_components(d), "component") == [1, 1, 2, 3, 3, 4]
    assert iterative.largest_component(d, "strong").edges.count() == 2
    sizes = [r["size"] for r in iterative.extract_components(d, "strong").select("rank", "size").distinct().orderBy("rank").collect()]
    assert sizes == [2, 2, 1, 1]
    labelled = graph(spark, 8, [(0, 1), (1, 2), (3, 4), (4, 5), (6, 7)])
    assert column(iterative.label_major_components(labelled, max_components=2, min_size=2), "label") == [1, 1, 1, 2, 2, 2, 0, 0]


def test_long_path_is_one_component(spark):
    n = 400
    order = [(i * 37) % n for i in range(n)]
    g = graph(spark, n, list(zip(order[:-1], order[1:], strict=True)))
    assert set(column(iterative.weak_components(g), "component")) == {1}


def test_eigenvector(spark):
    star = graph(spark, 5, [(0, i) for i in range(1, 5)])
    rows = iterative.eigenvector_centrality(star, max_iterations=256, tolerance=1e-8).orderBy("id").collect()
    assert rows[0]["x"] / rows[1]["x"] == pytest.approx(2, abs=0.05) and rows[0]["converged"] and rows[0]["eigenvalue"] == pytest.approx(2, abs=0.01)


def test_dimension(spark):
    torus = generators.lattice_2d(spark, 16, 16, periodic=True)
    rows = iterative.node_dimension(torus, [0], 3, "ls", 2).orderBy("r").collect()
    assert [r["volume"] for r in rows] == [1, 5, 13, 25] and rows[2]["dimension"] == 0 and rows[3]["dimension"] > 1.4
    with pytest.raises(GraphError):
        iterative.node_dimension(torus, [0], 3, "ce", 5)


def test_leiden(spark):
    cliques = graph(spark, 10, [(i, j) for b in (0, 5) for i in range(b, b + 5) for j in range(i + 1, b + 5)] + [(4, 5)])
    labels, q = communities.leiden_modularity(cliques, seed=11)
    assert column(labels, "community") == [0] * 5 + [1] * 5 and q > 0.4
    assert column(communities.leiden(cliques, local_links=4), "community") == [0] * 5 + [1] * 5


def test_leiden_finds_planted_blocks(spark):
    import numpy as np

    g = generators.stochastic_block_model(spark, [100] * 4, [[0.15 if i == j else 0.01 for j in range(4)] for i in range(4)], seed=42)
    found = np.array(column(communities.leiden(g, seed=42), "community"))
    truth = np.repeat(range(4), 100)
    joint = np.array([[np.mean((found == a) & (truth == b)) for b in range(4)] for a in set(found.tolist())])
    pa, pb = joint.sum(1), joint.sum(0)
    information = sum(joint[i, j] * np.log(joint[i, j] / pa[i] / pb[j]) for i in range(len(pa)) for j in range(4) if joint[i, j])
    assert 2 * information / (-(pa * np.log(pa)).sum() - (pb * np.log(pb)).sum()) > 0.9


@pytest.mark.parametrize(
    ("make", "nodes", "edges"),
    [
        (lambda s: generators.watts_strogatz(s, 10, 2, 0), 10, 20),
        (lambda s: generators.watts_strogatz(s, 30, 2, 1.0), 30, 60),
        (lambda s: generators.lattice_2d(s, 3, 4), 12, 17),
        (lambda s: generators.barabasi_albert(s, 10, 2, 3), 10, 17),
        (lambda s: generators.stochastic_block_model(s, [2, 3], [[1, 1], [1, 1]]), 5, 10),
        (lambda s: generators.configuration_model(s, [2, 2, 2, 2], self_loops=True, multi_edges=True), 4, 4),
        (lambda s: generators.random_geometric(s, 5, 2.0), 5, 10),
    ],
)
def test_generators(spark, make, nodes, edges):
    g = make(spark)
    assert (g.nodes.count(), g.edges.count()) == (nodes, edges)
    assert sorted(map(tuple, g.edge_pairs().collect())) == sorted(map(tuple, make(spark).edge_pairs().collect()))


def test_rewired_edges_are_far(spark):
    pairs = [(r["src"], r["dst"]) for r in generators.watts_strogatz(spark, 30, 2, 1.0, seed=3).edges.collect()]
    assert all(min((a - b) % 30, (b - a) % 30) > 2 for a, b in pairs) and len({tuple(sorted(p)) for p in pairs}) == 60


def test_neighbour_graphs(spark):
    fuzzy = spark.createDataFrame([(0, 1, 0.4), (1, 0, 0.6), (1, 2, 0.5), (2, 1, 0.3)], "src long, dst long, weight double")
    assert sorted(map(tuple, knn.collapse(fuzzy).collect())) == [(0, 1, 0.6), (1, 2, 0.5)]
    rows = spark.createDataFrame([(0, [1, 2], [0.1, 0.4]), (1, [0, 2], [0.1, 0.2]), (2, [1, 0], [0.2, 0.4])], "src long, indices array<long>, distances array<double>")
    g = knn.supplied_knn(spark.range(3), rows)
    assert g.edges.count() == 6 and sorted(set(column(g.edges, "umap_knn_rank"))) == [0, 1]


def test_betweenness_weighted_runs_from_all_nodes(spark, data):
    import heapq

    g = testgraphs.trade(spark, data, sparse=True)
    nodes, out = ids(g.nodes), {}
    for r in g.edges.where("src <> dst").collect():
        out.setdefault(r["src"], []).append((r["dst"], r["weight"]))
    dist, paths = {}, {}
    for s in nodes:
        d, heap, order = {}, [(0, s)], []
        while heap:
            x, v = heapq.heappop(heap)
            if v not in d:
                d[v] = x
                order.append(v)
                for u, w in out.get(v, ()):
                    heapq.heappush(heap, (x + w, u))
        k = dict.fromkeys(order, 0) | {s: 1}
        for v in order:
            for u, w in out.get(v, ()):
                k[u] += k[v] * (d[v] + w == d[u])
        dist[s], paths[s] = d, k
    n, wanted = len(nodes), []
    for v in nodes:
        through = ((s, t) for s in nodes if s != v and v in dist[s] for t in dist[s] if t not in (s, v) and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t])
        wanted.append(sum(paths[s][v] * paths[v][t] / paths[s][t] for s, t in through) / ((n - 1) * (n - 2)))
    assert column(QUERIES["betweenness_weighted"](spark, data), "betweenness") == pytest.approx(wanted, abs=1e-6)
    assert sum(x > 0 for x in wanted) > 3


def test_long_paths_take_few_rounds(spark, monkeypatch):
    from graphloom.scratch import Scratch

    writes, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: writes.append(name) or save(self, df, name))
    n = 10_000
    pairs = spark.range(n - 1).selectExpr("id", "id as src", "id + 1 as dst")
    chain = Graph(spark.range(n), pairs, True)
    assert iterative.strong_components(chain).agg({"component": "max"}).first()[0] == n
    assert len(writes) <= 40
    writes.clear()
    assert {r["coreness"] for r in iterative.coreness(chain).select("coreness").distinct().collect()} == {1}
    assert len(writes) <= 40
    writes.clear()
    ends = iterative.betweenness_centrality(chain, sources=[0, 5]).where("id in (1, 6, 9999)").orderBy("id").collect()
    assert [round(r["betweenness"] * (n - 1) * (n - 2)) for r in ends] == [n - 2, 2 * (n - 7), 0] and len(writes) <= 40


def test_results_do_not_depend_on_where_one_task_takes_over(spark):
    import random

    rng = random.Random(12)
    pairs = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 4))) for _ in range(150)]
    g = graph(spark, 60, pairs, True, ", w double")
    assert column(iterative.strong_components(g, local_links=10), "component") == column(iterative.strong_components(g), "component")
    assert column(iterative.coreness(g, local_links=25), "coreness") == column(iterative.coreness(g), "coreness")
    for weight in (None, "w"):
        assert column(iterative.betweenness_centrality(g, weight, local_links=5), "betweenness") == pytest.approx(column(iterative.betweenness_centrality(g, weight), "betweenness"))


def test_known_cores(spark):
    """Cliques of 2 to 9 nodes in a row, each linked to the next one by an edge."""
    pairs, first = [], 0
    expected = []
    for size in range(2, 10):
        pairs += [(first + i, first + j) for i in range(size) for j in range(i)]
        if first:
            pairs.append((first - 1, first))
        expected += [size - 1] * size
        first += size
    assert column(iterative.coreness(graph(spark, first, pairs), local_links=20), "coreness") == expected


def test_sessions_equal_one_call_and_can_be_cancelled(spark):
    g = graph(spark, 8, [(0, 1), (1, 2), (2, 0), (3, 4), (5, 6)], True)
    for session, whole in (
        (iterative.component_session(g), iterative.weak_components(g)),
        (iterative.component_session(g, "strong"), iterative.strong_components(g)),
        (iterative.coreness_session(g), iterative.coreness(g)),
        (communities.leiden_session(g, seed=1), communities.leiden(g, seed=1)),
        (iterative.dimension_session(g, None, 3), iterative.node_dimension(g, None, 3)),
    ):
        steps = 0
        while not session.step():
            steps += 1
            assert 0 <= session.progress <= 1
        assert steps > 0 and sorted(map(tuple, session.result().collect())) == sorted(map(tuple, whole.collect()))
    session = iterative.component_session(g)
    session.step()
    session.cancel()
    with pytest.raises(GraphError):
        session.step()
    with pytest.raises(GraphError):
        session.result()


def test_dimension_profiles(spark):
    ring = graph(spark, 9, [(i, (i + 1) % 9) for i in range(9)])
    rows = iterative.node_dimension(ring, [0], 3, "backward", 1)
    vector, text = (iterative.dimension_profiles(rows, e).first() for e in ("vector", "string"))
    assert vector["profile"] == pytest.approx([0, 1, 4 / 5, 6 / 7]) and vector["max_dimension"] == 1
    assert text["profile"] == "[0.0,1.0,0.8,0.857143]"


def test_selector_degree_and_incident_edges(spark):
    g = graph(spark, 4, [(0, 1), (0, 1), (1, 2), (3, 3)], False)
    some = spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "pos long, id long")
    assert [(r["pos"], r["id"], r["degree"]) for r in measures.selector_degree(g, some).orderBy("pos").collect()] == [(0, 1, 3), (1, 0, 2), (2, 3, 2)]
    assert ids(measures.incident_edges(g, some.where("id <> 3"))) == [0, 1, 2]


def test_nearest_of_other_points(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)] + [(9, None)], "id long, vector array<double>")
    g = knn.transform_queries(points, spark.createDataFrame([(0, [2.2, 0.0]), (1, [9.0, 0.0])], "id long, vector array<double>"), 2)
    assert sorted((r["src"], r["dst"], r["umap_knn_rank"]) for r in g.edges.collect()) == [(10, 2, 0), (10, 3, 1), (11, 3, 1), (11, 4, 0)]
    assert {r["id"] for r in g.nodes.where("is_query").collect()} == {10, 11}
    assert knn.transform_graph(points, points.limit(1), spark.createDataFrame([(0, 1)], "src long, dst long")).edges.first()["dst"] == 1
    cells = knn.knn_edges(points, 2, block_rows=2)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, knn.knn_edges(points, 2).collect()))
    assert knn.knn_edges(points.limit(0), 2).count() == 0


def test_other_generators(spark):
    assert generators.erdos_renyi(spark, 50, 1.0).edges.count() == 50 * 49 // 2
    assert generators.small_world(spark, 30, 2, 0.0).edges.count() == 60
    assert 0 < generators.waxman(spark, 40, seed=1).edges.count() < 40 * 39 // 2
