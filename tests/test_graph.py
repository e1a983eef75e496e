import pytest
from helpers import column, graph, ids

from graphloom.graph import Graph, GraphError
from graphloom.operators import attributes, select, traverse


def test_mutations(spark):
    g = graph(spark, 4, [(0, 1), (1, 2), (2, 3), (2, 3)])
    assert ids(g.add_nodes(2).nodes) == [0, 1, 2, 3, 4, 5]
    assert ids(g.remove_nodes([2, 99]).edges) == [0]
    assert ids(g.remove_edges([1, 99]).edges) == [0, 2, 3]
    assert g.add_edges([(3, 3), (0, 1)]).edges.count() == 6
    with pytest.raises(GraphError):
        g.add_edges([(0, 9)])
    with pytest.raises(GraphError):
        g.add_nodes(0)
    c = g.remove_nodes([1]).compact("old")
    assert column(c.nodes, "old") == [0, 2, 3] and [tuple(r) for r in c.edge_pairs().orderBy("id").collect()] == [(0, 1, 2), (1, 1, 2)]
    assert [r["active"] for r in g.active("node", [3, 7]).orderBy("pos").collect()] == [True, False]
    assert tuple(g.valid_range("node").first()) == (0, 4)
    assert tuple(Graph.empty(spark).valid_range("node").first()) == (0, 0)


def test_attributes(spark):
    g = graph(spark, 3, [(0, 1)]).define_attribute("node", "w", "float").define_attribute("node", "xy", "float", 2).define_attribute("node", "s", "string")
    assert [tuple(r) for r in g.nodes.orderBy("id").collect()][0] == (0, 0.0, [0.0, 0.0], None)
    g = g.set_values("node", "w", spark.createDataFrame([(1, 2.5)], "id long, value float"))
    assert column(g.nodes, "w") == [0.0, 2.5, 0.0] and g.get_value("node", "w", 1) == 2.5
    assert g.versions["node.w"] == 1
    with pytest.raises(GraphError):
        g.define_attribute("node", "w", "float")
    assert "w" not in g.remove_attribute("node", "w").nodes.columns


def test_categories(spark):
    nodes = spark.createDataFrame(list(enumerate(["file10", "file2", "", None, "file2", "file02", "__NA__"])), "id long, g string")
    g = Graph(nodes, Graph.empty(spark).edges)
    assert column(attributes.categorize(g, "node", "g", "natural").nodes, "g") == [2, 0, -1, -1, 0, 1, -1]
    assert column(attributes.categorize(g, "node", "g", "frequency").nodes, "g") == [2, 0, -1, -1, 0, 1, -1]
    assert column(attributes.categorize(g, "node", "g", "none").nodes, "g") == [0, 1, -1, -1, 1, 2, -1]
    c = attributes.categorize(g, "node", "g", "alphabetical")
    assert c.dictionary("node", "g") == {"file02": 0, "file10": 1, "file2": 2, "__NA__": -1}
    assert column(attributes.decategorize(c, "node", "g").nodes, "g") == ["file10", "file2", "__NA__", "__NA__", "file2", "file02", "__NA__"]
    moved = attributes.set_dictionary(c, "node", "g", {"file2": 7}, remap=True)
    assert column(moved.nodes, "g") == [-1, 7, -1, -1, 7, -1, -1]


def test_multicategory(spark):
    g = graph(spark, 3, [(0, 1), (1, 2)])
    g = attributes.set_multicategory(g, "node", "tags", {0: ["alpha", "beta"], 2: ["beta"]})
    offsets, entries = attributes.multicategory_buffers(g, "node", "tags")
    assert [(r["id"], r["offset"], r["stop"]) for r in offsets.orderBy("id").collect()] == [(0, 0, 2), (1, 2, 2), (2, 2, 3)]
    assert [r["category"] for r in entries.orderBy("at").collect()] == [0, 1, 1]


def test_node_to_edge(spark):
    g = graph(spark, 2, [(0, 1)])
    g = g.with_attribute("node", "x", g.nodes["id"].cast("double"))
    assert column(attributes.node_to_edge(g, "x", "e").edges, "e") == [[0.0, 1.0]]
    assert column(attributes.node_to_edge(g, "x", "e", "dst").edges, "e") == [1.0]
    assert column(attributes.node_to_edge(g, "x", "e", "dst", duplicate=True).edges, "e") == [[1.0, 1.0]]


def test_traversal(spark):
    g = graph(spark, 6, [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 5)], True)
    nodes, edges = traverse.neighbors(g, [0, 1], "out", include_sources=False)
    assert ids(nodes) == [2, 3] and edges.count() == 3
    assert ids(traverse.neighbors(g, [5], "in")[0]) == [3, 4]
    nodes, edges = traverse.neighbors_at_level(g, [0], 2, "out")
    assert ids(nodes) == [3, 4] and edges.count() == 2
    nodes, edges = traverse.neighbors_up_to_level(g, [0], 2, "out")
    assert ids(nodes) == [1, 2, 3, 4] and edges.count() == 4
    nodes, edges = traverse.neighbors_at_level(g, [0], 0, "out", include_sources=True)
    assert ids(nodes) == [0] and edges.count() == 0


def test_subgraphs(spark):
    nodes = spark.createDataFrame([(0, 2018), (1, 2019), (2, 2020), (3, 2021)], "id long, year int")
    edges = spark.createDataFrame([(0, 0, 1, 10.0), (1, 1, 2, 20.0), (2, 2, 3, 30.0), (3, 0, 3, 40.0)], "id long, src long, dst long, score float")
    g = Graph(nodes, edges)
    f = select.filter_subgraph(g, "year >= 2020", "score >= 20")
    assert ids(f.nodes) == [2, 3] and ids(f.edges) == [2]
    f = select.filter_subgraph(g, node_selection=g.ids_frame([0, 2, 3]), edge_selection=g.ids_frame([0, 2, 3]))
    assert [r["id"] for r in select.order_by(g, "node", f.nodes, "-id").collect()] == [3, 2, 0]
    assert [r["id"] for r in select.order_by(g, "edge", f.edges, ("score", "desc")).collect()] == [3, 2]
    h = graph(spark, 7, [(0, 1), (1, 2), (3, 4)])
    assert ids(select.filter_subgraph(h, min_component_size=2).nodes) == [0, 1, 2, 3, 4]
    assert ids(select.filter_subgraph(h, min_component_size=3).edges) == [0, 1]
    f = select.filter_subgraph(h, edge_selection=h.ids_frame([0, 2]), min_component_size=2)
    assert ids(f.nodes) == [0, 1, 3, 4]


def test_ordering_puts_odd_values_last(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0), (3, float("inf"))], "id long, x double")
    g = Graph(nodes, Graph.empty(spark).edges)
    assert [r["id"] for r in select.order_by(g, "node", nodes, "x").collect()][:2] == [0, 2]
    assert [r["id"] for r in select.order_by(g, "node", nodes, "-x").collect()][:2] == [2, 0]


def test_natural_order_has_no_limit(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.natural import natural_key, natural_order

    texts = ["a" + "9" * n for n in (1, 29, 30, 31, 45)] + ["a1" + "0" * 44, "a007", "a7", "a07", "a", "", "b2", "b10", "a7-2", "a7-10"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["t"] for r in frame.orderBy(natural_order(F.col("t"))).collect()] == sorted(texts, key=natural_key)


def test_rows_without_entries_have_empty_ranges(spark):
    from graphloom.operators import attributes

    g = graph(spark, 4, [(0, 1)]).define_attribute("node", "tags", "multicategory")
    g = attributes.set_multicategory(g, "node", "tags", {1: ["a", "b"], 3: ["b"]})
    offsets, entries = attributes.multicategory_buffers(g, "node", "tags")
    assert [tuple(r) for r in offsets.orderBy("id").collect()] == [(0, 0, 0), (1, 0, 2), (2, 2, 2), (3, 2, 3)]
    assert entries.count() == 3


def test_dictionaries_are_read_when_asked_for(spark):
    from graphloom.operators import attributes

    nodes = spark.createDataFrame([(0, "x10"), (1, "x9"), (2, None), (3, "")], "id long, kind string")
    g = attributes.categorize(Graph(nodes, Graph.empty(spark).edges), "node", "kind", "natural")
    assert g.categories["node", "kind"]._known is None
    assert g.dictionary("node", "kind") == {"x9": 0, "x10": 1, attributes.MISSING: -1}
    assert [r["kind"] for r in attributes.decategorize(g, "node", "kind").nodes.orderBy("id").collect()] == ["x10", "x9", attributes.MISSING, attributes.MISSING]


def test_derived_and_mapped_attributes(spark):
    g = graph(spark, 3, [(0, 1), (1, 2)]).define_attribute("node", "x", "double").map_attribute("node", "x", lambda current, i: current + i, "double")
    d = g.derive_edge_attribute("x", "xs")
    assert [r["xs"] for r in d.edge_view().orderBy("id").collect()] == [[0.0, 1.0], [1.0, 2.0]]
    assert g.versions["node.x"] == 1
    with pytest.raises(GraphError):
        g.derive_edge_attribute("none", "y")


def test_attribute_info_and_arrays(spark):
    g = graph(spark, 3, []).define_attribute("node", "v", "float", 3)
    info = g.attribute_info("node", "v")
    assert info["vector"] and info["version"] == 0 and g.attribute_names("node") == ["v"]
    assert g.add_edges_from_arrays([0, 1], [1, 1]).edges.count() == 2
    with pytest.raises(GraphError):
        g.add_edges_from_arrays([0], [])
