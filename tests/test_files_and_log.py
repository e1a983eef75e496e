import os

import pytest
from helpers import column, graph, ids
from pyspark.sql import functions as F

from graphloom.graph import Graph, GraphError
from graphloom.operators import attributes
from graphloom.sources import binary, interchange, parquet, xnet
from graphloom.streaming import log, strength


@pytest.fixture(scope="module")
def rich(spark):
    nodes = spark.createDataFrame([(3, "a \"q\"\n", 1, 0.5, [1.0, 2.0], True), (5, "b", -2, 1.5, [3.0, 4.0], False), (9, None, 3, 2.5, [5.0, 6.0], True)], "id long, name string, n int, x double, v array<float>, flag boolean")
    edges = spark.createDataFrame([(0, 3, 5, 7, "u"), (2, 5, 9, 8, "w"), (4, 9, 9, 9, "u")], "id long, src long, dst long, weight long, kind string")
    g = Graph(nodes, edges, True, {"title": "demo"})
    g = attributes.categorize(g, "edge", "kind", "frequency")
    return attributes.set_multicategory(g, "node", "tags", {3: {"x": 0.25, "y": 0.75}, 9: {"y": 1.0}}, weighted=True)


def _same(g, h, names):
    assert h.directed == g.directed and [tuple(r)[1:] for r in h.edge_pairs().orderBy("id").collect()] == [(0, 1), (1, 2), (2, 2)]
    for n in names:
        assert column(h.nodes, n) == column(g.nodes, n), n
    assert column(h.edges, "weight") == [7, 8, 9]


def test_binary_containers(spark, rich, tmp_path):
    for write, read in ((binary.write_bxnet, binary.read_bxnet), (binary.write_zxnet, binary.read_zxnet)):
        write(rich, f"file://{tmp_path}/g")
        h = read(spark, f"file://{tmp_path}/g")
        _same(rich, h, ["name", "n", "x", "v", "flag"])
        assert h.attributes == {"title": "demo"} and h.categories == rich.categories
        assert column(h.nodes, "tags") == [[(0, 0.25), (1, 0.75)], [], [(1, 1.0)]]
    data = bytearray((tmp_path / "g").read_bytes())
    binary.write_bxnet(rich, f"file://{tmp_path}/h")
    data = bytearray((tmp_path / "h").read_bytes())
    data[80] ^= 1
    with pytest.raises(GraphError):
        binary.parsed(bytes(data))


def test_gt(spark, rich, tmp_path):
    binary.write_gt(rich, f"file://{tmp_path}/g.gt")
    h = binary.read_gt(spark, f"file://{tmp_path}/g.gt")
    _same(rich, h, ["n", "x", "v", "flag"])
    assert column(h.edges, "kind") == ["u", "w", "u"]


def test_text_formats(spark, rich, tmp_path):
    xnet.write_xnet(rich, f"file://{tmp_path}/g.xnet", ignore={"node": ["x"]})
    h = xnet.read_xnet(spark, f"file://{tmp_path}/g.xnet")
    _same(rich, h, ["n", "v"])
    assert "x" not in h.nodes.columns and column(h.nodes, "_original_ids_") == ["3", "5", "9"] and h.dictionary("edge", "kind") == {"u": 0, "w": 1}
    assert column(h.nodes, "name")[0] == 'a "q"\n' and h.attributes == {"title": "demo"}
    interchange.write_node_link(rich, f"file://{tmp_path}/g.json")
    h = interchange.read_node_link(spark, f"file://{tmp_path}/g.json")
    _same(rich, h, ["name", "n", "x", "flag"])
    with pytest.warns(UserWarning):
        interchange.write_gml(rich, f"file://{tmp_path}/g.gml")
    _same(rich, interchange.read_gml(spark, f"file://{tmp_path}/g.gml"), ["x"])


def test_parquet(spark, rich, tmp_path):
    parquet.write_parquet(rich, f"file://{tmp_path}/g")
    h = parquet.read_parquet(spark, f"file://{tmp_path}/g")
    assert h.categories == rich.categories and column(h.nodes, "name") == column(rich.nodes, "name")


def test_older_xnet(spark, tmp_path):
    text = '#vertices 3\n"A"\n"B"\n"C"\n#edges weighted directed\n0 1 1.25\n1 2 2.5\n#v "Legacy numeric" n\n1\n2\n3\n#v "Group__category" s\n"alpha"\n""\n"alpha"\n'
    (tmp_path / "g").write_text(text)
    g = xnet.read_xnet(spark, f"file://{tmp_path}/g")
    assert g.directed and column(g.nodes, "Label") == ["A", "B", "C"] and column(g.edges, "weight") == [1.25, 2.5]
    assert column(g.nodes, "Group") == [0, -1, 0] and g.dictionary("node", "Group") == {"alpha": 0, "__NA__": -1}


@pytest.mark.parametrize("text", ["#vertices x\n", "#XNET 2.0.0\n#vertices 1\n", "#XNET 1.0.0\n#vertices 2\n#edges directed\n0 5\n", '#XNET 1.0.0\n#vertices 2\n#edges directed\n#v "a" i\n1\n', '#XNET 1.0.0\n#vertices 1\n#edges directed\n#v "a" i\nx\n', '#XNET 1.0.0\n#vertices 1\n#v "a" s2\n"x"\n'])
def test_broken_xnet(spark, tmp_path, text):
    (tmp_path / "g").write_text(text)
    with pytest.raises(GraphError):
        xnet.read_xnet(spark, f"file://{tmp_path}/g")


BATCH = """
# four nodes in a row
fresh = ADD_NODES n=4
DEFINE_ATTRIBUTE scope=node name=weight type=double dimension=1
DEFINE_ATTRIBUTE scope=node name=label type=string dimension=1
ADD_EDGES pairs=[(0,1),(1,2),(2,3)] ! relative fresh
SET_ATTR_VALUES scope=node name=weight ids=[0,2] values=[0.5,2.0] ! relative fresh
SET_ATTR_VALUES scope=node name=label ids=[1,3] values=["a","b"] ! relative fresh
"""


def test_text_and_binary_batches(spark):
    for apply in (lambda x: x.apply_text(BATCH), lambda x: x.apply_binary(log.to_binary(log.parse_text(BATCH))), lambda x: x.apply_text(log.to_text(log.parse_text(BATCH)))):
        book = log.Log(Graph.empty(spark))
        results = apply(book)
        assert all(r.ok for r in results), results
        assert ids(book.graph.edges) == [0, 1, 2]
        assert column(book.graph.nodes, "weight") == [0.5, 0.0, 2.0, 0.0] and column(book.graph.nodes, "label") == [None, "a", None, "b"]


def test_errors_and_events(spark):
    book, seen = log.Log(graph(spark, 3, [(0, 1)])), []
    stop = book.on(None, seen.append)
    results = book.apply_text("ADD_NODES n=1\nADD_EDGES pairs=[(0,99)]\nADD_NODES n=1")
    assert [r.ok for r in results] == [True, False] and book.graph.nodes.count() == 4
    assert [e["event"] for e in seen] == ["batch:applied"] and len(book.drain()) == 1
    stop()
    book.apply_text("REMOVE_EDGES ids=[0]")
    assert len(seen) == 1 and book.graph.edges.count() == 0


def test_streamed_strength_equals_static(spark, tmp_path):
    changes = spark.createDataFrame([("add", 0, 1, 2.0), ("add", 1, 2, 3.0), ("remove", 0, 1, 2.0), ("add", 0, 2, 1.0)], "op string, src long, dst long, weight double")
    os.makedirs(tmp_path / "in")
    changes.coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).parquet(f"file://{tmp_path}/in")
    q = strength.start(stream, "strengths", f"file://{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    expected = sorted(map(tuple, strength.running_strength(changes).collect()))
    assert sorted(map(tuple, spark.table("strengths").select("id", "strength").collect())) == expected == [(0, 1.0), (1, 3.0), (2, 4.0)]


def test_window_counts(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    total = strength.windowed_activity(events).agg(F.sum("n")).first()[0]
    assert total == events.count()


def test_named_listeners_and_event_names(spark):
    held, seen = log.Log(graph(spark, 2, [(0, 1)])), []
    held.listen("nodes:added.side", lambda e: seen.append("old"))
    stop = held.listen("nodes:added.side", lambda e: seen.append("new"))
    for name in ("topology:changed", "nodes:removed", "edges:added", "edges:removed", "attribute:defined", "attribute:changed", "attribute:removed"):
        held.on(name, lambda e: seen.append(e["event"]))
    for command in log.parse_text("ADD_NODES n=1\nADD_EDGES pairs=[(0,2)]\nDEFINE_ATTRIBUTE scope=node name=a type=int64\nSET_ATTR_VALUES scope=node name=a ids=[0] values=[9007199254740993]\nREMOVE_EDGES ids=[0]\nREMOVE_NODES ids=[1]"):
        held._run(command)
    assert held.graph.get_value("node", "a", 0) == 9007199254740993
    held.remove_attribute("node", "a")
    assert seen == ["new", "topology:changed", "edges:added", "topology:changed", "attribute:defined", "attribute:changed", "edges:removed", "topology:changed", "nodes:removed", "topology:changed", "attribute:removed"]
    stop()
    held.listen("edges:added.x", None)
    held.apply_text("ADD_NODES n=1")
    assert "new" not in seen[1:]


def test_converters(spark):
    from graphloom.sources import convert

    g = graph(spark, 3, [(0, 1), (1, 2)], True, "")
    pandas = pytest.importorskip("pandas")
    assert pandas is not None and callable(getattr(convert, "to_networkx", None) or (lambda: None))
    networkx = pytest.importorskip("networkx")
    assert networkx.is_directed(convert.to_networkx(g))
