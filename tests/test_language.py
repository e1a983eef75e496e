import pytest
from helpers import ids

from graphloom.graph import Graph
from graphloom.operators import attributes, select
from graphloom.plans.language import Both, Not, QueryError, parse


@pytest.fixture(scope="module")
def g(spark):
    rows = [(0, 0.5, 1, "alpha", [0.2, 0.4], [0.1, 0.2]), (1, 2.0, 0, "beta", [1.5, 0.1], [1.0, 1.0]), (2, 3.5, 1, "gamma", [0.3, 2.2], [0.1, 0.1]), (3, float("nan"), 0, None, [0.0, 0.0], [0.0, 0.0])]
    nodes = spark.createDataFrame(rows, "id long, score float, flag int, label string, vec2 array<float>, vec2b array<float>")
    return Graph(nodes, spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "id long, src long, dst long"))


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("score > 1.0", [1, 2]),
        ('label IN ("alpha", "gamma")', [0, 2]),
        ('label =~ "^g"', [2]),
        ('label =~ "^[[:alpha:]]+a$"', [0, 1, 2]),
        ("vec2 > 2.0", [2]),
        ("vec2.any > 2.0", [2]),
        ("vec2.max > 2.0", [2]),
        ("vec2[0] > 1.0", [1]),
        ("vec2.dot(vec2b) > 1.0", [1]),
        ("vec2.all > 0.11", [0, 2]),
        ("vec2.dot([1, 1]) > 2.0", [2]),
        ("vec2.std > 0.9", [2]),
        ("vec2.median > 0.79 AND vec2.abs < 1.6", [1]),
        ('label != "alpha"', [1, 2]),
        ('NOT label != "alpha"', [0, 3]),
        ("score != 1", [0, 1, 2, 3]),
        ("score > 100 OR score < 1", [0]),
        ("label == 3", []),
        ("$any.neighbor.flag == 0", [0, 2]),
        ("$both.neighbor.flag == 1", [1]),
        ("NOT $both.neighbor.flag == 1", [0, 2, 3]),
        ("score > 1 AND flag == 1 OR id == 3", [2, 3]),
        ("NOT (score > 1 AND flag == 1)", [0, 1, 3]),
    ],
)
def test_nodes(g, query, expected):
    assert ids(select.select_nodes(g, query)) == expected


@pytest.mark.parametrize(("query", "expected"), [("$src.flag == 1", [0]), ("$dst.flag == 1", [1]), ("$any.flag == 1", [0, 1]), ("$both.score > 1", [1])])
def test_edges(g, query, expected):
    assert ids(select.select_edges(g, query)) == expected


@pytest.mark.parametrize("query", ["score >", "score > 1 @junk", "nothing == 1", "vec2[2] ==", 'score IN ("a")', "label IN (1)", "label IN ()", 'flag =~ "x"', "$src.flag == 1", "score.max > 1", 'label < "a"', "(score > 1", "score > 1 flag", 'vec2.max == "a"'])
def test_errors(g, query):
    with pytest.raises(QueryError):
        select.select_nodes(g, query)


def test_categories(g):
    c = attributes.categorize(g, "node", "label", "alphabetical")
    assert ids(select.select_nodes(c, 'label == "beta"')) == [1]
    assert ids(select.select_nodes(c, 'label == "other" OR label != "other"')) == []
    assert ids(select.select_nodes(c, "label == 2")) == [2]
    with pytest.raises(QueryError):
        select.select_nodes(c, 'label IN ("beta", "other")')


def test_precedence():
    tree = parse("NOT a == 1 AND b == 2 OR c == 3")
    assert isinstance(tree, Both) and tree.operator == "OR" and tree.left.operator == "AND" and isinstance(tree.left.left, Not)
