"""Small graphs and shorthands."""

from graphloom.graph import Graph


def graph(spark, n, pairs, directed=False, columns=""):
    edges = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, src long, dst long" + columns)
    return Graph(spark.range(n), edges, directed)


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def column(frame, name):
    return [r[name] for r in frame.orderBy("id").collect()]
