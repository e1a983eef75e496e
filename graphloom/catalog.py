"""Named graph queries over the test tables and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import testgraphs as tg
from graphloom.functions.natural import natural_order
from graphloom.graph import Graph, numbered
from graphloom.operators import attributes, communities, generators, iterative, knn, measures, select, traverse
from graphloom.testgraphs import CONVO, OTHER, SUPPLY, TRADE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(F.col(n), 6) for n in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and strength of the nations' trade."""
    g = tg.trade(spark, sf_dir)
    return measures.degree(g).join(measures.strength(g, "weight"), "id")


query("trade_degree_strength", f"with {TRADE} select id, coalesce(d, 0)::bigint as degree, coalesce(s, 0)::double as strength from n left join (select node, count(*) as d, sum(w) as s from (select src as node, weight as w from e union all select dst, weight from e) group by 1) on id = node")(flagship)


# -- selection ---------------------------------------------------------------------------------


def _edges(name: str, text: str, where: str) -> None:
    sql = f"with {TRADE} select e.id from e join n s on s.id = e.src join n d on d.id = e.dst where {where}"
    query(name, sql)(lambda spark, sf: select.select_edges(tg.trade(spark, sf), text))


_edges("select_edges_weight_gt", "weight > 60", "weight > 60")
_edges("select_edges_src_region", '$src.region == "ASIA"', "s.region = 'ASIA'")
_edges("select_edges_any_endpoint", '$any.region == "ASIA" AND weight >= 50', "(s.region = 'ASIA' or d.region = 'ASIA') and weight >= 50")
_edges("select_edges_both_endpoints", '$both.region == "EUROPE" OR $dst.name == "NATION_4"', "(s.region = 'EUROPE' and d.region = 'EUROPE') or d.name = 'NATION_4'")
_edges("select_edges_not", 'NOT ($src.regionkey >= 1 AND weight < 100)', "not (s.regionkey >= 1 and weight < 100)")


def _nodes(name: str, text: str, where: str) -> None:
    query(name, f"with {TRADE} select id from n where {where}")(lambda spark, sf: select.select_nodes(tg.trade(spark, sf, sparse=True), text))


_nodes("select_nodes_string_in", 'name IN ("NATION_3", "NATION_7", "NOWHERE")', "name in ('NATION_3', 'NATION_7', 'NOWHERE')")
_nodes("select_nodes_regex", 'name =~ "^[[:upper:]]+_[[:digit:]]$"', "regexp_matches(name, '^[[:upper:]]+_[[:digit:]]$')")
_nodes("select_nodes_not_or", 'NOT (region == "ASIA" OR regionkey IN (0, 3))', "not (region = 'ASIA' or regionkey in (0, 3))")
_nodes("select_nodes_any_neighbor", '$any.neighbor.region == "AFRICA" AND regionkey > 1', "id in (select node from adj join n m on m.id = nbr where m.region = 'AFRICA') and regionkey > 1")
_nodes("select_nodes_both_neighbor", "$both.neighbor.id != 3", "id in (select node from adj group by node having bool_and(nbr <> 3))")


def _vectors(name: str, text: str, where: str) -> None:
    query(name, f"select vec_id as id from (select vec_id, list_transform(embedding, lambda x: x::double) as v, label from embeddings) where {where}")(lambda spark, sf: select.select_nodes(tg.vectors(spark, sf), text))


_vectors("select_vec_any", "embedding > 0.35", "list_max(v) > 0.35")
_vectors("select_vec_all", "embedding.all > -0.3", "list_min(v) > -0.3")
_vectors("select_vec_index", "embedding[3] > 0.1 AND label != 2", "v[4] > 0.1 and label <> 2")
_vectors("select_vec_min_max", "embedding.max > 0.3 AND embedding.min < -0.3", "list_max(v) > 0.3 and list_min(v) < -0.3")
_vectors("select_vec_avg_std", "embedding.avg > 0 AND embedding.std > 0.1245", "list_avg(v) > 0 and list_stddev_pop(v) > 0.1245")
_vectors("select_vec_median", "embedding.median > 0.02", "list_median(v) > 0.02")
_vectors("select_vec_norm", "embedding.abs > 0.5", "sqrt(list_sum(list_transform(v, lambda x: x * x))) > 0.5")
_DOT = ", ".join(["1", "-1"] * 32)
_vectors("select_vec_dot_literal", f"embedding.dot([{_DOT}]) > 0.5", f"list_dot_product(v, [{_DOT}]::double[]) > 0.5")
_vectors("select_vec_dot_attribute", "embedding.dot(embedding) > 0.9999999", "list_dot_product(v, v) > 0.9999999")


@query("select_category_eq", f"with {TRADE} select id from n where region = 'ASIA' or region in ('EUROPE')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = attributes.categorize(tg.trade(spark, sf), "node", "region", "alphabetical")
    return select.select_nodes(g, 'region == "ASIA" OR region IN ("EUROPE") OR region == "NOWHERE"')


# -- subgraphs and selectors -------------------------------------------------------------------


@query("filter_subgraph_induced", f"with {TRADE} select e.id, e.src, e.dst from e where weight > 40 and src in (select id from n where regionkey >= 2) and dst in (select id from n where regionkey >= 2)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return select.filter_subgraph(tg.trade(spark, sf), "regionkey >= 2", "weight > 40").edge_pairs()


@query("filter_subgraph_min_component", f"select c_custkey as id from customer join orders on o_custkey = c_custkey group by 1 having count(*) >= 11 union all select o_orderkey + {OTHER} from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 11)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return select.filter_subgraph(tg.cust_order(spark, sf), min_component_size=12).nodes.select("id")


@query("filter_subgraph_ordered", f"with {TRADE} select id, (row_number() over (order by regionkey desc, id) - 1)::bigint as place from n where regionkey <= 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = select.filter_subgraph(tg.trade(spark, sf), "regionkey <= 3")
    ordered = select.order_by(g, "node", g.nodes, "-regionkey").select("id").toArrow()  # in the order of the frame
    return spark.createDataFrame([(i, place) for place, i in enumerate(ordered.column("id").to_pylist())], "id long, place long")


@query("selector_intersect", f"with {TRADE} select id from n where regionkey >= 1 and name like '%2%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    return select.intersect(g, "node", select.select_nodes(g, "regionkey >= 1"), select.select_nodes(g, 'name =~ "2"'))


@query("selector_union_difference", f"with {TRADE} select id from n where (regionkey = 1 or regionkey = 2) and name not like '%1%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    return select.difference(select.union(select.select_nodes(g, "regionkey == 1"), select.select_nodes(g, "regionkey == 2")), select.select_nodes(g, 'name =~ "1"'))


@query("edges_filter_by_nodes", f"with {TRADE} select id from p where src < 12 and dst < 12")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf, sparse=True)
    return select.edges_among(g, select.select_nodes(g, "id < 12")).select("id")


@query("edge_endpoints", f"with {TRADE} select distinct unnest([src, dst]) as id from p where weight > 200 or src = 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf, sparse=True)
    return select.endpoints(g, select.select_edges(g, "weight > 200 OR $src.id == 3"))


# -- traversal ---------------------------------------------------------------------------------

_HOPS = f"with recursive {TRADE}, hop(id, level) as (select * from (values (0::bigint, 0), (1::bigint, 0)) t(id, level) union select dst, level + 1 from hop join p on src = hop.id where level < 4), dist as (select id, min(level)::int as level from hop group by 1)"


@query("neighbors_one_hop", f"with {TRADE} select distinct nbr as id from adj where node in (0, 1)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbors(tg.trade(spark, sf, sparse=True), [0, 1])[0]


@query("neighbors_exclude_sources", f"with {TRADE} select distinct dst as id from p where src in (0, 1) and dst not in (0, 1)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbors(tg.trade(spark, sf, sparse=True), [0, 1], "out", include_sources=False)[0]


@query("neighbors_edges", f"with {TRADE} select id from p where dst in (0, 1)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbors(tg.trade(spark, sf, sparse=True), [0, 1], "in")[1]


@query("neighbors_at_level_2", f"{_HOPS} select id from dist where level = 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbors_at_level(tg.trade(spark, sf, sparse=True), [0, 1], 2, "out")[0]


@query("neighbors_up_to_level_3", f"{_HOPS} select id from dist where level between 1 and 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbors_up_to_level(tg.trade(spark, sf, sparse=True), [0, 1], 3, "out")[0]


@query("neighbors_up_to_level_edges", f"{_HOPS} select p.id from p join dist a on a.id = p.src join dist b on b.id = p.dst where b.level = a.level + 1 and b.level <= 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.neighbors_up_to_level(tg.trade(spark, sf, sparse=True), [0, 1], 3, "out")[1]


@query("hop_distances", f"{_HOPS} select id, level from dist")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.hop_distances(tg.trade(spark, sf, sparse=True), [0, 1], 4, "out")


# -- measures ----------------------------------------------------------------------------------

for _d, _c in (("out", "src"), ("in", "dst")):
    query(f"degree_{_d}", f"with {TRADE} select n.id, count(p.id)::bigint as degree from n left join p on p.{_c} = n.id group by 1")(lambda spark, sf, d=_d: measures.degree(tg.trade(spark, sf, sparse=True), d))
query("degree_both", f"with {SUPPLY} select sn.id, count(edge)::bigint as degree from sn left join sadj on node = sn.id group by 1")(lambda spark, sf: measures.degree(tg.supply(spark, sf)))
for _m in ("sum", "avg", "max", "min"):
    query(f"strength_{_m}", f"with {SUPPLY} select sn.id, round(coalesce({_m}(w), 0), 6)::double as strength from sn left join sadj on node = sn.id group by 1")(lambda spark, sf, m=_m: rounded(measures.strength(tg.supply(spark, sf), "quantity", measure=m), "strength"))

_PAIRS = f"""with {TRADE}, ow as (select src, dst, sum(weight)::double as w from p where src <> dst group by 1, 2),
pw as (select least(src, dst) as a, greatest(src, dst) as b, avg(w) as w from ow group by 1, 2),
ends as (select a as v, b as u, w from pw union all select b, a, w from pw),
per as (select v, count(*) as k, sum(w) as s from ends group by 1), top as (select max(weight)::double as t from p),
tri as (select x.v, sum(VALUE) as t from ends x join ends y on x.v = y.v and x.u < y.u join pw z on z.a = x.u and z.b = y.u cross join top group by 1)
select n.id, round(coalesce(2 * tri.t / (WHOLE), 0), 6)::double as clustering from n left join per on per.v = n.id left join tri on tri.v = n.id"""
for _v, _value, _whole in (("unweighted", "1.0", "per.k * (per.k - 1)"), ("onnela", "cbrt(x.w * y.w * z.w) / top.t", "per.k * (per.k - 1)"), ("newman", "(x.w + y.w) / 2", "per.s * (per.k - 1)")):
    query(f"clustering_{_v}", _PAIRS.replace("VALUE", _value).replace("WHOLE", _whole))(lambda spark, sf, v=_v: rounded(measures.clustering(tg.trade(spark, sf, sparse=True), "weight", v), "clustering"))


@query("modularity_by_label", f"with {TRADE}, x as (select a.region as a, b.region as b, weight::double as w from e join n a on a.id = src join n b on b.id = dst), m as (select sum(w) as m from x), o as (select a as c, sum(w) as o, sum(case when a = b then w else 0 end) as i from x group by 1), t as (select b as c, sum(w) as t from x group by 1) select round(sum(i / m - o * t / (m * m)), 6)::double as modularity from o join t using (c) cross join m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    return rounded(measures.modularity(g, g.nodes.select("id", F.col("region").alias("label")), "weight"), "modularity")


@query("weak_components", f"select c_custkey as id, row_number() over (order by c_custkey)::bigint as component from customer union all select o_orderkey + {OTHER}, component from orders join (select c_custkey, row_number() over (order by c_custkey)::bigint as component from customer) on o_custkey = c_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.weak_components(tg.cust_order(spark, sf))


_REACH = f"with recursive {CONVO}, r(a, b) as (select id, id from cn union select r.a, e.y from r join (select src as x, dst as y from ce union all select dst, src from ce) e on e.x = r.b), c as (select a as id, min(b) as root from r group by 1), s as (select root, count(*)::bigint as size from c group by 1), k as (select root, size, row_number() over (order by root)::bigint as component from s), q as (select *, row_number() over (order by size desc, component)::bigint as rank from k)"


@query("convo_components", f"{_REACH} select id, component from c join q using (root)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.weak_components(tg.convo(spark, sf))


@query("extract_components", f"{_REACH} select rank, component, size, id from c join q using (root) where size >= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.extract_components(tg.convo(spark, sf), min_size=5)


@query("largest_component", f"{_REACH} select id from c join q using (root) where rank = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.largest_component(tg.convo(spark, sf)).nodes.select("id")


@query("label_major_components", f"{_REACH} select id, case when rank <= 10 and size >= 3 then rank else 0 end as label from c join q using (root)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.label_major_components(tg.convo(spark, sf), max_components=10, min_size=3)


@query("strong_components", f"with recursive {TRADE}, heavy as (select * from e where weight > (select quantile_disc(weight, 0.9) from e)), r(a, b) as (select id, id from n union select r.a, dst from r join heavy on src = r.b), m as (select x.a as id, min(x.b) as root from r x join r y on x.a = y.b and x.b = y.a group by 1) select id, dense_rank() over (order by root)::bigint as component from m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    cut = g.edges.agg(F.expr("percentile_disc(0.9) within group (order by weight)").alias("cut"))
    heavy = g.edges.crossJoin(F.broadcast(cut)).where("weight > cut").drop("cut")  # one row
    return iterative.strong_components(Graph(g.nodes, heavy, True))


_TORUS = """t as (select unnest(range(0, 144)) as id), d as (select a.id as source, b.id as node, least(abs(a.id // 12 - b.id // 12), 12 - abs(a.id // 12 - b.id // 12)) + least(abs(a.id % 12 - b.id % 12), 12 - abs(a.id % 12 - b.id % 12)) as level from t a cross join t b),
v as (select source, r, (select count(*) from d where d.source = x.source and d.level <= x.r)::bigint as volume from (select t.id as source, unnest(range(0, 9)) as r from t) x)"""


def _torus(spark: SparkSession) -> Graph:
    return generators.lattice_2d(spark, 12, 12, periodic=True)


@query("ball_volume", f"with {_TORUS} select source, r::int as r, volume from v where r <= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.ball_volumes(_torus(spark), 5)


def _differences(terms: list[tuple[int, float]]) -> str:
    return " + ".join(f"case when r + ({k}) > 0 then ({c!r}) * coalesce(list_extract(vs, (r + ({k}) + 1)::bigint), 0) else 0 end" for k, c in terms)


_DIM = {
    "forward": _differences([(0, -1.5), (1, 2.0), (2, -0.5)]),
    "backward": _differences([(0, 1.5), (-1, -2.0), (-2, 0.5)]),
    "central": _differences([(1, 2 / 3), (-1, -2 / 3), (2, -1 / 12), (-2, 1 / 12)]),
}
_LS = "case when r > 2 then (select regr_slope(ln(list_extract(vs, q + 1)), ln(q)) from (select unnest(range(greatest(r - 2, 1), r + 3)) as q)) else 0 end"
_LISTS = f"with {_TORUS}, l as (select source, list(volume::double order by r) as vs from v group by 1), g as (select l.*, unnest(range(0, 6)) as r from l)"
for _n, _e in _DIM.items():
    query(f"node_dimension_{_n}", f"{_LISTS} select source, r::int as r, list_extract(vs, r + 1)::bigint as volume, round(case when r > 0 then ({_e}) * r / list_extract(vs, r + 1) else 0 end, 6)::double as dimension from g")(lambda spark, sf, m=_n: rounded(iterative.node_dimension(_torus(spark), None, 5, m, 2), "dimension"))
query("node_dimension_leastsquares", f"{_LISTS} select source, r::int as r, list_extract(vs, r + 1)::bigint as volume, round({_LS}, 6)::double as dimension from g")(lambda spark, sf: rounded(iterative.node_dimension(_torus(spark), None, 5, "leastsquares", 2), "dimension"))


@query("global_dimension", f"{_LISTS}, f as (select source, r, list_extract(vs, r + 1) as volume, {_LS} as d from g) select r::int as r, round(avg(volume), 6)::double as volume, round(avg(d), 6)::double as dimension, round(avg(d), 6)::double as node_dimension, round(stddev_pop(d), 6)::double as deviation, round(max(d), 6)::double as max_dimension from f group by r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.global_dimension(_torus(spark), None, 5), "volume", "dimension", "node_dimension", "deviation", "max_dimension")


def _power(rounds: int) -> str:
    steps = ["x0 as (select id, 1 / sqrt((select count(*) from n)) as x from n)", "ws as (select node, nbr, sum(w)::double as w from adj group by 1, 2)"]
    for i in range(1, rounds + 1):
        steps.append(f"y{i} as (select a.id, a.x + coalesce((select sum(w * b.x) from ws join x{i - 1} b on b.id = nbr where node = a.id), 0) as y from x{i - 1} a)")
        steps.append(f"x{i} as materialized (select id, y / (select sqrt(sum(y * y)) from y{i}) as x from y{i})")
    return f"with {TRADE}, {', '.join(steps)} select id, round(x, 6)::double as x from x{rounds}"


@query("eigenvector_k_iters", _power(6))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.eigenvector_centrality(tg.trade(spark, sf, sparse=True), "weight", max_iterations=6, tolerance=0.0), "x").select("id", "x")


@query("eigenvector_converged", _power(40))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.eigenvector_centrality(tg.trade(spark, sf, sparse=True), "weight", tolerance=1e-10), "x").select("id", "x")


_BETWEEN = f"""with recursive {TRADE}, l as (select src, dst, count(*) as m from p where src <> dst group by 1, 2),
w(s, v, d) as (select id, id, 0 from n union select s, dst, d + 1 from w join l on src = v where d < 10), dd as (select s, v, min(d) as d from w group by 1, 2),
c(s, v, d, k) as (select id, id, 0, 1::double from n union all select c.s, q.dst, c.d + 1, sum(c.k * q.m) from c join l q on q.src = c.v join dd on dd.s = c.s and dd.v = q.dst and dd.d = c.d + 1 group by c.s, q.dst, c.d)
"""


@query(
    "betweenness_unweighted",
    _BETWEEN
    + ", g as (select s, v, d, sum(k) as k from c group by 1, 2, 3) select n.id, round(coalesce(b, 0) / ((select count(*) from n) - 1) / ((select count(*) from n) - 2), 6)::double as betweenness from n left join (select a.v as id, sum(a.k * b.k / t.k) as b from g a join g b on a.v = b.s join g t on t.s = a.s and t.v = b.v and t.d = a.d + b.d where a.s <> a.v and b.v <> a.v and a.s <> b.v group by 1) using (id)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.betweenness_centrality(tg.trade(spark, sf, sparse=True)), "betweenness")


def _weighted_between() -> str:
    """Distances by doubling the paths, numbers of paths by hops along the edges that shortest paths use."""
    steps = ["l as (select src, dst, weight::double as w, count(*) as m from p where src <> dst group by 1, 2, 3)", "d0 as materialized (select src as s, dst as v, min(w) as d from l group by 1, 2 union all select id, id, 0 from n)"]
    for i in range(1, 6):
        steps.append(f"d{i} as materialized (select a.s, b.v, min(a.d + b.d) as d from d{i - 1} a join d{i - 1} b on b.s = a.v group by 1, 2)")
    walk = "c(s, v, h, k) as (select id, id, 0, 1::double from n union all select c.s, l.dst, c.h + 1, sum(c.k * l.m) from c join l on l.src = c.v join d5 a on a.s = c.s and a.v = c.v join d5 b on b.s = c.s and b.v = l.dst and b.d = a.d + l.w group by c.s, l.dst, c.h)"
    steps += [walk, "g as (select c.s, c.v, d5.d, sum(c.k) as k from c join d5 on d5.s = c.s and d5.v = c.v group by 1, 2, 3)"]
    return f"with recursive {TRADE}, {', '.join(steps)} select n.id, round(coalesce(b, 0) / ((select count(*) from n) - 1) / ((select count(*) from n) - 2), 6)::double as betweenness from n left join (select a.v as id, sum(a.k * b.k / t.k) as b from g a join g b on a.v = b.s join g t on t.s = a.s and t.v = b.v and t.d = a.d + b.d where a.s <> a.v and b.v <> a.v and a.s <> b.v group by 1) using (id)"


@query("betweenness_weighted", _weighted_between())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.betweenness_centrality(tg.trade(spark, sf, sparse=True), "weight"), "betweenness")


def _hindex(rounds: int) -> str:
    steps = ["m as (select node, nbr, count(*) as m from adj group by 1, 2)", "h0 as (select n.id, coalesce(sum(m), 0) as h from n left join m on node = n.id group by 1)"]
    for i in range(1, rounds + 1):
        steps.append(f"h{i} as materialized (select b.id, coalesce(max(least(q.h, q.above)), 0) as h from h{i - 1} b left join (select node, g.h, sum(m) over (partition by node order by g.h desc, nbr rows unbounded preceding) as above from m join h{i - 1} g on g.id = nbr) q on q.node = b.id group by 1)")
    return f"with {TRADE}, {', '.join(steps)} select id, h::bigint as coreness from h{rounds}"


@query("coreness", _hindex(16))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.coreness(tg.trade(spark, sf, sparse=True))


@query("leiden_communities")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return communities.leiden(tg.trade(spark, sf, sparse=True), "weight", seed=1)


# -- attributes --------------------------------------------------------------------------------

_CODES = {"none": "min(id)", "frequency": "count(*) desc, region", "alphabetical": "region"}
for _o, _by in _CODES.items():
    query(f"categorize_{_o}", f"with {TRADE}, k as (select region, row_number() over (order by {_by}) - 1 as code from n group by region) select n.id, code::int as region from n join k using (region)")(lambda spark, sf, o=_o: attributes.categorize(tg.trade(spark, sf), "node", "region", o).nodes.select("id", "region"))


@query("categorize_natural", "select s_suppkey as id, (row_number() over (order by s_suppkey) - 1)::int as name from supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tg.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"))
    return attributes.categorize(Graph(nodes, Graph.empty(spark).edges), "node", "name", "natural").nodes


def _naturally(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    parts = tg.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), natural_order(text).alias("key"))
    return numbered(parts, ["key", "id"], "place").select("id", (F.col("place") + 1).cast("int").alias("place"))


@query("natural_order", "select p_partkey as id, row_number() over (order by p_size, p_partkey)::int as place from part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _naturally(spark, sf, F.concat(F.lit("size"), F.col("p_size").cast("string")))


@query("natural_order_long_numbers", "select p_partkey as id, row_number() over (order by p_size, p_partkey % 7, p_partkey)::int as place from part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _naturally(spark, sf, F.concat(F.lit("n"), F.repeat(F.lit("7"), F.col("p_size")), F.lit("-"), F.repeat(F.lit("0"), (F.col("p_partkey") % 7).cast("int")), F.lit("5")))


@query("decategorize", f"with {TRADE} select id, region from n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = attributes.categorize(tg.trade(spark, sf), "node", "region", "frequency")
    return attributes.decategorize(g, "node", "region").nodes.select("id", "region")


@query("category_remap", f"with {TRADE} select id, case region when 'ASIA' then 10 when 'AFRICA' then 20 else -1 end as region from n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = attributes.categorize(tg.trade(spark, sf), "node", "region", "none")
    return attributes.set_dictionary(g, "node", "region", {"ASIA": 10, "AFRICA": 20}, remap=True).nodes.select("id", "region")


def _tagged(spark: SparkSession, sf: str) -> Graph:
    """Nations: every third without tags, other even ones with both, the rest with one."""
    g = tg.trade(spark, sf).define_attribute("node", "tags", "multicategory")
    codes = F.when(F.col("id") % 3 == 0, F.array().cast("array<int>")).when(F.col("id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    entries = F.transform(codes, lambda c: F.struct(c.alias("id"), F.lit(None).cast("double").alias("weight"))).cast(g.nodes.schema["tags"].dataType)
    tagged = g.set_values("node", "tags", g.nodes.select("id", entries.alias("value")))
    return replace(tagged, categories={("node", "tags"): {"even": 0, "any": 1}})


_TAGS = "t as (select n_nationkey::bigint as id, case when n_nationkey % 3 = 0 then 0 when n_nationkey % 2 = 0 then 2 else 1 end as n from nation)"


@query("multicategory_csr", "select (row_number() over (order by id, code) - 1)::bigint as place, id, code::int as category from (select n_nationkey::bigint as id, unnest([0, 1]) as code from nation where n_nationkey % 2 = 0 and n_nationkey % 3 <> 0 union all select n_nationkey, 1 from nation where n_nationkey % 2 = 1 and n_nationkey % 3 <> 0)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.multicategory_buffers(_tagged(spark, sf), "node", "tags")[1].select(F.col("at").alias("place"), "id", "category")


@query("multicategory_offsets", f"with {_TAGS}, o as (select id, n, coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as place from t) select id, place as first_at, (place + n)::bigint as stop_at from o")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.multicategory_buffers(_tagged(spark, sf), "node", "tags")[0].select("id", F.col("offset").alias("first_at"), F.col("stop").alias("stop_at"))


@query("node_to_edge_copy", f"with {TRADE} select e.id, a.regionkey as src_region, b.regionkey as dst_region from e join n a on a.id = src join n b on b.id = dst")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = attributes.node_to_edge(tg.trade(spark, sf), "regionkey", "regions")
    return g.edges.select("id", F.col("regions")[0].alias("src_region"), F.col("regions")[1].alias("dst_region"))


@query("compact_ids", f"with {TRADE}, k as (select id, row_number() over (order by id) - 1 as new from n where regionkey <> 1) select (row_number() over (order by p.id) - 1)::bigint as id, a.new::bigint as src, b.new::bigint as dst from p join k a on a.id = src join k b on b.id = dst")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf, sparse=True)
    return g.remove_nodes(select.select_nodes(g, "regionkey == 1")).compact().edge_pairs()


@query("valid_range", f"with {TRADE} select min(id)::bigint as first, (max(id) + 1)::bigint as stop from e")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tg.trade(spark, sf).valid_range("edge")


@query("project_attributes", f"with {TRADE} select id, name, regionkey from n where regionkey = 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    return g.project("node", select.select_nodes(g, "regionkey == 3"), "name", "regionkey")


# -- generators and neighbours -----------------------------------------------------------------


def _lattice_sql(rows: int, columns: int, level: int, wrap: bool) -> str:
    right = f"r * {columns} + (c + k) % {columns}" if wrap else f"case when c + k < {columns} then r * {columns} + c + k end"
    down = f"((r + k) % {rows}) * {columns} + c" if wrap else f"case when r + k < {rows} then (r + k) * {columns} + c end"
    return f"select distinct least(id, d)::bigint as src, greatest(id, d)::bigint as dst from (select id, unnest([{right}, {down}]) as d from (select i as id, i // {columns} as r, i % {columns} as c, unnest(range(1, {level + 1})) as k from range(0, {rows * columns}) t(i))) where d is not null and d <> id"


query("lattice_2d", _lattice_sql(20, 30, 2, False))(lambda spark, sf: generators.lattice_2d(spark, 20, 30, 2).edges.select("src", "dst"))
query("lattice_2d_periodic", _lattice_sql(7, 9, 1, True))(lambda spark, sf: generators.lattice_2d(spark, 7, 9, periodic=True).edges.select("src", "dst"))
_GENERATED: dict[str, tuple[int, Callable[[SparkSession], Graph]]] = {
    "stochastic_block_model": (500, lambda spark: generators.stochastic_block_model(spark, [200, 300], [[0.1, 0.01], [0.01, 0.1]], seed=7)),
    "watts_strogatz": (1000, lambda spark: generators.watts_strogatz(spark, 1000, 2, 0.05, seed=7)),
    "barabasi_albert": (500, lambda spark: generators.barabasi_albert(spark, 500, 2, seed=7)),
    "random_geometric": (500, lambda spark: generators.random_geometric(spark, 500, 0.05, seed=7)),
    "waxman": (300, lambda spark: generators.waxman(spark, 300, seed=7)),
    "configuration_model": (1000, lambda spark: generators.configuration_model(spark, [1 + i % 4 for i in range(1000)], seed=7)),
}


def _invariants(g: Graph) -> DataFrame:
    """Nodes, loops, repeated pairs, ends that are no nodes, and whether ids are 0, 1, 2 and so on."""
    pairs = g.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    counts = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("loops"), (F.count("*") - F.count_distinct("a", "b")).alias("repeated"), (F.count("*") > 0).alias("linked"))
    strangers = pairs.select(F.explode(F.array("a", "b")).alias("id")).join(g.nodes, "id", "left_anti").agg(F.count("*").alias("strangers"))
    nodes = g.nodes.agg(F.count("*").alias("nodes"), F.min("id").alias("first"), F.max("id").alias("last"))
    return counts.crossJoin(strangers).crossJoin(nodes)  # one row each


for _name, (_n, _make) in _GENERATED.items():
    query(_name)(lambda spark, sf, f=_make: f(spark).edge_pairs())
    query(f"{_name}_invariants", f"select 0::bigint as loops, 0::bigint as repeated, true as linked, 0::bigint as strangers, {_n}::bigint as nodes, 0::bigint as first, {_n - 1}::bigint as last")(lambda spark, sf, f=_make: _invariants(f(spark)))


@query("barabasi_albert_degrees", "select 500::bigint as nodes, 2::bigint as least_degree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return measures.degree(_GENERATED["barabasi_albert"][1](spark)).agg(F.count("*").alias("nodes"), F.min("degree").alias("least_degree"))


@query("configuration_model_degrees", "select 0::bigint as above")
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = measures.degree(_GENERATED["configuration_model"][1](spark))
    return got.where(F.col("degree") > F.col("id") % 4 + 1).agg(F.count("*").alias("above"))


_KNN = "with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), q as (select a.id as src, b.id as dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance from v a join v b on a.id <> b.id), k as (select *, row_number() over (partition by src order by distance, dst) - 1 as rank from q)"


def _knn(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return knn.knn_edges(tg.table(spark, sf, "embeddings"), k, "vec_id", "embedding")


@query("knn_graph", f"{_KNN} select src, dst, round(distance, 6)::double as distance, rank::int as rank from k where rank < 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_knn(spark, sf, 5), "distance")


_FUZZY = f"{_KNN}, w as (select src, dst, 1 / (1 + distance) as weight from k where rank < 3)"


@query("fuzzy_collapse", f"{_FUZZY} select least(src, dst) as src, greatest(src, dst) as dst, round(max(weight), 6)::double as weight from w group by 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(knn.collapse(_knn(spark, sf, 3).select("src", "dst", (1 / (1 + F.col("distance"))).alias("weight"))), "weight")


@query("fuzzy_mass", f"{_FUZZY} select src as id, round(sum(weight), 6)::double as mass from w group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(knn.mass(_knn(spark, sf, 3).select("src", "dst", (1 / (1 + F.col("distance"))).alias("weight"))), "mass")


# -- further scans and columns -----------------------------------------------------------------


@query("membership_test", f"with {TRADE} select i::bigint as id, i in (select id from n) as active from (values (0), (24), (25), (-1)) t(i)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tg.trade(spark, sf).active("node", [0, 24, 25, -1]).select("id", "active")


@query("selector_filter_active", "select distinct n_nationkey::bigint as id from nation where n_nationkey in (3, 5)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 5), (1, 99), (2, 3), (3, 5)], "pos long, id long")
    return select.filter_active(tg.trade(spark, sf), "node", asked).select("id")


@query("promote_to_end", f"with {TRADE} select id, (row_number() over (order by regionkey = 2, id) - 1)::bigint as place from n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    return select.promote_to_end(g.nodes.select("id", F.col("id").alias("pos")), select.select_nodes(g, "regionkey == 2"))


@query("edge_end_attributes", f"with {TRADE} select p.id, a.name as src_name, b.name as dst_name from p join n a on a.id = src join n b on b.id = dst")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.edge_ends(tg.trade(spark, sf, sparse=True), "name").select("id", "src_name", "dst_name")


@query("node_to_edge_single", f"with {TRADE} select p.id, b.regionkey as region from p join n b on b.id = dst")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.node_to_edge(tg.trade(spark, sf, sparse=True), "regionkey", "region", "dst").edges.select("id", "region")


@query("define_and_write_attribute", f"with {TRADE} select id, case when regionkey = 1 then 7.5 else 0 end::double as score from n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf).define_attribute("node", "score", "double")
    values = select.select_nodes(g, "regionkey == 1").withColumn("value", F.lit(7.5))
    return g.set_values("node", "score", values).nodes.select("id", "score")


@query("interpolate_vectors", "select vec_id as id, round(embedding[1]::double + (1 - exp(-20 / 200.0)) * (1 - embedding[1]::double), 4)::double as first from embeddings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.vectors(spark, sf)
    goals = g.nodes.select("id", F.array_repeat(F.lit(1.0).cast("float"), 64).alias("value"))
    moved, _ = attributes.interpolate(g, "node", "embedding", goals, 50.0, 200.0)
    return moved.nodes.select("id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@query("category_dictionary", f"with {TRADE} select region as label, (row_number() over (order by region) - 1)::int as code from n group by region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.category_codes(tg.trade(spark, sf).nodes, "region", "alphabetical")


@query("top_components", f"{_REACH} select component, size, rank from q where rank <= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.component_sizes(iterative.weak_components(tg.convo(spark, sf))).where("rank <= 5")


# -- mutation log and files --------------------------------------------------------------------

_BATCH = """
fresh = ADD_NODES n=3
ADD_EDGES pairs=[(0,1),(1,2),(2,0)] ! relative fresh
SET_ATTR_VALUES scope=edge name=weight ids=[0,2] values=[7,9] ! relative added_edge_ids
SET_ATTR_VALUES scope=node name=name ids=[1] values=["ATLANTIS"] ! relative fresh
REMOVE_NODES ids=[3,4]
"""


@query("replay_text_batch", f"with {TRADE}, x as (select (max(id) + 1)::bigint as i from e), r as (select * from p where src not in (3, 4) and dst not in (3, 4)), m as (select (max(id) + 1)::bigint as i from p) select id, src, dst, weight from r union all select m.i + k, 25 + k, 25 + (k + 1) % 3, case k when 0 then 7 when 2 then 9 else 0 end from m, range(0, 3) t(k)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.streaming.log import replayed

    return replayed(tg.trade(spark, sf, sparse=True), _BATCH).edges


@query("incremental_strength", "select id, sum(w)::double as strength from (select l_suppkey as id, case when l_returnflag = 'R' then -l_quantity else l_quantity end as w from lineitem union all select l_partkey, case when l_returnflag = 'R' then -l_quantity else l_quantity end from lineitem) group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.streaming.strength import running_strength

    items = tg.table(spark, sf, "lineitem")
    op = F.when(F.col("l_returnflag") == "R", "remove").otherwise("add")
    return running_strength(items.select(op.alias("op"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight")))


def _round_trip(spark: SparkSession, sf: str, write: Callable, read: Callable) -> DataFrame:
    from graphloom.scratch import Scratch

    path = Scratch(spark, "files").path("graph")
    write(tg.trade(spark, sf, sparse=True), path)
    g = read(spark, path)
    names = g.nodes.select("id", "name")
    ends = g.edges.select("src", "dst", F.col("weight").cast("long").alias("weight"))
    ends = ends.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return ends.select("a", "b", "weight")


def _formats() -> dict[str, tuple[Callable, Callable]]:
    from graphloom.sources import binary, interchange, parquet, xnet

    return {
        "parquet": (parquet.write_parquet, parquet.read_parquet),
        "xnet": (xnet.write_xnet, xnet.read_xnet),
        "node_link_json": (interchange.write_node_link, interchange.read_node_link),
        "gml": (interchange.write_gml, interchange.read_gml),
        "bxnet": (binary.write_bxnet, binary.read_bxnet),
        "zxnet": (binary.write_zxnet, binary.read_zxnet),
        "gt": (binary.write_gt, binary.read_gt),
    }


for _f in ("parquet", "xnet", "node_link_json", "gml", "bxnet", "zxnet", "gt"):
    query(f"round_trip_{_f}", f"with {TRADE} select s.name as a, d.name as b, weight from p join n s on s.id = src join n d on d.id = dst")(lambda spark, sf, f=_f: _round_trip(spark, sf, *_formats()[f]))


# -- changes, selectors and derived columns ----------------------------------------------------


@query("add_nodes_and_edges", f"with {TRADE} select id, src, dst, weight from e union all select (select max(id) from e) + 1 + k, src, dst, 0 from (values (0, 25, 26), (1, 0, 25), (2, 0, 25)) t(k, src, dst)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tg.trade(spark, sf).add_nodes(2).add_edges([(25, 26), (0, 25), (0, 25)]).edges.select("id", "src", "dst", "weight")


@query("add_edges_from_arrays", f"with {TRADE} select src, dst from e union all select * from (values (3, 4), (5, 5)) t(src, dst)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tg.trade(spark, sf).add_edges_from_arrays([3, 5], [4, 5]).edges.select("src", "dst")


@query("remove_edges", f"with {TRADE} select id from e where weight < 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf)
    return g.remove_edges(select.select_edges(g, "weight >= 100")).edges.select("id")


@query("remove_nodes", f"with {TRADE} select id, src, dst from e where src not in (3, 4) and dst not in (3, 4)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tg.trade(spark, sf).remove_nodes([3, 4, 99]).edge_pairs()


query("replay_binary_batch", SQL["replay_text_batch"])(lambda spark, sf: _replayed_binary(spark, sf))


def _replayed_binary(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.streaming.log import Log, parse_binary, parse_text, to_binary

    log = Log(tg.trade(spark, sf, sparse=True))
    log.apply(parse_binary(to_binary(parse_text(_BATCH))))
    return log.graph.edges


@query("selector_degree", f"with {TRADE} select node as id, count(*)::bigint as degree from adj where node in (select id from n where regionkey = 2) group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf, sparse=True)
    return measures.selector_degree(g, select.select_nodes(g, "regionkey == 2")).where("degree > 0")


@query("incident_edges", f"with {TRADE} select distinct edge as id from adj where node in (select id from n where regionkey = 2)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf, sparse=True)
    return measures.incident_edges(g, select.select_nodes(g, "regionkey == 2"))


@query("derived_edge_attribute", f"with {TRADE} select p.id, case when a.id = 3 then 77 else a.regionkey end::int as region from p join n a on a.id = p.src")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf, sparse=True).derive_edge_attribute("regionkey", "region", "src")
    later = g.set_values("node", "regionkey", spark.createDataFrame([(3, 77)], "id long, value int"))  # the view follows
    return later.edge_view().select("id", F.col("region").cast("int").alias("region"))


@query("mapped_attribute", f"with {TRADE} select id, (regionkey * 10 + id % 3)::bigint as score from n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g = tg.trade(spark, sf).with_attribute("node", "score", F.col("regionkey").cast("long"))
    return g.map_attribute("node", "score", lambda current, i: current * 10 + i % 3, "int64").nodes.select("id", "score")


@query("transform_queries", "with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v, label from embeddings), t as (select max(id) + 1 as offset_ from v where label <> 0), q as (select a.id + offset_ as src, b.id as dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance from v a join v b on a.label = 0 and b.label <> 0 cross join t), k as (select *, row_number() over (partition by src order by distance, dst) - 1 as rank from q) select src, dst, round(distance, 6)::double as distance, rank::int as rank from k where rank < 4")
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = tg.table(spark, sf, "embeddings")
    g = knn.transform_queries(points.where("label <> 0"), points.where("label = 0"), 4, "vec_id", "embedding")
    return rounded(g.edges.select("src", "dst", F.col("umap_knn_distance").alias("distance"), F.col("umap_knn_rank").alias("rank")), "distance")


@query("fitted_graph", f"{_KNN}, w as (select src, dst, 1 / (1 + distance) as weight from k where rank < 3), f as (select least(src, dst) as src, greatest(src, dst) as dst, max(weight) as weight from w group by 1, 2) select src, dst, round(weight, 6)::double as weight, round((select sum(weight) from w where w.src = f.src), 6)::double as mass from f")
def _(spark: SparkSession, sf: str) -> DataFrame:
    g, _ = knn.fit_graph(tg.table(spark, sf, "embeddings"), 3, None, "vec_id", "embedding")
    return rounded(g.edges.join(g.nodes.select(F.col("id").alias("src"), "mass"), "src").select("src", "dst", "weight", "mass"), "weight", "mass")


_RUNS = f"with {CONVO}, r as (select id, max(id) over (partition by run) as last from (select id, id - row_number() over (order by id) as run from cn))"


@query("convo_ball_volume", f"{_RUNS} select id as source, r::int as r, (least(r, last - id) + 1)::bigint as volume from r as a, range(0, 5) t(r)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.ball_volumes(tg.convo(spark, sf), 4)


@query("convo_dimension_profiles", f"{_RUNS}, x as (select id, r, (least(r, last - id) + 1)::double as v, (least(r - 1, last - id) + 1)::double as u from r as a, range(0, 4) t(r)), d as (select id, r, case when r = 1 then v / v when r > 1 then (v - u) * r / v else 0 end as d from x) select id, round(max(d), 6)::double as max_dimension, round(list(d order by r)[3], 6)::double as at_two from d group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    profiles = iterative.dimension_profiles(iterative.node_dimension(tg.convo(spark, sf), None, 3, "backward", 1))
    return rounded(profiles.select("id", "max_dimension", F.col("profile")[2].alias("at_two")), "max_dimension", "at_two")
