"""Queries of whole maps: planes, shapes and signatures of communities, their distances, upserts and summaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import build, maintain, projection
from ..operators import graph as g
from ..sources.tables import edges
from .cube import CENTERS, coded
from .graph import _EGO, _HYPER, _MEANS, SQL_GRAPH, members
from .registry import query

_UNIT = "list_transform({0}, lambda x: x / case when list_dot_product({0}, {0}) = 0 then 1 else sqrt(list_dot_product({0}, {0})) end)"
_OFF = "list_transform(range(1, len({0}) + 1), lambda i: {0}[i] - list_dot_product({1}, {0}) * {1}[i])"
#: The plane of every community: two rounds of power iteration, the second one across the first axis.
SQL_PLANE = f"""{SQL_GRAPH}, {_MEANS},
ct as materialized (select m.community, n.id, list_transform(range(1, len(n.v) + 1), lambda i: n.v[i] - ce.v[i]) as d from member m join nodes n on n.id = m.node_id join ce on ce.community = m.community),
mc as (select community, i, j, sum(d[i] * d[j]) as c from ct, range(1, 65) a(i), range(1, 65) b(j) group by all),
mr as (select community, i, list(c order by j) as r from mc group by all), mx as materialized (select community, list(r order by i) as m from mr group by 1),
st as materialized (select community, arg_min(d, id) as d0 from ct group by 1),
p1(community, k, w) as (select community, 0, {_UNIT.format('d0')} from st union all
 select community, k + 1, {_UNIT.format('u')} from (select community, k, list_transform(m, lambda r: list_dot_product(r, w)) as u from p1 join mx using (community) where k < 20)),
a1 as materialized (select community, w as f from p1 where k = 20),
s2 as (select community, {_OFF.format('d0', 'f')} as u from st join a1 using (community)),
p2(community, k, w) as (select community, 0, {_UNIT.format('u')} from s2 union all
 select community, k + 1, {_UNIT.format('u')} from (select community, k, {_OFF.format('y', 'f')} as u from (select community, k, f, list_transform(m, lambda r: list_dot_product(r, o)) as y from (select p2.community, k, f, m, {_OFF.format('w', 'f')} as o from p2 join a1 on a1.community = p2.community join mx on mx.community = p2.community where k < 20)))),
pl as materialized (select ct.community, ct.id, list_dot_product(d, f) as x, list_dot_product(d, w) as y from ct join a1 on a1.community = ct.community join p2 on p2.community = ct.community and k = 20)"""


@query(f"with recursive {SQL_PLANE} select id, community, round(x, 6) as x, round(y, 6) as y from pl")
def pca2d(spark, sf_dir):
    """Every node on the two main axes of its community."""
    p = projection.plane(coded(spark, sf_dir), members(spark, sf_dir))
    return p.select("id", "community", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"with recursive {SQL_PLANE} select id, community, round(x, 6) as x, round(y, 6) as y from pl")
def pca2d_wide(spark, sf_dir):
    """The same by passes over the vectors, without their second moments, as it is done for wide vectors."""
    p = projection.plane(coded(spark, sf_dir), members(spark, sf_dir), wide=0)
    return p.select("id", "community", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_SHAPE = """he as (select p.community, p.x as px, p.y as py, q.x as qx, q.y as qy from pl p join pl q on p.community = q.community and p.id <> q.id join pl r on r.community = p.community and r.id <> p.id and r.id <> q.id
 group by p.id, q.id, all having min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) > 0),
hc as (select *, px - avg(px) over w as cx, py - avg(py) over w as cy from he window w as (partition by community)),
hr as (select *, max(sqrt(cx * cx + cy * cy)) over (partition by community) as r from hc),
sh as (select community, count(*) as vertices, sum(px * qy - qx * py) / 2 / any_value(r * r) as area, atan2(2 * sum(cx * cy) / any_value(r * r), sum(cx * cx) / any_value(r * r)) / 2 as angle from hr group by 1)""".replace("group by p.id, q.id, all", "group by p.community, p.id, q.id, p.x, p.y, q.x, q.y")
_NAMES = "case vertices when 3 then 'triangle' when 5 then 'pentagon' when 6 then 'hexagon' when 7 then 'heptagon' when 8 then 'octagon' when 4 then null else 'polygon' end"


def _signatures(spark, sf_dir):
    return build.signatures(coded(spark, sf_dir), edges(spark, sf_dir), members(spark, sf_dir))


@query(f"with recursive {SQL_PLANE}, {_SHAPE} select community, cast(vertices as integer) as vertices, round(area, 5) as area, round(angle, 5) as angle, {_NAMES} as shape from sh")
def community_shape(spark, sf_dir):
    """The hull of every community on its own plane, scaled to radius 1; four-sided ones are left unnamed here."""
    hulls = build.community_hulls(projection.plane(coded(spark, sf_dir), members(spark, sf_dir)))
    t = hulls.select("community", build.small_tangram(F.col("n"), F.col("hull")).alias("t"))
    named = F.when(F.col("t.vertices") != 4, F.col("t.shape"))
    return t.select("community", F.col("t.vertices").alias("vertices"), F.round("t.area", 5).alias("area"), F.round("t.angle", 5).alias("angle"), named.alias("shape"))


_VECTOR = f"""{SQL_PLANE}, {_SHAPE}, kk as (select community, avg(weight) as mean, avg(case when directed then 1.0 else 0 end) as ways, count(*) as n, max(weight) as high from intra group by 1),
bb as (select community, hex_id, [cast((hex_id >> i) & 1 as double) for i in range(0, 6)] as b from ch),
sv as materialized (select bb.community, hex_id, list_concat(list_concat(b, [area, angle, vertices]), list_concat([case when n is null then 0.5 else least(1, mean) end, coalesce(ways, 0.5), 0.5, case when n is null then 0.5 else least(1, mean) end, case when n is null then 0.5 else least(1.0, n / 20) end, case when n is null then 0.5 else least(1, high) end, case when n is null then 0.5 else 0.7 end],
 [b[1], b[2], b[3], b[4], 1 - b[1], b[5], b[6], b[2] * b[3]])) as v from bb join sh using (community) left join kk using (community)),
di as (select a.community, b.community as other, round(sqrt(list_sum([(a.v[i] - b.v[i]) ** 2 for i in range(1, 25)])), 5) as distance, cast(bit_count(xor(a.hex_id, b.hex_id)) as integer) as steps from sv a join sv b on a.community <> b.community)"""


def _distances(spark, sf_dir):
    c = g.cut(_signatures(spark, sf_dir).select("community", "hex_id", build.signature_vector().alias("v")))
    return build.distances(c).withColumn("distance", F.round("distance", 5))


@query(f"with recursive {_VECTOR} select * from di")
def community_distance(spark, sf_dir):
    """Distances of every two communities, over their signatures and in steps of the cube."""
    return _distances(spark, sf_dir)


@query(f"with recursive {_VECTOR} select community, other, distance, cast(rank as integer) as rank from (select *, row_number() over (partition by community order by distance, other) as rank from di) where rank <= 5")
def similar_clusters(spark, sf_dir):
    """The five communities nearest to each over the 24 numbers of their signatures."""
    return build.nearest(_distances(spark, sf_dir))


@query(f"with {SQL_GRAPH}, {_MEANS}, n as (select community, label, archetype, row_number() over (partition by community order by id) as r from member join nodes on id = node_id), k as (select community, archetype, count(*) as k, min(r) as first from n group by all), d as (select community, arg_min(archetype, -k * 1000000000 + first) as a from k group by 1) select community, a || ':' || string_agg(left(label, 6), ',' order by r) as short_label from n join d using (community) where r <= 2 group by community, a")
def community_label(spark, sf_dir):
    return _signatures(spark, sf_dir).select("community", "short_label")


_CLUSTER_HULLS = """mp as (select node, unnest(members) as m from {0}), pt as (select node, m, v[1] as x, v[2] as y from mp join nodes on id = m),
ce2 as (select p.node, p.m as a, q.m as b, p.x as px, p.y as py, q.x as qx, q.y as qy from pt p join pt q on p.node = q.node and p.m <> q.m join pt r on r.node = p.node and r.m not in (p.m, q.m) group by all having min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) > 0),
cn as (select node, count(*) as k from ce2 group by 1),
q0 as (select c.* from ce2 c join (select node, min(struct_pack(x := px, y := py)) as s from ce2 join cn using (node) where k = 4 group by 1) f on f.node = c.node and f.s.x = c.px and f.s.y = c.py),
q4 as (select q0.node, [q0.px, e1.px, e2.px, e3.px] as x, [q0.py, e1.py, e2.py, e3.py] as y from q0 join ce2 e1 on e1.node = q0.node and e1.a = q0.b join ce2 e2 on e2.node = q0.node and e2.a = e1.b join ce2 e3 on e3.node = q0.node and e3.a = e2.b),
qs as (select node, list_transform(range(0, 2), lambda i: abs((x[i + 2] - x[i + 1]) * (y[(i + 3) % 4 + 1] - y[i + 3]) - (y[i + 2] - y[i + 1]) * (x[(i + 3) % 4 + 1] - x[i + 3])) / (abs((x[i + 2] - x[i + 1]) * (x[(i + 3) % 4 + 1] - x[i + 3]) + (y[i + 2] - y[i + 1]) * (y[(i + 3) % 4 + 1] - y[i + 3])) + 1e-10)) as s,
 len(list_filter(range(0, 4), lambda i: abs(acos(((x[(i + 3) % 4 + 1] - x[i + 1]) * (x[(i + 1) % 4 + 1] - x[i + 1]) + (y[(i + 3) % 4 + 1] - y[i + 1]) * (y[(i + 1) % 4 + 1] - y[i + 1])) / (sqrt((x[(i + 3) % 4 + 1] - x[i + 1]) ** 2 + (y[(i + 3) % 4 + 1] - y[i + 1]) ** 2) * sqrt((x[(i + 1) % 4 + 1] - x[i + 1]) ** 2 + (y[(i + 1) % 4 + 1] - y[i + 1]) ** 2))) - pi() / 2) < radians(15))) as rights from q4),
cs as (select node, case k when 3 then 'triangle' when 4 then case when rights = 4 or s[1] < 0.10 then 'rectangle' when s[1] < 0.15 or s[2] < 0.15 then 'trapezoid' else 'polygon' end when 5 then 'pentagon' when 6 then 'hexagon' when 7 then 'heptagon' when 8 then 'octagon' else 'polygon' end as shape from cn left join qs using (node))"""


@query(f"with {SQL_GRAPH}, {_EGO}, {_CLUSTER_HULLS.format('ego')} select shape, count(*) as clusters from cs group by 1")
def tangram_classes(spark, sf_dir):
    """How many ego clusters have each shape, on their members' first two coordinates."""
    from .borders import shapes

    return shapes(spark, sf_dir).groupBy("shape").agg(F.count("*").alias("clusters"))


#: The same classes for communities, from their hulls' edges on their own planes.
_OWN_HULLS = re.sub(r"\b(ce2|cn|q0|q4|qs|cs)\b", r"\1_own", _CLUSTER_HULLS[_CLUSTER_HULLS.index("cn as"):])
_OWN = f"""ce2_own as (select p.community as node, p.id as a, q.id as b, p.x as px, p.y as py, q.x as qx, q.y as qy from pl p join pl q on p.community = q.community and p.id <> q.id join pl r on r.community = p.community and r.id <> p.id and r.id <> q.id
 group by p.community, p.id, q.id, p.x, p.y, q.x, q.y having min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) > 0),
{_OWN_HULLS}"""


@query(f"""with recursive {SQL_PLANE}, {_OWN}, {_HYPER}, {_CLUSTER_HULLS.format('hyper')}, al as (select 'hyper_edge' as kind, node as item, shape from cs union all select 'community', node, shape from cs_own),
tt as (select shape, count(*) as total from al group by 1) select kind, item, shape, total from al join tt using (shape)""")
def cluster_by_shape(spark, sf_dir):
    """All hyper-edges and communities by their shapes, each with how many have it."""
    from ..sources.tables import nodes

    at = nodes(spark, sf_dir).select("id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    hyper = build.cluster_shapes(g.hyper_edges(edges(spark, sf_dir)), at)
    own = build.community_hulls(projection.plane(coded(spark, sf_dir), members(spark, sf_dir))).select("community", geo.tangram(F.col("hull")).alias("tangram"))
    pick = lambda df, kind, item: g.cut(df.select(F.lit(kind).alias("kind"), F.col(item).cast("long").alias("item"), "tangram.shape"))
    found = pick(hyper, "hyper_edge", "node").unionByName(pick(own, "community", "community"))
    return found.join(found.groupBy("shape").agg(F.count("*").alias("total")), "shape").select("kind", "item", "shape", "total")


@query(f"with {SQL_GRAPH}, b as (select id, label from nodes where id % 3 <> 0), n as (select id, 'new' || id as label from nodes where id % 5 = 0) select coalesce(n.id, b.id) as id, coalesce(n.label, b.label) as label from b full join n using (id)")
def map_upsert(spark, sf_dir):
    """Two thirds of the nodes, into which every fifth node is put under another label; the later of two such rows counts."""
    n = coded(spark, sf_dir).select("id", "label")
    new = n.where("id % 5 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("old").alias("label")), F.struct(F.lit(2).alias("at"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("label")))).alias("x"))
    return build.upsert(n.where("id % 3 <> 0"), new.select("id", "x.at", "x.label"), order="at")


@query()
def map_communities(spark, sf_dir):
    """The communities of a whole build, after their nodes' votes, with all signatures."""
    n, e = g.cut(coded(spark, sf_dir)), g.cut(edges(spark, sf_dir))
    c = build.signatures(n, e, g.cut(g.label_propagation(e, g.membership(n))))
    return c.select("community", "n_nodes", "short_label", "hex_id", "n_edges", "skeleton", F.col("tangram.shape").alias("shape"), F.transform(build.signature_vector(), lambda x: F.round(x, 5)).alias("signature"))


@query()
def map_summary(spark, sf_dir):
    """Counts, modularity and the shapes of a whole build."""
    s = build.summary(build.build(coded(spark, sf_dir).drop("topic"), edges(spark, sf_dir)))
    return s.withColumn("modularity", F.round("modularity", 6)).withColumn("shapes", F.to_json("shapes"))


@query(f"with {SQL_GRAPH}, k as (select community, count(*) as n from member group by 1) select community, n, cast(rank as integer) as rank from (select *, row_number() over (order by n desc, community) as rank from k) where rank <= 5")
def largest_communities(spark, sf_dir):
    """The five communities with the most nodes."""
    n = members(spark, sf_dir).groupBy("community").agg(F.count("*").alias("n"))  # 64 rows at most
    top = n.orderBy(F.desc("n"), "community").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "community"))).alias("of"))
    return top.select(F.posexplode("of").alias("i", "x")).select("x.community", (-F.col("x.k")).alias("n"), (F.col("i") + 1).alias("rank"))


@query(f"""with {SQL_GRAPH}, {_MEANS}, k as (select community, count(*) as n_edges, sum(weight) as w from intra group by 1), n as (select community, count(*) as n_nodes from member group by 1),
d as (select id, sum(weight) as k from ends group by 1), t as (select 2 * sum(weight) as m2 from edges),
md as (select sum(2 * (weight - a.k * b.k / m2)) / any_value(m2) as modularity from intra join d a on a.id = source join d b on b.id = target, t)
select community, n_nodes, hex_id, coalesce(n_edges, 0) as n_edges, round(coalesce(w, 0), 5) as weight, list_transform(v, lambda x: round(x, 6)) as center, (select round(modularity, 6) from md) as modularity from ch join n using (community) left join k using (community)""")
def live_profiles(spark, sf_dir):
    """A map to which the nodes and edges come in three batches, some edges before their ends, as its sums then are."""
    n = coded(spark, sf_dir).select("id", "label", "embedding", "archetype")
    e = g.cut(edges(spark, sf_dir))
    state = maintain.empty(spark, len(CENTERS))
    for k in range(3):
        state = maintain.add(state, n.where(F.col("id") % 3 == k), e.where((F.col("source") + F.col("target")) % 3 == k))
    out = maintain.profiles(state).select("community", "n_nodes", "hex_id", "n_edges", F.round("weight", 5).alias("weight"), F.transform("center", lambda x: F.round(x, 6)).alias("center"))
    return out.withColumn("modularity", F.lit(round(state.modularity, 6)))
