"""Queries of graph construction and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import propagation as p
from ..sources.tables import edges
from .cube import CENTERS, SQL_CENTER, SQL_NODES, coded
from .registry import query

SQL_GRAPH = f"""{SQL_NODES},
rn as (select id, topic, v, row_number() over (partition by topic order by id) as rn from nodes),
edges as (select a.id as source, b.id as target, (list_cosine_similarity(a.v, b.v) + 1) / 2 as weight, a.id % 2 = 0 as directed from rn a join rn b on a.topic = b.topic and b.rn - a.rn in (1, 2, 3, 5)),
member as (select id as node_id, cast({SQL_CENTER}[hex_id + 1] as integer) as community from nodes),
ends as (select source as id, target as other, weight from edges union all select target, source, weight from edges),
intra as (select e.*, a.community from edges e join member a on a.node_id = source join member b on b.node_id = target where a.community = b.community)"""


def members(spark, sf_dir):
    return g.membership(coded(spark, sf_dir), len(CENTERS))


@query(f"with {SQL_GRAPH} select * from member")
def graph_membership(spark, sf_dir):
    return members(spark, sf_dir)


@query(f"with {SQL_GRAPH} select source, target, round(weight, 6) as weight, community from intra")
def graph_intra_edges(spark, sf_dir):
    return g.intra_edges(edges(spark, sf_dir), members(spark, sf_dir)).select("source", "target", F.round("weight", 6).alias("weight"), "community")


@query(f"with {SQL_GRAPH} select id, round(sum(weight), 6) as degree, count(*) as n_edges from ends group by id")
def graph_degree(spark, sf_dir):
    return g.degrees(edges(spark, sf_dir)).select("id", F.round("degree", 6).alias("degree"), "n_edges")


@query(f"""with {SQL_GRAPH}, d as (select id, sum(weight) as k from ends group by 1), t as (select 2 * sum(weight) as m2 from edges)
select count(*) as n_intra, round(sum(2 * (weight - a.k * b.k / m2)) / any_value(m2), 6) as modularity from intra join d a on a.id = source join d b on b.id = target, t""")
def graph_modularity(spark, sf_dir):
    return g.modularity(edges(spark, sf_dir), members(spark, sf_dir)).select("n_intra", F.round("modularity", 6).alias("modularity"))


_DOMINANT = """each as (select community, archetype, count(*) as k, min(id) as first from member join nodes on id = node_id group by all),
dom as (select community, cast(sum(k) as bigint) as n_nodes, arg_min(archetype, -k * 1000000000 + first) as dominant_archetype from each group by 1)"""


@query(f"with {SQL_GRAPH}, {_DOMINANT} select * from dom")
def dominant_archetype(spark, sf_dir):
    return g.dominant(members(spark, sf_dir), coded(spark, sf_dir))


@query(f"""with {SQL_GRAPH}, k as (select community, avg(weight) as mean, avg(case when directed then 1.0 else 0 end) as ways, count(*) as n, max(weight) as high from intra group by 1), c as (select distinct community from member)
select community, round(case when n is null then 0.5 else least(1, mean) end, 6) as strength, round(coalesce(ways, 0.5), 6) as direction, 0.5::double as temporal, round(case when n is null then 0.5 else least(1, mean) end, 6) as confidence, round(case when n is null then 0.5 else least(1.0, n / 20) end, 6) as scale, round(case when n is null then 0.5 else least(1, high) end, 6) as context, case when n is null then 0.5 else 0.7 end::double as source from c left join k using (community)""")
def community_heptagram(spark, sf_dir):
    """The seven rays of every community; one without inner edges has rays of one half."""
    m = members(spark, sf_dir)
    rays = g.community_rays(m, g.intra_edges(edges(spark, sf_dir), m))
    return rays.select("community", *[F.round(r, 6).alias(r) for r in g.RAYS])


_MEANS = """ex as (select community, unnest(v) as x, unnest(range(0, len(v))) as i from member join nodes on id = node_id),
av as (select community, i, avg(x) as m from ex group by all), ce as (select community, list(m order by i) as v from av group by 1),
cp as (select community, v, list_transform(range(0, 6), lambda d: list_sum(v[d * len(v) // 6 + 1:(d + 1) * len(v) // 6]) / ((d + 1) * len(v) // 6 - d * len(v) // 6)) as p from ce),
ch as (select community, v, cast(list_sum(list_transform(range(0, 6), lambda i: case when p[i + 1] > list_sum(p) / 6 then 1 << i else 0 end)) as integer) as hex_id from cp)"""


@query(f"with {SQL_GRAPH}, {_MEANS}, b as (select community, hex_id, [cast((hex_id >> i) & 1 as double) for i in range(0, 6)] as b from ch) select community, hex_id, [b[1], b[2], b[3], b[4], 1 - b[1], b[5], b[6], b[2] * b[3]] as rays, case when b[1] = 1 then 'tower' else 'fractal' end as skeleton from b")
def community_octagram(spark, sf_dir):
    c = g.mean_codes(members(spark, sf_dir), coded(spark, sf_dir))
    return c.select("community", "hex_id", g.octagram(F.col("hex_id")).alias("rays"), g.skeleton(F.col("hex_id")).alias("skeleton"))


@query(f"""with {SQL_GRAPH}, {_DOMINANT}, {_MEANS}, k as (select community, count(*) as n_edges from intra group by 1)
select community, n_nodes, dominant_archetype, hex_id, coalesce(n_edges, 0) as n_edges, list_transform(v, lambda x: round(x, 6)) as center from dom join ch using (community) left join k using (community)""")
def community_profile(spark, sf_dir):
    n, m = coded(spark, sf_dir), members(spark, sf_dir)
    k = g.intra_edges(edges(spark, sf_dir), m).groupBy("community").agg(F.count("*").alias("n_edges"))
    c = g.dominant(m, n).join(g.mean_codes(m, n), "community").join(k, "community", "left")
    return c.select("community", "n_nodes", "dominant_archetype", "hex_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.transform("center", lambda x: F.round(x, 6)).alias("center"))


_EGO = """np as (select distinct id, other from ends where id <> other),
cm as (select a.id, c.other, count(*) as common from np a join np b on a.other = b.id join np c on c.id = a.id and c.other = b.other group by all),
rk as (select np.id, np.other, row_number() over (partition by np.id order by coalesce(common, 0) desc, np.other) as r from np left join cm on cm.id = np.id and cm.other = np.other),
ego as (select id as node, list_sort(list_append(list(other), id)) as members, cast(count(*) + 1 as integer) as n from rk where r < 8 group by 1 having count(*) >= 2)"""
_NAME = "case n when 3 then 'triad' when 4 then 'quad' when 5 then 'pentagon_cluster' when 6 then 'hexagon_community' when 7 then 'heptagram_group' when 8 then 'octagram_domain' end"


@query(f"with {SQL_GRAPH}, {_EGO} select * from ego")
def ego_clusters(spark, sf_dir):
    return g.ego_clusters(edges(spark, sf_dir))


@query(f"with {SQL_GRAPH}, {_EGO} select {_NAME} as label, count(*) as clusters from ego group by 1")
def hyper_label(spark, sf_dir):
    return g.ego_clusters(edges(spark, sf_dir)).groupBy(g.cluster_name(F.col("n")).alias("label")).agg(F.count("*").alias("clusters"))


_SWEEP = """tally as (select e.id as node_id, m.community as c, sum(weight) as w from ends e join member m on m.node_id = e.other group by all),
bst as (select t.node_id, max(case when c = community then w end) as mine, max(case when c <> community then w end) as theirs, arg_max(c, case when c <> community then w end) as other from tally t join member using (node_id) group by 1)"""


@query(f"with {SQL_GRAPH}, {_SWEEP} select node_id, case when coalesce(theirs > 1.5 * (1 + coalesce(mine, 0)), false) then other else community end as community, coalesce(theirs > 1.5 * (1 + coalesce(mine, 0)), false) as moved from member left join bst using (node_id)")
def lp_one_sweep_sync(spark, sf_dir):
    return g.vote_sweep(edges(spark, sf_dir), members(spark, sf_dir))


@query()
def lp_communities(spark, sf_dir):
    return g.label_propagation(edges(spark, sf_dir), members(spark, sf_dir))


_ORDERED = """adj as (select id, list({'o': other, 'w': weight} order by other) as adj from ends group by 1),
od as materialized (select node_id as id, coalesce(adj, []) as adj, row_number() over (order by (node_id * 37) % 101, node_id) as o from member left join adj on id = node_id),
sw(o, com) as (select cast(0 as bigint), (select list(community order by node_id) from member)
 union all select o, case when theirs.w > 1.5 * (1 + mine) then com[1:id] || [cast(-theirs.n as integer)] || com[id + 2:] else com end from
 (select o, id, com, coalesce(list_sum(list_transform(list_filter(v, lambda x: x.c = cur), lambda x: x.w)), 0) as mine, list_max(list_transform(list_distinct(list_transform(list_filter(v, lambda x: x.c <> cur), lambda x: x.c)), lambda c: {'w': list_sum(list_transform(list_filter(v, lambda x: x.c = c), lambda x: x.w)), 'n': -c})) as theirs from
  (select od.o, od.id, com, com[od.id + 1] as cur, list_transform(adj, lambda a: {'c': com[a.o + 1], 'w': a.w}) as v from sw join od on od.o = sw.o + 1)))"""


@query(f"with recursive {SQL_GRAPH}, {_ORDERED}, fin as (select com from sw order by o desc limit 1) select node_id, com[node_id + 1] as community, com[node_id + 1] <> community as moved from member, fin")
def lp_one_sweep_ordered(spark, sf_dir):
    """One sequential sweep, in an order that jumps over the ids (the SQL takes ids to be 0, 1, 2, ...)."""
    return p.ordered_sweep(edges(spark, sf_dir), members(spark, sf_dir), lambda c: (c * 37) % 101)


#: Clusters in the order of their nodes; each stays if none that stayed before shares more than 0.8 of the larger with it.
_HYPER = f"""{_EGO}, eo as materialized (select *, row_number() over (order by node) as o from ego),
cl as materialized (select b.o, list(a.node) as earlier from eo a join eo b on a.o < b.o and len(list_intersect(a.members, b.members)) > 0.8 * greatest(a.n, b.n) group by 1),
eq as materialized (select eo.*, coalesce(earlier, []) as earlier from eo left join cl using (o)),
kp(o, kept) as (select cast(0 as bigint), cast([] as bigint[]) union all select eq.o, case when len(list_intersect(earlier, kept)) > 0 then kept else list_append(kept, node) end from kp join eq on eq.o = kp.o + 1),
hyper as (select node, members, n from ego where list_contains((select kept from kp order by o desc limit 1), node))"""


@query(f"with recursive {SQL_GRAPH}, {_HYPER} select node, members, {_NAME} as label from hyper")
def hyper_edges(spark, sf_dir):
    return g.hyper_edges(edges(spark, sf_dir))


@query(f"""with {SQL_GRAPH} select (select count(*) from nodes) as n_nodes, (select count(*) from edges) as n_edges, (select count(distinct community) from member) as n_communities, (select round(avg(weight), 6) from edges) as mean_weight""")
def graph_stats(spark, sf_dir):
    e = edges(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    m = members(spark, sf_dir).agg(F.count("*").alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    return m.join(e, F.lit(True))


@query(f"with {SQL_NODES} select archetype, count(*) as n from nodes group by 1")
def archetype_histogram(spark, sf_dir):
    return coded(spark, sf_dir).groupBy("archetype").agg(F.count("*").alias("n"))
