"""Queries of shapes and borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import borders as b
from ..operators import graph as g
from ..sources.tables import following, nodes
from .cube import SQL_NODES, coded
from .graph import _MEANS, SQL_GRAPH, members
from .registry import query


def communities(spark, sf_dir):
    return g.mean_codes(members(spark, sf_dir), coded(spark, sf_dir))


def curves(spark, sf_dir):
    return b.border_curves(g.cut(communities(spark, sf_dir)))


#: Curves of the borders bp: a, b, hd, seed and both ends.
_CURVE = """bq as (select *, x1 - x0 as dx, y1 - y0 as dy, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as l, 0.15 + hd / 6.0 * 0.25 as amp from bp),
br as (select *, i, i / 47.0 as t, l * list_sum(list_transform([1.0, 2.0, 3.0, 4.0], lambda k: amp / k * sin(pi() * (i / 47.0) * k * (1 + hd) + fmod(seed * k * 0.37, 2 * pi())))) as off from bq, range(0, 48) r(i)),
cv as (select a, b, hd, i, x0 + t * dx - off * dy / l as x, y0 + t * dy + off * dx / l as y from br)"""
SQL_CURVES = f"""{SQL_GRAPH}, {_MEANS},
fc as (select hex_id, min(community) as community from ch group by 1),
vc as (select h, arg_min(community, cast(bit_count(xor(cast(h as integer), hex_id)) as integer) * 1000 + community) as community from fc, range(0, 64) r(h) group by 1),
tp as (select distinct least(x.community, y.community) as a, greatest(x.community, y.community) as b from vc x join vc y on bit_count(xor(cast(x.h as integer), cast(y.h as integer))) = 1 and x.community <> y.community),
bp as (select a, b, cast(bit_count(xor(p.hex_id, q.hex_id)) as integer) as hd, p.v[1] as x0, p.v[2] as y0, q.v[1] as x1, q.v[2] as y1, list_sum(list_transform(string_split('comm_' || a || 'comm_' || b, ''), lambda c: ord(c))) as seed from tp join ch p on p.community = a join ch q on q.community = b),
{_CURVE}"""


@query(f"with {SQL_CURVES} select a, b, hd, cast(i as integer) as i, round(x, 5) as x, round(y, 5) as y from cv")
def border_curve(spark, sf_dir):
    return curves(spark, sf_dir).select("a", "b", "hd", F.posexplode("curve").alias("i", "p")).select("a", "b", "hd", "i", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


_BOXES = """mm as (select *, min(x) over w as xm, max(x) over w - min(x) over w as sx, min(y) over w as ym, max(y) over w - min(y) over w as sy from cv window w as (partition by a, b)),
bx as (select a, b, k, count(distinct (floor((x - xm) / sx * 2 ** k), floor((y - ym) / sy * 2 ** k))) as n from mm, range(1, 13) r(k) group by all),
sl as (select a, b, greatest(1, least(2, regr_slope(ln(n), k * ln(2)))) as fd_box, count(*) as scales from bx where n >= 3 and n < 48 * 0.95 group by all)"""
_BOX = f"""{SQL_CURVES}, {_BOXES}"""


@query(f"with {_BOX} select a, b, round(fd_box, 5) as fd_box from sl where scales >= 2")
def border_fd_box(spark, sf_dir):
    return curves(spark, sf_dir).select("a", "b", F.round(geometry.box_dimension(F.col("curve")), 5).alias("fd_box"))


#: Borders of communities are all smooth in the given tables; those of single nodes are not.
_PAIR_BOX = f"""{SQL_NODES}, nx as (select id as a, lead(id) over w as b, v, hex_id, lead(v) over w as u, lead(hex_id) over w as h2 from nodes window w as (partition by topic order by id)),
bp as (select a, b, cast(bit_count(xor(hex_id, h2)) as integer) as hd, v[1] as x0, v[2] as y0, u[1] as x1, u[2] as y1, list_sum(list_transform(string_split('v' || a || 'v' || b, ''), lambda c: ord(c))) as seed from nx where b is not null),
{_CURVE}, {_BOXES}"""


def pair_curves(spark, sf_dir):
    """The borders that each node and the next of its topic would have."""
    n = coded(spark, sf_dir).select("id", "topic", "embedding", "hex_id", "label")
    side = lambda x, c: n.select(F.col("id").alias(x), F.col("embedding").alias(f"e_{c}"), F.col("hex_id").alias(f"hex_{c}"), F.col("label").alias(f"label_{c}"))
    pairs = following(n.select("id", "topic"), (1,)).join(side("id", "a"), "id").join(side("other", "b"), "other")
    curve = geometry.border_curve(F.col("e_a"), F.col("e_b"), F.col("hex_a"), F.col("hex_b"), F.concat("label_a", "label_b"), F.lit(0))
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b"), curve.alias("curve"))


@query(f"with {_PAIR_BOX} select a, b, round(fd_box, 5) as fd_box from sl where scales >= 2")
def pair_fd_box(spark, sf_dir):
    return pair_curves(spark, sf_dir).select("a", "b", F.round(geometry.box_dimension(F.col("curve")), 5).alias("fd_box"))


@query(f"with {_PAIR_BOX} select a, b from sl where fd_box > 1.0")
def fuzzy_borders(spark, sf_dir):
    return b.fuzzy(pair_curves(spark, sf_dir), 1.0)


@query(f"with {_PAIR_BOX} select a, b from sl where fd_box < 1.02")
def sharp_borders(spark, sf_dir):
    return b.sharp(pair_curves(spark, sf_dir), 1.02)


@query(f"with {SQL_CURVES}, st as (select a, b, i, sign(lead(x) over w - x) as sx, sign(lead(y) over w - y) as sy from cv window w as (partition by a, b order by i)) select a, b, string_agg(case when sx = 1 and sy = 0 then '0' when sx = 1 and sy = 1 then '1' when sx = 0 and sy = 1 then '2' when sx = -1 and sy = 1 then '3' when sx = -1 and sy = 0 then '4' when sx = -1 and sy = -1 then '5' when sx = 0 and sy = -1 then '6' when sx = 1 and sy = -1 then '7' else '?' end, '' order by i) as chain_code from st where sx is not null group by all")
def border_chain_code(spark, sf_dir):
    return curves(spark, sf_dir).select("a", "b", geometry.chain_code(F.col("curve")).alias("chain_code"))


@query()
def border_signatures(spark, sf_dir):
    return b.signatures(curves(spark, sf_dir))


#: Heights over the chord, in eight segments of six; each against the whole, read at six places.
SQL_IFS = f"""{SQL_CURVES}, cl as (select a, b, list(x order by i) as x, list(y order by i) as y from cv group by all),
hg as (select a, b, list_transform(range(1, 49), lambda i: ((x[48] - x[1]) * (y[i] - y[1]) - (y[48] - y[1]) * (x[i] - x[1])) / sqrt((x[48] - x[1]) ** 2 + (y[48] - y[1]) ** 2)) as h from cl),
wh as (select a, b, h, list_transform(range(0, 6), lambda i: h[cast(floor(i * 47 / 5) as integer) + 1] * (1 - (i * 47 / 5 - floor(i * 47 / 5))) + h[least(cast(floor(i * 47 / 5) as integer) + 1, 47) + 1] * (i * 47 / 5 - floor(i * 47 / 5))) as w from hg),
fs as (select a, b, list_transform(range(0, 8), lambda k: greatest(-0.95, least(0.95, list_dot_product(h[k * 6 + 1:k * 6 + 6], w) / (list_dot_product(w, w) + 1e-10)))) as ifs from wh),
bs as (select p.a, p.b, q.a as c, q.b as d, round(1 / (1 + sqrt(list_sum([(p.ifs[i] - q.ifs[i]) ** 2 for i in range(1, 9)]))), 6) as similarity from fs p, fs q where (p.a, p.b) <> (q.a, q.b)),
rb as (select *, cast(row_number() over (partition by a, b order by similarity desc, c, d) as integer) as rank from bs)"""


@query(f"with {SQL_IFS} select a, b, list_transform(ifs, lambda x: round(x, 5)) as ifs from fs")
def border_ifs(spark, sf_dir):
    return curves(spark, sf_dir).select("a", "b", F.transform(geometry.ifs(F.col("curve")), lambda x: F.round(x, 5)).alias("ifs"))


def _similar(spark, sf_dir):
    s = b.similar(g.cut(curves(spark, sf_dir).select("a", "b", geometry.ifs(F.col("curve")).alias("ifs"))))
    return s.withColumn("similarity", F.round("similarity", 6))


@query(f"with {SQL_IFS} select * from rb where rank <= 5")
def border_similarity(spark, sf_dir):
    """The five borders most similar to each."""
    return b.ranked(_similar(spark, sf_dir), 5)


@query(f"with {SQL_IFS}, qq as (select community as p, community + 0 as k from ch), ask as (select x.p, y.p as q from qq x, qq y where x.p <> y.p), hit as (select p, q, a, b from ask join fs on (a = p and b = q) or (a = q and b = p)) select p, q, c, d, similarity, rank from hit join rb using (a, b) where rank <= 3")
def boundary_search(spark, sf_dir):
    """For every two communities that touch, in either order, the three borders most similar to theirs."""
    c = g.cut(communities(spark, sf_dir)).select(F.col("community").alias("p"))
    every = c.select("p", F.lit(1).alias("k"))
    asked = every.join(every.select(F.col("p").alias("q"), "k"), "k").where("p <> q").select("p", "q")  # of 64 communities at most
    return b.search(asked, _similar(spark, sf_dir), 3)


@query(f"""with {SQL_GRAPH}, {_MEANS}, k as (select a, b, fd_box from (with {_BOX} select * from sl where scales >= 2)),
t as (select a as community, fd_box from k union all select b, fd_box from k) select community, count(*) as borders, round(avg(fd_box), 5) as mean_fd from t group by 1""")
def border_mean_fd(spark, sf_dir):
    fd = curves(spark, sf_dir).select(F.array("a", "b").alias("ab"), geometry.box_dimension(F.col("curve")).alias("fd"))
    fd = g.cut(fd).select(F.explode("ab").alias("community"), "fd")
    return fd.groupBy("community").agg(F.count("*").alias("borders"), F.round(F.avg("fd"), 5).alias("mean_fd"))


def shapes(spark, sf_dir):
    """The hull shape of every ego cluster, on its members' first two coordinates (12 members at most by construction)."""
    from ..sources.tables import edges

    at = nodes(spark, sf_dir).select(F.col("id").alias("m"), geometry.point(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1))).alias("p"))
    egos = g.ego_clusters(edges(spark, sf_dir)).select("node", "n", F.explode("members").alias("m")).join(at, "m").groupBy("node", "n").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return egos.select("node", "n", geometry.hull(F.col("ps")).alias("hull")).select("node", "n", F.size("hull").alias("vertices"), geometry.shape(F.col("hull")).alias("shape"), geometry.area(F.col("hull")).alias("area"))


_HULL = f"""{SQL_GRAPH}, {{EGO}}, mp as (select node, unnest(members) as m from ego), pt as (select node, m, v[1] as x, v[2] as y from mp join nodes on id = m),
he as (select p.node, p.m as a, q.m as b, p.x as px, p.y as py, q.x as qx, q.y as qy from pt p join pt q on p.node = q.node and p.m <> q.m join pt r on r.node = p.node and r.m not in (p.m, q.m) group by all having min((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) > 0)"""


def _hull_sql() -> str:
    from .graph import _EGO

    return f"with {_HULL.replace('{EGO}', _EGO)} select ego.node, n, cast(count(*) as integer) as vertices, round(abs(sum(px * qy - qx * py)) / 2, 6) as area from he join ego using (node) group by all"


@query(_hull_sql())
def tangram_shapes(spark, sf_dir):
    return shapes(spark, sf_dir).select("node", "n", "vertices", F.round("area", 6).alias("area"))


@query(f"with {SQL_NODES}, r as (select id, [v[i] for i in range(1, 8)] as raw from nodes), c as (select id, list_transform(raw, lambda x: greatest(0, least(1, x))) as l from r) select id, list_transform(l, lambda x: round(x, 6)) as lengths, round(list_sum(l) / 7, 6) as energy, cast(list_position(l, list_max(l)) - 1 as integer) as dominant, round(1 / (1 + 10 * list_sum(list_transform(l, lambda x: (x - list_sum(l) / 7) ** 2)) / 7), 6) as symmetry from c")
def heptagram_rays(spark, sf_dir):
    """Seven rays from the first seven coordinates of every node."""
    rays = nodes(spark, sf_dir).select("id", F.transform(geometry.heptagram(F.slice("embedding", 1, 7)), lambda r: r["length"]).alias("l"))
    l = F.col("l")
    return rays.select("id", F.transform(l, lambda x: F.round(x, 6)).alias("lengths"), F.round(geometry.total(l) / 7, 6).alias("energy"), (F.array_position(l, F.array_max(l)) - 1).cast("int").alias("dominant"), F.round(geometry.symmetry(l), 6).alias("symmetry"))
