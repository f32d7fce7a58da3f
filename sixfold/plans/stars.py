"""Queries of seven- and eight-pointed stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import vectors
from ..operators import graph as g
from ..sources.tables import following, nodes
from .borders import communities
from .cube import SQL_NODES, coded
from .graph import _MEANS, SQL_GRAPH
from .registry import query

_HEPT = "hp as (select id, topic, list_transform([v[i] for i in range(1, 8)], lambda x: greatest(0, least(1, x))) as l from nodes)"
_HVEC = "list_concat(list_concat(l, list_transform(l, lambda x: x * 0.3)), list_transform(l, lambda x, i: x * 0.5 * sin((i - 1) * 2 * pi() / 7)))"


def _heptagrams(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", "topic", geo.heptagram(F.slice("embedding", 1, 7)).alias("rays"))


@query(f"with {SQL_NODES}, {_HEPT} select id, list_transform({_HVEC}, lambda x: round(x, 6) + 0) as v, list_transform(l, lambda x, i: round(x * cos((i - 1) * 2 * pi() / 7), 6) + 0) as xs, list_transform(l, lambda x, i: round(x * sin((i - 1) * 2 * pi() / 7), 6) + 0) as ys from hp")
def heptagram_vectors(spark, sf_dir):
    """The 21 numbers of each node's seven-pointed star and where its tips lie; rounded zeros have no sign."""
    rays = _heptagrams(spark, sf_dir)
    ends = geo.heptagram_ends(F.col("rays"))
    return rays.select("id", F.transform(geo.heptagram_vector(F.col("rays")), lambda x: F.round(x, 6)).alias("v"), F.transform(ends, lambda p: F.round(p["x"], 6)).alias("xs"), F.transform(ends, lambda p: F.round(p["y"], 6)).alias("ys"))


@query(f"with {SQL_NODES}, {_HEPT}, w as (select id, topic, {_HVEC} as v from hp), p as (select id, v, lead(v) over (partition by topic order by id) as u from w) select id, round(sqrt(list_sum(list_transform(range(1, 22), lambda i: (v[i] - u[i]) ** 2))), 6) as distance from p where u is not null")
def heptagram_distance(spark, sf_dir):
    """Distances between the stars of each node and the next of its topic."""
    v = _heptagrams(spark, sf_dir).select("id", "topic", geo.heptagram_vector(F.col("rays")).alias("v"))
    pairs = following(v.select("id", "topic"), (1,))
    a, b = v.select("id", F.col("v").alias("a")), v.select(F.col("id").alias("other"), F.col("v").alias("b"))
    return pairs.join(a, "id").join(b, "other").select("id", F.round(vectors.distance(F.col("a"), F.col("b")), 6).alias("distance"))


_OCT = """op as (select id, topic, list_transform([v[i] for i in range(1, 9)], lambda x: greatest(0, least(1, abs(x) * 4))) as l, [v[i] * 3 for i in range(9, 17)] as g from nodes),
oc as (select id, topic, l, list_transform(range(1, 9), lambda i: case when g[i] = 0 then (l[i] - 0.5) * pi() / 4 else g[i] end) as e from op),
os as (select *, list_sum(l) / 8 as m, list_sum(list_transform(e, lambda x: abs(x))) / 8 as steep, len(list_filter(range(1, 9), lambda i: e[i] > e[case when i = 1 then 8 else i - 1 end])) as rises from oc),
ov as (select *, list_sum(list_transform(l, lambda x: (x - m) ** 2)) / 8 as varied from os)"""
_SKELETON = "case when varied < 0.02 then 'sphere' when steep > 0.4 then case when rises > 4 then 'shell' else 'cone' end when l[1] > l[5] * 1.5 then 'tower' else 'fractal' end"
_AXIS = "['N-S', 'E-W', 'NE-SW', 'NW-SE'][list_position([l[1] + l[5], l[3] + l[7], l[2] + l[6], l[8] + l[4]], list_max([l[1] + l[5], l[3] + l[7], l[2] + l[6], l[8] + l[4]]))]"


def _octagrams(spark, sf_dir):
    """Directions from the first eight numbers of each vector, elevations from the next eight."""
    v = F.col("embedding")
    return nodes(spark, sf_dir).select("id", "topic", geo.octagram(F.transform(F.slice(v, 1, 8), lambda x: F.abs(x) * 4), F.transform(F.slice(v, 9, 8), lambda x: x * 3)).alias("rays"))


@query(f"with {SQL_NODES}, {_OCT} select id, list_transform(list_concat(l, e), lambda x: round(x, 6)) as v, {_SKELETON} as skeleton, {_AXIS} as axis, len(list_filter(e, lambda x: abs(x) >= 0.1)) = 0 as flat, round(list_sum(list_transform(range(1, 9), lambda i: l[i] * sin(e[i]))), 6) as height from ov")
def octagram_signature(spark, sf_dir):
    """Every node's eight-pointed star: its 16 numbers, skeleton, main axis, whether it is flat, and the sum of its tips' heights."""
    r = F.col("rays")
    height = F.aggregate(geo.octagram_vertices(r), F.lit(0.0), lambda a, p: a + p["z"])
    return _octagrams(spark, sf_dir).select("id", F.transform(geo.octagram_vector(r), vectors.rounded).alias("v"), geo.octagram_skeleton(r).alias("skeleton"), geo.octagram_axis(r).alias("axis"), geo.octagram_flat(r).alias("flat"), vectors.rounded(height).alias("height"))


@query(f"with {SQL_NODES}, {_OCT}, p as (select id, list_concat(l, e) as v, lead(list_concat(l, e)) over (partition by topic order by id) as u from oc) select id, round(sqrt(list_sum(list_transform(range(1, 17), lambda i: (v[i] - u[i]) ** 2))), 6) as distance from p where u is not null")
def octagram_distance(spark, sf_dir):
    """Distances between the eight-pointed stars of each node and the next of its topic."""
    v = _octagrams(spark, sf_dir).select("id", "topic", geo.octagram_vector(F.col("rays")).alias("v"))
    pairs = following(v.select("id", "topic"), (1,))
    a, b = v.select("id", F.col("v").alias("a")), v.select(F.col("id").alias("other"), F.col("v").alias("b"))
    return pairs.join(a, "id").join(b, "other").select("id", F.round(vectors.distance(F.col("a"), F.col("b")), 6).alias("distance"))


_SHELL = "list_transform(range(0, 8), lambda i: least(1.0, 0.3 + 0.7 * pow((1 + sqrt(5)) / 2, i / 8 * 1.5) / pow((1 + sqrt(5)) / 2, 1.5)))"
_TOWER = "[0.9, 0.6, 0.7, 0.5, 0.8, 0.4, 0.6, 0.5]"


@query(f"""with {SQL_GRAPH}, {_MEANS}, b as (select community, [cast((hex_id >> i) & 1 as double) for i in range(0, 6)] as b from ch),
r as (select community, [b[1], b[2], b[3], b[4], 1 - b[1], b[5], b[6], b[2] * b[3]] as l from b), s as (select community, l, list_transform(l, lambda x: (x - 0.5) * pi() / 4) as e from r),
t as (select 'shell' as preset, {_SHELL} as pl, list_transform(range(0, 8), lambda i: pi() / 4 * sin(2 * pi() * i / 8)) as pe union all select 'tower', {_TOWER}, list_transform(range(1, 9), lambda i: case when [pi() / 3, pi() / 6, 0, -pi() / 6, -pi() / 3, -pi() / 4, 0, pi() / 4][i] = 0 then ({_TOWER}[i] - 0.5) * pi() / 4 else [pi() / 3, pi() / 6, 0, -pi() / 6, -pi() / 3, -pi() / 4, 0, pi() / 4][i] end))
select community, preset, round(sqrt(list_sum(list_transform(range(1, 9), lambda i: (l[i] - pl[i]) ** 2 + (e[i] - pe[i]) ** 2))), 6) as distance from s, t""")
def octagram_presets(spark, sf_dir):
    """How far each community's star is from a shell of one and a half turns and from a tower."""
    presets = F.array(*[F.struct(F.lit(name).alias("preset"), F.lit([x for x, _ in rays] + [e for _, e in rays]).alias("w")) for name, rays in (("shell", geo.shell_octagram(1.5)), ("tower", geo.tower_octagram()))])
    v = communities(spark, sf_dir).select("community", geo.octagram_vector(geo.octagram(g.octagram(F.col("hex_id")))).alias("v")).withColumn("p", F.explode(presets))
    return v.select("community", "p.preset", F.round(vectors.distance(F.col("v"), F.col("p.w")), 6).alias("distance"))


@query(f"with {SQL_NODES}, p as (select id, hex_id as a, lead(hex_id) over (partition by topic order by id) as b from nodes), q as (select id, [cast((a >> i) & 1 as double) for i in range(0, 6)] as a, [cast((b >> i) & 1 as double) for i in range(0, 6)] as b from p where b is not null), r as (select id, [a[1], a[2], a[3], a[4], 1 - a[1], a[5], a[6], a[2] * a[3]] as a, [b[1], b[2], b[3], b[4], 1 - b[1], b[5], b[6], b[2] * b[3]] as b from q) select id, round(sqrt(list_sum(list_transform(range(1, 9), lambda i: (a[i] - b[i]) ** 2))), 6) as distance, round(1 / (1 + 10 * list_sum(list_transform(a, lambda x: (x - list_sum(a) / 8) ** 2)) / 8), 6) as symmetry from r")
def octagram_code_distance(spark, sf_dir):
    """Distances between the ray lengths that the codes of each node and the next of its topic give, and the first's symmetry."""
    n = coded(spark, sf_dir).select("id", g.octagram(F.col("hex_id")).alias("v"))
    pairs = following(nodes(spark, sf_dir).select("id", "topic"), (1,))
    both = pairs.join(n.select("id", F.col("v").alias("a")), "id").join(n.select(F.col("id").alias("other"), F.col("v").alias("b")), "other")
    return both.select("id", F.round(vectors.distance(F.col("a"), F.col("b")), 6).alias("distance"), F.round(geo.symmetry(F.col("a")), 6).alias("symmetry"))
