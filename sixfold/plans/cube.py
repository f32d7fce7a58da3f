"""Queries of the 6-cube algebra and the vector functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import q6, vectors
from ..sources.tables import ARCHETYPES, following, nodes, read
from .registry import query

CENTERS = q6.packing(1)[:8]

#: SQL of an embedding's code: six chunk means against their mean.
SQL_NODES = f"""
n0 as (select vec_id as id, 'v' || vec_id as label, label as topic, {ARCHETYPES!r}[label % 16 + 1] as archetype, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
n1 as (select *, case when len(v) <= 6 then list_concat(v, [0.0, 0, 0, 0, 0, 0])[1:6] else list_transform(range(0, 6), lambda d: list_sum(v[d * len(v) // 6 + 1:(d + 1) * len(v) // 6]) / ((d + 1) * len(v) // 6 - d * len(v) // 6)) end as p from n0),
n2 as (select *, list_sum(p) / 6 as mu from n1),
nodes as (select id, label, topic, archetype, v, cast(list_sum(list_transform(range(0, 6), lambda i: case when p[i + 1] > mu then 1 << i else 0 end)) as integer) as hex_id from n2)
"""
SQL_CENTER = f"{list(q6.voronoi(CENTERS))!r}"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).withColumn("hex_id", q6.embed(F.col("embedding")))


@query(f"with {SQL_NODES} select id, hex_id from nodes")
def q6_hash(spark, sf_dir):
    return coded(spark, sf_dir).select("id", "hex_id")


@query(f"with {SQL_NODES}, s as (select id, hex_id, {SQL_CENTER}[hex_id + 1] as center from nodes) select id, hex_id, cast(center as integer) as center, cast(bit_count(xor(hex_id, center)) as integer) as radius from s")
def q6_signature(spark, sf_dir):
    """Every node's code, the nearest center and how far it is."""
    center = q6.cell(F.col("hex_id"), CENTERS)
    return coded(spark, sf_dir).select("id", "hex_id", center.alias("center"), q6.hamming(F.col("hex_id"), center).alias("radius"))


@query(f"""with {SQL_NODES},
c as (select unnest({list(CENTERS)!r}) as center, unnest(range(0, {len(CENTERS)})) as ord),
m as (select n.id, n.archetype, arg_min(cast(c.center as integer), cast(bit_count(xor(n.hex_id, cast(c.center as integer))) as integer) * 100 + c.ord) as center from nodes n, c group by n.id, n.archetype),
a as (select center, archetype, count(*) as k, min(id) as first from m group by all)
select center, cast(sum(k) as bigint) as n, arg_min(archetype, -k * 1000000000 + first) as dominant_archetype from a group by center""")
def q6_voronoi_communities(spark, sf_dir):
    member = coded(spark, sf_dir).select("id", "archetype", q6.cell(F.col("hex_id"), CENTERS).alias("center"))
    each = member.groupBy("center", "archetype").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    return each.groupBy("center").agg(F.sum("k").alias("n"), F.min_by("archetype", F.struct(-F.col("k"), F.col("first"))).alias("dominant_archetype"))


@query(f"with {SQL_NODES} select id, [cast((hex_id >> i) & 1 as integer) for i in range(0, 6)] as bits, hex_id as back, list_filter({q6.AXES!r}, lambda a, i: ((hex_id >> (i - 1)) & 1) = 1) as axes from nodes")
def q6_bits(spark, sf_dir):
    h = F.col("hex_id")
    axes = F.filter(F.array(*[F.when(F.shiftright(h, i).bitwiseAND(1) == 1, F.lit(a)) for i, a in enumerate(q6.AXES)]), lambda a: a.isNotNull())
    return coded(spark, sf_dir).select("id", q6.bits(h).alias("bits"), q6.from_bits(q6.bits(h)).alias("back"), axes.alias("axes"))


@query(f"with {SQL_NODES}, c as (select hex_id, count(*) as k from nodes group by 1) select cast(bit_count(xor(a.hex_id, b.hex_id)) as integer) as distance, cast(sum(a.k * b.k) as bigint) as pairs from c a, c b group by 1")
def q6_hamming_matrix(spark, sf_dir):
    c = coded(spark, sf_dir).groupBy("hex_id").agg(F.count("*").alias("k"))  # 64 rows at most
    b = c.select(F.col("hex_id").alias("other"), F.col("k").alias("l"))
    reach = c.select("hex_id", "k", F.explode(q6.codes()).alias("other"))
    return reach.join(b, "other").groupBy(q6.hamming(F.col("hex_id"), F.col("other")).alias("distance")).agg(F.sum(F.col("k") * F.col("l")).alias("pairs"))


@query(f"with {SQL_NODES} select id, list_filter(range(0, 64), lambda h: bit_count(xor(cast(h as integer), hex_id)) <= 2)::integer[] as ball2, list_filter(range(0, 64), lambda h: bit_count(xor(cast(h as integer), hex_id)) = 1)::integer[] as sphere1, xor(hex_id, 63) as antipode, list_transform(range(0, 6), lambda i: xor(hex_id, 1 << cast(i as integer)))::integer[] as neighbors from nodes")
def q6_ball(spark, sf_dir):
    h = F.col("hex_id")
    return coded(spark, sf_dir).select("id", q6.ball(h, 2).alias("ball2"), q6.sphere(h, 1).alias("sphere1"), q6.antipode(h).alias("antipode"), q6.neighbors(h).alias("neighbors"))


SQL_PAIRS = f"{SQL_NODES}, pairs as (select id, hex_id as a, lead(hex_id) over (partition by topic order by id) as b from nodes)"


def _pairs(spark, sf_dir):
    n = coded(spark, sf_dir).select("id", "topic", "hex_id")
    pairs = following(n.select("id", "topic"), (1,)).join(n.select("id", F.col("hex_id").alias("a")), "id")
    return pairs.join(n.select(F.col("id").alias("other"), F.col("hex_id").alias("b")), "other").select("id", "a", "b")


@query(f"with {SQL_PAIRS} select id, list_filter(range(0, 64), lambda h: bit_count(xor(cast(h as integer), a)) + bit_count(xor(cast(h as integer), b)) = bit_count(xor(a, b)))::integer[] as between_ids, cast(bit_count(xor(a, b)) as integer) as distance from pairs where b is not null")
def q6_interval(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("id", q6.interval(a, b).alias("between_ids"), q6.hamming(a, b).alias("distance"))


@query(f"""with recursive {SQL_PAIRS},
step(id, here, b, path) as (select id, a, b, [a] from pairs where b is not null
 union all select id, xor(here, 1 << cast(floor(log2(xor(here, b))) as integer)), b, list_append(path, xor(here, 1 << cast(floor(log2(xor(here, b))) as integer))) from step where here <> b)
select id, path from step where here = b""")
def q6_shortest_path(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", q6.shortest_path(F.col("a"), F.col("b")).alias("path"))


@query(f"with {SQL_NODES}, b as (select topic, i, sum((hex_id >> cast(i as integer)) & 1) * 2 > count(*) as bit from nodes, range(0, 6) r(i) group by all) select topic, cast(sum(case when bit then 1 << cast(i as integer) else 0 end) as integer) as median from b group by 1")
def q6_median_by_label(spark, sf_dir):
    return coded(spark, sf_dir).groupBy("topic").agg(q6.median(F.col("hex_id")).alias("median"))


@query(f"with {SQL_NODES}, k as (select cast(h as integer) as hex_id, {SQL_CENTER}[h + 1] as center from range(0, 64) r(h)) select k.hex_id, cast(center as integer) as center, count(id) as n from k left join nodes using (hex_id) group by all")
def q6_voronoi(spark, sf_dir):
    every = spark.range(64).select(F.col("id").cast("int").alias("hex_id"))
    found = coded(spark, sf_dir).groupBy("hex_id").agg(F.count("*").alias("n"))
    return every.join(found, "hex_id", "left").select("hex_id", q6.cell(F.col("hex_id"), CENTERS).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {SQL_NODES}, k as (select distinct hex_id, {SQL_CENTER}[hex_id + 1] as center from nodes)
select distinct cast(least(a.center, b.center) as integer) as a, cast(greatest(a.center, b.center) as integer) as b from k a join k b on bit_count(xor(a.hex_id, b.hex_id)) = 1 and a.center <> b.center""")
def q6_delaunay(spark, sf_dir):
    """Centers whose occupied cells touch."""
    cells = coded(spark, sf_dir).select("hex_id").distinct().select("hex_id", q6.cell(F.col("hex_id"), CENTERS).alias("center"))
    near = cells.select("center", F.explode(q6.neighbors(F.col("hex_id"))).alias("hex_id")).join(cells.withColumnRenamed("center", "other"), "hex_id").where("center <> other")
    return near.select(F.least("center", "other").alias("a"), F.greatest("center", "other").alias("b")).distinct()


@query(f"""with {SQL_NODES}, p as (select 1 as radius, unnest({list(q6.packing(1))!r}) as center union all select 2, unnest({list(q6.packing(2))!r}) union all select 3, unnest({list(q6.packing(3))!r}))
select cast(radius as integer) as radius, cast(center as integer) as center, count(id) as covered from p left join nodes on bit_count(xor(hex_id, cast(center as integer))) <= radius group by all""")
def q6_packing(spark, sf_dir):
    """Nodes within the ball of each greedy center: an equi-join on the ball's codes."""
    rows = [(r, c) for r in (1, 2, 3) for c in q6.packing(r)]
    centers = spark.createDataFrame(rows, "radius int, center int")
    balls = centers.select("radius", "center", F.explode(F.when(F.col("radius") == 1, q6.ball(F.col("center"), 1)).when(F.col("radius") == 2, q6.ball(F.col("center"), 2)).otherwise(q6.ball(F.col("center"), 3))).alias("hex_id"))
    found = coded(spark, sf_dir).groupBy("hex_id").agg(F.count("*").alias("k"))
    return balls.join(found, "hex_id", "left").groupBy("radius", "center").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("covered"))


@query(f"""with {SQL_NODES}, c as (select topic, hex_id from nodes group by all), b as (select topic, h from c, range(0, 64) r(h) where bit_count(xor(c.hex_id, cast(h as integer))) <= 1)
select topic, count(*) as covered, count(distinct h) as different, count(*) = 64 and count(distinct h) = 64 as perfect from b group by 1""")
def q6_perfect_code(spark, sf_dir):
    balls = coded(spark, sf_dir).select("topic", "hex_id").distinct().select("topic", F.explode(q6.ball(F.col("hex_id"), 1)).alias("h"))
    return balls.groupBy("topic").agg(F.count("*").alias("covered"), F.countDistinct("h").alias("different")).withColumn("perfect", (F.col("covered") == 64) & (F.col("different") == 64))


@query(f"with {SQL_NODES}, s as (select topic, first(hex_id order by id) as h from nodes group by 1) select topic, cast(bit_count(xor(hex_id, h)) as integer) as distance, count(*) as n from nodes join s using (topic) group by all")
def q6_spectrum(spark, sf_dir):
    n = coded(spark, sf_dir).select("id", "topic", "hex_id")
    first = n.groupBy("topic").agg(F.min_by("hex_id", "id").alias("h"))
    return n.join(first, "topic").groupBy("topic", q6.hamming(F.col("hex_id"), F.col("h")).alias("distance")).agg(F.count("*").alias("n"))


@query("with n as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), m as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from n) select id, round(l, 6) as norm, list_transform(v, lambda x: round(x / case when l = 0 then 1 else l end, 6)) as unit, list_concat(v, [0.0, 0, 0, 0, 0, 0])[1:6] as six from m")
def vec_normalize(spark, sf_dir):
    v = F.col("embedding")
    return nodes(spark, sf_dir).select("id", F.round(vectors.norm(v), 6).alias("norm"), F.transform(vectors.normalize(v), vectors.rounded).alias("unit"), vectors.padded(v).alias("six"))


@query("""with n as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), u as (select id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from n),
s as (select a.id, b.id as other, list_dot_product(a.v, b.v) as s from u a, u b where a.id % 100 = 0 and a.id <> b.id)
select id, other, cast(rank as integer) as rank, round(s, 5) as similarity from (select *, row_number() over (partition by id order by round(s, 5) desc, other) as rank from s) where rank <= 10""")
def vec_cosine_topk(spark, sf_dir):
    """The ten most similar of all vectors for every id divisible by 100. The query block is broadcast in parts of a
    fixed size, each corpus task keeps its own ten best per query, and only those meet."""
    from ..operators.nearest import cosine_topk

    unit = nodes(spark, sf_dir).select("id", vectors.normalize(F.col("embedding")).alias("v"))
    return cosine_topk(unit.where("id % 100 = 0"), unit, 10)


@query("with n as (select label as topic, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), e as (select topic, unnest(v) as x, unnest(range(0, len(v))) as i from n), a as (select topic, i, avg(x) as m from e group by all) select topic, list(round(m, 6) order by i) as center from a group by 1")
def vec_center_embedding(spark, sf_dir):
    e = nodes(spark, sf_dir).select("topic", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("topic", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("center"))


@query("""with t as (select item_id, text from benchmark), h as (select item_id, list_reduce(list_transform(string_split(text, ''), lambda c: cast(ord(c) as bigint)), lambda a, c: (a * 31 + c) & 4294967295, cast(0 as bigint)) as h0 from t),
g as (select item_id, list_reduce(range(1, 7), lambda a, i: list_append(a, (a[len(a)] * 1664525 + 1013904223) & 4294967295), [h0]) as s from h)
select item_id, list_transform(s[2:7], lambda x: round(x / 2147483647 - 1, 6)) as embedding from g""")
def embed_mock(spark, sf_dir):
    t = read(spark, sf_dir, "benchmark")
    return t.select("item_id", F.transform(vectors.mock(F.col("text")), lambda x: F.round(x, 6)).alias("embedding"))


K3 = vectors.Projections(3)
_TURN = "[" + ", ".join("[" + ", ".join(" + ".join(f"v[{j + 1}] * ({x!r})" for j, x in enumerate(row)) for row in m) + "]" for m in K3.matrices) + "]"
_CODE = "cast(list_sum([case when t[i + 1] > list_sum(t) / 6 then 1 << cast(i as integer) else 0 end for i in range(0, 6)]) as integer)"
SQL_LSH = f"{SQL_NODES}, lsh as (select id, hex_id, v, [{_CODE} for t in {_TURN}] as codes from nodes)"


@query(f"with {SQL_LSH} select id, codes from lsh")
def lsh_hash_all(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", K3.codes(F.col("embedding")).alias("codes"))


@query(f"with {SQL_LSH} select id, list_filter(range(0, 64), lambda h: len(list_filter(codes, lambda c: bit_count(xor(c, cast(h as integer))) <= 1)) > 0)::integer[] as ball, len(list_filter(codes, lambda c: bit_count(xor(c, hex_id)) <= 1)) / 3 as coverage from lsh")
def lsh_union_ball(spark, sf_dir):
    v = F.col("embedding")
    return coded(spark, sf_dir).select("id", K3.union_ball(v, 1).alias("ball"), K3.coverage(v, F.col("hex_id"), 1).alias("coverage"))


@query(f"with {SQL_LSH}, p as (select a.id, list_transform([1, 2, 3], lambda i: cast(bit_count(xor(a.codes[i], b.codes[i])) as integer)) as distances from lsh a join lsh b on b.id = a.id + 1) select id, distances, list_min(distances) as nearest, list_sum(distances) / 3 as mean from p")
def lsh_distances(spark, sf_dir):
    c = nodes(spark, sf_dir).select("id", K3.codes(F.col("embedding")).alias("a"))
    both = c.join(c.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id").select("id", F.zip_with("a", "b", q6.hamming).alias("distances"))
    return both.select("id", "distances", F.array_min("distances").alias("nearest"), (F.aggregate("distances", F.lit(0), lambda a, x: a + x) / F.lit(3.0)).alias("mean"))


_RECALL = f"""with {SQL_LSH}, q as (select id, v, codes from lsh where id % 100 = 0),
s as (select q.id, n.id as other, list_cosine_similarity(q.v, n.v) as s, len(list_filter([1, 2, 3], lambda i: bit_count(xor(q.codes[i], n.codes[i])) <= 1)) > 0 as near from q, lsh n),
t as (select * from (select *, row_number() over (partition by id order by round(s, 5) desc, other) as r from s) where r <= 10)
select id, cast(sum(case when near then 1 else 0 end) as bigint) as found, count(*) as wanted from t group by 1"""


@query(_RECALL)
def lsh_recall(spark, sf_dir):
    """How many of the ten nearest vectors share a code within one bit, in some projection, by query vector."""
    from ..operators.nearest import cosine_topk

    c = nodes(spark, sf_dir).select("id", "embedding", K3.codes(F.col("embedding")).alias("codes"))
    unit = c.select("id", vectors.normalize(F.col("embedding")).alias("v"))
    top = cosine_topk(unit.where("id % 100 = 0"), unit, 10, with_self=True).select("id", "other")
    codes = c.select("id", "codes")
    both = top.join(codes, "id").join(codes.select(F.col("id").alias("other"), F.col("codes").alias("theirs")), "other")
    near = F.exists(F.zip_with("codes", "theirs", q6.hamming), lambda d: d <= 1)
    return both.groupBy("id").agg(F.sum(near.cast("int")).alias("found"), F.count("*").alias("wanted"))


SWEEP = (1, 2, 3, 5)
_K5 = vectors.Projections(max(SWEEP))
_TURN5 = "[" + ", ".join("[" + ", ".join(" + ".join(f"v[{j + 1}] * ({x!r})" for j, x in enumerate(row)) for row in m) + "]" for m in _K5.matrices) + "]"


@query(f"""with {SQL_NODES}, lsh as (select id, hex_id, v, [{_CODE} for t in {_TURN5}] as codes from nodes), q as (select * from lsh where id % 100 = 0),
s as (select q.id, n.id as other, n.hex_id, list_cosine_similarity(q.v, n.v) as s from q, lsh n where q.id <> n.id),
t as (select * from (select *, row_number() over (partition by id order by round(s, 5) desc, other) as r from s) where r <= 10),
b as (select k, id, list_filter(range(0, 64), lambda h: len(list_filter(codes[1:k], lambda c: bit_count(xor(c, cast(h as integer))) <= 1)) > 0) as ball from q, (select unnest({list(SWEEP)}) as k))
select cast(b.k as integer) as k, round(avg(case when list_contains(ball, t.hex_id) then 1.0 else 0 end), 6) as recall, round(sum(len(ball)) / count(*), 6) as ball_size, round(100 * sum(len(ball)) / count(*) / 64, 6) as coverage from b join t on t.id = b.id group by b.k""")
def lsh_recall_sweep(spark, sf_dir):
    """For one, two, three and five projections: how many of the ten nearest vectors have a code in the union of a query's
    balls of radius one, how many codes these hold, and that as a share of all codes in percent."""
    from ..operators.nearest import cosine_topk

    c = coded(spark, sf_dir).select("id", "hex_id", "embedding")
    unit = c.select("id", vectors.normalize(F.col("embedding")).alias("v"))
    top = cosine_topk(unit.where("id % 100 = 0"), unit, 10).select("id", "other").join(c.select(F.col("id").alias("other"), "hex_id"), "other")
    balls = F.array(*[F.struct(F.lit(k).alias("k"), vectors.Projections(k).union_ball(F.col("embedding"), 1).alias("ball")) for k in SWEEP])
    each = c.where("id % 100 = 0").select("id", F.explode(balls).alias("b")).join(top, "id")
    size = F.avg(F.size("b.ball"))
    found = each.groupBy("b.k").agg(F.avg(F.array_contains("b.ball", F.col("hex_id")).cast("double")).alias("recall"), size.alias("size"))
    return found.select("k", F.round("recall", 6).alias("recall"), F.round("size", 6).alias("ball_size"), F.round(F.col("size") * 100 / 64, 6).alias("coverage"))
