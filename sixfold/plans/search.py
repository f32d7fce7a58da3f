"""Queries of retrieval. The query set is every node whose id is divisible by 100."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.vectors import Projections
from ..operators import borders as b
from ..operators import graph as g
from ..operators import rag
from ..operators import search as s
from ..operators.code_index import asked, build_index, candidates
from ..operators.text import archetype_scores, expanded
from ..sources.tables import edges, read
from .borders import SQL_CURVES, SQL_IFS, communities, curves
from .cube import _CODE, _TURN, SQL_LSH, SQL_NODES, coded
from .graph import _DOMINANT, _EGO, _HYPER, _MEANS, SQL_GRAPH, members
from .registry import query
from .text import SQL_TREE, WORDS


def seeds(spark, sf_dir):
    return coded(spark, sf_dir).where("id % 100 = 0")


_STEPS = f"""{SQL_GRAPH}, st as (select distinct source as id, target as t from edges union select target, source from edges where not directed),
r0 as (select id as seed, id from nodes where id % 100 = 0), r1 as (select distinct seed, t as id from r0 join st using (id) where t <> seed),
r2 as (select distinct r1.seed, t as id from r1 join st using (id) where t <> r1.seed and not exists (select 1 from r1 x where x.seed = r1.seed and x.id = t)),
rr as (select seed, id, 1 as level from r1 union all select seed, id, 2 from r2),
rk as (select rr.*, cast(bit_count(xor(a.hex_id, b.hex_id)) as integer) as distance from rr join nodes a on a.id = rr.id join nodes b on b.id = seed)"""


@query(f"with {_STEPS} select seed, cast(rank as integer) as rank, id, level, distance from (select *, row_number() over (partition by seed order by distance, id) as rank from rk) where rank <= 10")
def local_search_bfs(spark, sf_dir):
    return s.local(seeds(spark, sf_dir), coded(spark, sf_dir), edges(spark, sf_dir))


@query(f"with {SQL_GRAPH} select n.id as seed, count(weight) as n_edges, round(coalesce(avg(weight), 0), 6) as score from nodes n left join edges on source = n.id or target = n.id where n.id % 100 = 0 group by 1")
def local_search_score(spark, sf_dir):
    return s.local_score(seeds(spark, sf_dir), edges(spark, sf_dir)).select("seed", "n_edges", F.round("score", 6).alias("score"))


@query(f"with {SQL_GRAPH}, {_MEANS} select a.community, b.community as other, cast(bit_count(xor(a.hex_id, b.hex_id)) as integer) as distance from ch a join ch b on a.community <> b.community and bit_count(xor(a.hex_id, b.hex_id)) <= 2")
def radial_search(spark, sf_dir):
    return s.radial(communities(spark, sf_dir), 2)


@query(f"with {SQL_GRAPH}, {_MEANS} select a.community, min(b.community) as opposite from ch a left join ch b on b.hex_id = xor(a.hex_id, 63) group by 1")
def antipodal_community(spark, sf_dir):
    return s.antipodal(communities(spark, sf_dir))


@query(f"""with {SQL_GRAPH}, {_MEANS}, nn as (select a.community as a, a.hex_id as ha, arg_min(b.community, cast(bit_count(xor(a.hex_id, b.hex_id)) as integer) * 1000 + b.community) as b from ch a join ch b on a.community <> b.community group by all),
ls as (select hex_id as h, max(community) as c from ch group by 1)
select a, b, list(c order by h) as way from nn join ch on ch.community = b join ls on bit_count(xor(h, ha)) + bit_count(xor(h, ch.hex_id)) = bit_count(xor(ha, ch.hex_id)) group by a, b""")
def path_between(spark, sf_dir):
    return s.between(g.cut(communities(spark, sf_dir)))


@query(f"with {SQL_NODES}, p as (select a.id as seed, b.id, row_number() over (partition by a.id order by b.id) as rank from nodes a join nodes b on bit_count(xor(a.hex_id, b.hex_id)) = 1 where a.id % 100 = 0) select seed, cast(rank as integer) as rank, id from p where rank <= 6")
def semantic_neighbors(spark, sf_dir):
    return s.semantic_neighbors(seeds(spark, sf_dir), coded(spark, sf_dir))


@query(f"with recursive {SQL_GRAPH}, {_HYPER} select node, n from hyper where n between 3 and 8")
def cluster_by_size(spark, sf_dir):
    """Hyper-edges of three to eight nodes."""
    return g.hyper_edges(edges(spark, sf_dir)).select("node", F.size("members").alias("n")).where("n between 3 and 8")


@query(f"with {SQL_GRAPH}, k as (select community, count(*) as n from member join nodes on id = node_id where archetype = 'MSCF' group by 1) select * from k")
def cluster_by_archetype(spark, sf_dir):
    """Communities that hold any node of one archetype, and how many."""
    n = coded(spark, sf_dir).where("archetype = 'MSCF'").select(F.col("id").alias("node_id"))
    return members(spark, sf_dir).join(n, "node_id").groupBy("community").agg(F.count("*").alias("n"))


_STAGE = f"""{SQL_CURVES}, {_DOMINANT}, q as (select id as query, v, hex_id as qh, [{_CODE} for t in {_TURN}] as codes from nodes where id % 100 = 0),
cd as (select query, community, len(list_filter(codes, lambda c: bit_count(xor(c, ch.hex_id)) <= 2)) as near, bit_count(xor(qh, ch.hex_id)) as hd, q.v[1:6] as s, [cast((ch.hex_id >> i) & 1 as double) for i in range(0, 6)] as b from q, ch),
nb as (select a, b from tp union select b, a from tp),
cc as (select cd.*, case when near > 0 then near / 3.0 else 0.1 end as cover from cd where near > 0 or exists (select 1 from cd x join nb on nb.a = x.community where x.query = cd.query and x.near > 0 and nb.b = cd.community)),
cs as (select query, 0 as kind, cast(community as bigint) as item, round(0.6 * least(1, (list_dot_product(s, b) / (sqrt(list_dot_product(s, s)) * case when list_sum(b) = 0 then 1 else sqrt(list_sum(b)) end) + 1) / 2) + 0.4 * ((1 - hd / 7.0) * 0.7 + cover * 0.3), 6) as score from cc),
ns as (select query, 1 as kind, id as item, round((list_cosine_similarity(q.v, n.v) + 1) / 2, 6) as score from q, nodes n where len(list_filter(codes, lambda c: bit_count(xor(c, n.hex_id)) <= 2)) > 0),
s1 as (select * from cs union all select * from ns)"""


def _queries(spark, sf_dir):
    return seeds(spark, sf_dir).select(F.col("id").alias("query"), F.col("embedding").alias("v"))


@query(f"with {_STAGE} select query, kind, count(*) as n from s1 group by all")
def ann_stage1(spark, sf_dir):
    """How many nodes (1) and communities (0) the first stage finds for each query."""
    q = asked(_queries(spark, sf_dir), Projections(3), 2)
    c = g.cut(communities(spark, sf_dir))
    found = s.community_candidates(q, c, 2, b.touching(c)).groupBy("query").agg(F.count("*").alias("n")).select("query", F.lit(0).alias("kind"), "n")
    return found.unionByName(s.stage1_counts(q, coded(spark, sf_dir)).select("query", F.lit(1).alias("kind"), "n"))


@query(f"""with {_STAGE}, {_EGO}, tt as (select query, kind, item, score from (select *, row_number() over (partition by query order by score desc, kind, item) as r from s1) where r <= 20),
me as (select node, n, unnest(members) as item from ego), hs as (select query, 2 as kind, node as item, round(sum(score) / n * (0.7 + 0.3 * count(*) / n), 6) as score from tt join me using (item) where kind = 1 group by query, node, n),
al as (select * from tt union all select * from hs)
select query, cast(rank as integer) as rank, kind, item, score from (select *, row_number() over (partition by query order by score desc, kind, item) as rank from al) where rank <= 10""")
def ann_search(spark, sf_dir):
    c = g.cut(communities(spark, sf_dir))
    return s.ann(_queries(spark, sf_dir), coded(spark, sf_dir), c, g.ego_clusters(edges(spark, sf_dir)), b.touching(c))


@query(f"""with {SQL_LSH}, q as (select id, v, codes from lsh where id % 100 = 0),
s as (select q.id as query, n.id, round((list_cosine_similarity(q.v, n.v) + 1) / 2, 6) as score from q, lsh n where len(list_filter([1, 2, 3], lambda i: bit_count(xor(q.codes[i], n.codes[i])) <= 1)) > 0)
select query, cast(rank as integer) as rank, id, score from (select *, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10""")
def ann_nodes_sound(spark, sf_dir):
    """The ten best of the nodes whose code lies within one bit of the query's in some projection, both turned alike."""
    n, lsh = coded(spark, sf_dir), Projections(3)
    found = candidates(build_index(n, lsh, sound=True), asked(_queries(spark, sf_dir), lsh, 1), 1, 10)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.select("query", "rank", "id", "score")


@query(f"""with {_STAGE} select query, cast(rank as integer) as rank, item as id, score from (select *, row_number() over (partition by query order by score desc, item) as rank from ns) where rank <= 10""")
def ann_nodes(spark, sf_dir):
    """The ten best of the nodes whose stored code lies in the union of the query's balls."""
    n, lsh = coded(spark, sf_dir), Projections(3)
    found = candidates(build_index(n, lsh), asked(_queries(spark, sf_dir), lsh, 2), 2, 10)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.select("query", "rank", "id", "score")


#: Words of the tables' own languages, so that some questions name a domain.
_BOOST_WORDS = {"technology": ["tion"], "science": ["ing"], "biology": ["the "]}
_BOOST = "case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then case when list_contains({s.BOOST_ARCHETYPES[d] + ['MSCF', 'ASEO']!r}, dominant_archetype) then 0.15 else 0 end" for d, ws in _BOOST_WORDS.items()) + " else 0 end"


@query(f"with {SQL_GRAPH}, {_DOMINANT} select item_id, community, cast({_BOOST} as double) as boost from benchmark, dom")
def archetype_boost(spark, sf_dir):
    """What a question's domain adds to every community, by its dominant archetype; communities are 64 at most."""
    names = {d: [*a, "MSCF", "ASEO"] for d, a in s.BOOST_ARCHETYPES.items()}
    c = g.cut(g.dominant(members(spark, sf_dir), coded(spark, sf_dir))).agg(F.collect_list(F.struct("community", "dominant_archetype")).alias("of"))
    q = read(spark, sf_dir, "benchmark").select("item_id", "text", F.lit(1).alias("k")).join(F.broadcast(c.withColumn("k", F.lit(1))), "k")
    each = q.select("item_id", "text", F.explode("of").alias("c"))
    return each.select("item_id", "c.community", s.boost(F.col("text"), F.col("c.dominant_archetype"), _BOOST_WORDS, names).alias("boost"))


_TEXTS = ["новый алгоритм", "теория и закон", "город", "nothing"]
_TEXT = f"{_TEXTS!r}[query // 100 % {len(_TEXTS)} + 1]"
_OWN_BOOST = "case " + " ".join("when " + " or ".join(f"contains(text, '{w}')" for w in ws) + f" then case when list_contains({s.BOOST_ARCHETYPES[d]!r}, dominant_archetype) then 0.15 else 0 end" for d, ws in s.BOOST_WORDS.items()) + " else 0 end"
_RERANKED = _STAGE[len(SQL_CURVES) :].replace("from nodes where id % 100 = 0)", "from nodes where id % 100 = 0), qt as (select *, " + _TEXT + " as text from q)", 1)
_RERANKED = _RERANKED.replace("from q, ch)", f", cast({_OWN_BOOST} as double) as boost from qt q, ch join dom using (community))").replace(" + 1) / 2) + 0.4", " + 1) / 2 + boost) + 0.4")


@query(f"""with recursive {SQL_IFS}{_RERANKED}, {re.sub(r"\bcl\b", "cl_h", _HYPER)},
ci as (select community, arg_min(ifs, a * 1000 + b) as ifs from ch join fs on community = a or community = b group by 1), qi as (select query, ifs from q join member on node_id = query join ci using (community)),
t0 as (select query, kind, item, score from (select *, row_number() over (partition by query order by score desc, kind, item) as r from s1) where r <= 20),
tt as (select query, kind, item, case when kind = 0 and ci.ifs is not null and qi.ifs is not null then round(0.7 * score + 0.3 / (1 + 2 * sqrt(list_sum(list_transform(range(1, 9), lambda i: (ci.ifs[i] - qi.ifs[i]) ** 2)))), 6) else score end as score from t0 left join qi using (query) left join ci on kind = 0 and community = item),
me as (select node, n, unnest(members) as item from hyper), hs as (select query, 2 as kind, node as item, round(sum(score) / n * (0.7 + 0.3 * count(*) / n), 6) as score from tt join me using (item) where kind = 1 group by query, node, n),
al as (select * from tt union all select * from hs)
select query, cast(rank as integer) as rank, kind, item, score from (select *, row_number() over (partition by query order by score desc, kind, item) as rank from al) where rank <= 10""")
def ann_search_reranked(spark, sf_dir):
    """The whole search: communities gain by a text's domain, are scored again by their first border's coefficients against
    those of the query's community, and kept hyper-edges are found beside nodes."""
    m, n = members(spark, sf_dir), coded(spark, sf_dir)
    c = g.cut(communities(spark, sf_dir).join(g.dominant(m, n), "community"))
    fractal = g.cut(curves(spark, sf_dir).select("a", "b", geometry.ifs(F.col("curve")).alias("ifs")))
    first = fractal.select(F.explode(F.array("a", "b")).alias("community"), "a", "b", "ifs").groupBy("community").agg(F.min_by("ifs", F.struct("a", "b")).alias("ifs"))
    c = g.cut(c.join(first, "community", "left"))
    text = F.get(F.array(*map(F.lit, _TEXTS)), (F.floor(F.col("query") / 100) % len(_TEXTS)).cast("int"))
    own = m.select(F.col("node_id").alias("query"), "community").join(c.select("community", "ifs"), "community").select("query", "ifs")
    q = _queries(spark, sf_dir).join(own, "query", "left").withColumn("text", text)
    hyper = g.cut(g.hyper_edges(edges(spark, sf_dir)).select("node", "members", F.size("members").alias("n")))
    return s.ann(q, n, c, hyper, b.touching(c))


_ANSWER = f"""{SQL_CURVES}{_RERANKED}, {re.sub(r"\bcl\b", "cl_h", _HYPER)},
tt as (select query, kind, item, score from (select *, row_number() over (partition by query order by score desc, kind, item) as r from s1) where r <= 20),
me as (select node, n, unnest(members) as item from hyper), hs as (select query, 2 as kind, node as item, round(sum(score) / n * (0.7 + 0.3 * count(*) / n), 6) as score from tt join me using (item) where kind = 1 group by query, node, n),
fin as (select * from (select *, row_number() over (partition by query order by score desc, kind, item) as rank from (select * from tt union all select * from hs)) where rank <= 10),
nd as (select * from (select query, item as id, row_number() over (partition by query order by rank) as r from fin where kind = 1) where r <= 5),
na as (select query, list('v' || nd.id order by r) as labels, list_sort(list_distinct(list(archetype))) as archetypes from nd join nodes on nodes.id = nd.id group by 1),
re8 as (select *, row_number() over (partition by query order by source, target) as k from (select distinct query, source, target from nd join edges on source = id or target = id)),
nr as (select query, string_agg('v' || source || ' -> v' || target, '; ' order by k) as relations from re8 where k <= 8 group by 1),
kk as (select community, avg(weight) as mean, avg(case when directed then 1.0 else 0 end) as ways, count(*) as n, max(weight) as high from intra group by 1),
kr as (select ch.community, hex_id, case when n is null then [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5] else [least(1, mean), ways, 0.5, least(1, mean), least(1, n / 20.0), least(1, high), 0.7] end as l from ch left join kk on kk.community = ch.community),
fc0 as (select query, cast(arg_min(item, rank) as integer) as community from fin where kind = 0 group by 1),
fc1 as (select query, community, hex_id, list_aggregate(list_transform(range(0, 6), lambda i: cast((hex_id >> i) & 1 as varchar)), 'string_agg', '') as bits, case when hex_id & 1 = 1 then 'tower' else 'fractal' end as skeleton, {g.RAYS!r}[list_position(l, list_max(l))] as ray from fc0 join kr using (community)),
bt as (select query as item_id, text from qt), {SQL_TREE.replace("from benchmark", "from bt")},
qu as (select query, list(id order by id) as questions from (select item_id as query, id, row_number() over (partition by item_id order by id) as r from tree where priority >= 4) where r <= 5 group by 1)"""


@query(f"with recursive {_ANSWER} select query, labels, case when labels is not null then coalesce(relations, 'none') end as relations, archetypes, community, hex_id, bits, skeleton, ray, questions from (select distinct query from fin) left join na using (query) left join nr using (query) left join fc1 using (query) left join qu using (query)")
def rag_local_search(spark, sf_dir):
    """What local answers are made from: nodes and community of an approximate search, and questions of a high priority."""
    m, n, e = members(spark, sf_dir), g.cut(coded(spark, sf_dir)), g.cut(edges(spark, sf_dir))
    rays = g.community_rays(m, g.intra_edges(e, m)).select("community", F.array(*g.RAYS).alias("rays"))
    c = g.cut(communities(spark, sf_dir).join(g.dominant(m, n), "community").join(rays, "community"))
    text = F.get(F.array(*map(F.lit, _TEXTS)), (F.floor(F.col("query") / 100) % len(_TEXTS)).cast("int"))
    q = g.cut(_queries(spark, sf_dir).withColumn("text", text))
    hyper = g.cut(g.hyper_edges(e).select("node", "members", F.size("members").alias("n")))
    found = g.cut(s.ann(q, n, c, hyper, b.touching(c)))
    questions = expanded(archetype_scores(q.select("query", "text"), words=WORDS), "query").select("query", "id", "priority")
    return rag.local_answers(found, n, e, c, questions)


_FACADE_STEPS = _STEPS[len(SQL_GRAPH) :].replace("where id % 100 = 0", "where id in (select item_id * 7 from benchmark)").replace("rk as (", "rks as (")


@query(f"""with recursive {SQL_GRAPH}{_FACADE_STEPS}, {_HYPER}, bq as (select item_id, 'V' || (item_id * 7) as text from benchmark), {SQL_TREE.replace("from benchmark", "from bq")}, hm as (select node, unnest(members) as m from hyper),
lo as (select seed, id, row_number() over (partition by seed order by distance, id) as rank from rks), co as (select community, row_number() over (order by community) as rank from (select distinct community from member)),
hy as (select item_id, node, row_number() over (partition by item_id order by node) as rank from (select distinct item_id, hm.node from bq join nodes n on contains(lower(n.label), lower(text)) join hm on hm.m = n.id))
select item_id as query, 'question' as part, cast(r as integer) as rank, id as item from tree union all select item_id, 'local', cast(rank as integer), cast(id as varchar) from lo join benchmark on item_id * 7 = seed where rank <= 10
union all select item_id, 'community', cast(rank as integer), cast(community as varchar) from co, benchmark where rank <= 10 union all select item_id, 'hyper_edge', cast(rank as integer), cast(node as varchar) from hy where rank <= 10""")
def query_facade(spark, sf_dir):
    """What each text brings together: its questions, the nodes around one, communities, and hyper-edges that hold it."""
    texts = g.cut(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("V"), (F.col("item_id") * 7).cast("string")).alias("text"), (F.col("item_id") * 7).alias("node")))
    questions = expanded(archetype_scores(texts.select("query", "text"), words=WORDS), "query").select("query", "id")
    return s.facade(texts, g.cut(coded(spark, sf_dir)), g.cut(edges(spark, sf_dir)), g.hyper_edges(edges(spark, sf_dir)), members(spark, sf_dir), questions)


@query(f"with {SQL_GRAPH}, {_MEANS}, u as (select hex_id, 0 as p from ch union all select hex_id, 1 from nodes) select hex_id, case when min(p) = 0 then 'community' else 'node' end as kind, cast(sum(p) as bigint) as n_nodes from u group by 1")
def q6_occupied(spark, sf_dir):
    """The occupied codes, how many nodes have each, and whether a community, which goes first, stands there."""
    both = communities(spark, sf_dir).select("hex_id", F.lit(0).alias("p")).unionByName(coded(spark, sf_dir).select("hex_id", F.lit(1).alias("p")))
    return both.groupBy("hex_id").agg(F.when(F.min("p") == 0, "community").otherwise("node").alias("kind"), F.sum("p").alias("n_nodes"))
