"""Further queries: projections, vocabularies, comparisons, clusters' rays and node signatures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph as g
from ..operators import build, search, vocabulary
from ..sources.tables import edges, nodes, read
from .cube import SQL_NODES, coded
from .graph import _EGO, SQL_GRAPH
from .registry import query


_BUCKET = "case when c >= 0.85 then 'identical' when c >= 0.65 then 'close' when c >= 0.40 then 'related' when c >= 0.10 then 'weak' else 'far' end"


@query(f"with {SQL_NODES}, p as (select a.id, b.id as other, round(list_cosine_similarity(a.v, b.v), 6) as c from nodes a join nodes b on b.id = a.id + 1) select id, other, c as cosine, {_BUCKET} as bucket from p")
def compare_embeddings(spark, sf_dir):
    """The cosine of each vector and the next one, from -1 to 1, in five buckets."""
    n = nodes(spark, sf_dir).select("id", "embedding")
    both = n.join(n.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("embedding").alias("b")), "id")
    cosine = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.cosine(F.col("embedding"), F.col("b")))), 6)
    c = F.col("cosine")
    bucket = F.when(c >= 0.85, "identical").when(c >= 0.65, "close").when(c >= 0.40, "related").when(c >= 0.10, "weak").otherwise("far")
    return both.select("id", "other", cosine.alias("cosine")).withColumn("bucket", bucket)


_CLAMPED = "round(coalesce(greatest(0, least(1, {0})), 0.5), 6) as {1}"
_RAYS = ", ".join(_CLAMPED.format(x, r) for x, r in (("mean", "strength"), ("oneway", "direction"), ("spread", "temporal"), ("1 - (high - low)", "confidence"), ("n_edges / 10", "scale"), ("high", "context"), ("mean * (1 - spread)", "source")))


@query(f"""with {SQL_GRAPH}, {_EGO}, mm as (select node, unnest(members) as m from ego),
he as (select a.node, e.weight, case when r.weight is null or abs(r.weight - e.weight) > 0.1 then 1.0 else 0 end as way from mm a join edges e on e.source = a.m join mm b on b.node = a.node and b.m = e.target left join edges r on r.source = e.target and r.target = e.source),
st as (select node, count(*) as n_edges, avg(weight) as mean, avg(way) as oneway, var_pop(weight) as spread, max(weight) as high, min(weight) as low from he group by 1)
select node, coalesce(n_edges, 0) as n_edges, {_RAYS} from ego left join st using (node)""")
def cluster_heptagram(spark, sf_dir):
    """Rays of every ego cluster from the weights of its inner edges."""
    clusters = g.cut(g.ego_clusters(edges(spark, sf_dir)))
    return build.cluster_rays(clusters, edges(spark, sf_dir)).select("node", "n_edges", *[F.round(r, 6).alias(r) for r in g.RAYS])


_TOK = "regexp_extract_all(lower(text), '[а-яёa-z0-9]+')"
_VOCAB = f"""tk as (select unnest({_TOK}) as phrase from benchmark), vc as (select phrase, count(*) as k from tk group by 1 order by k desc, phrase limit 50),
hh as (select phrase, list_reduce(list_transform(string_split(phrase, ''), lambda c: cast(ord(c) as bigint)), lambda a, c: (a * 31 + c) & 4294967295, cast(0 as bigint)) as h0 from vc),
gg as (select phrase, list_transform(list_reduce(range(1, 7), lambda a, i: list_append(a, (a[len(a)] * 1664525 + 1013904223) & 4294967295), [h0])[2:7], lambda x: x / 2147483647 - 1) as e from hh),
vv as (select phrase, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as v from gg)"""


@query(f"""with {_VOCAB}, ii as (select item_id, {_TOK} as w from benchmark), ps as (select item_id, w, unnest(range(1, len(w) + 1)) as i from ii),
tr as (select item_id, i, s, array_to_string(w[i:i + s - 1], ' ') as phrase from ps, (select unnest([3, 2, 1]) as s)),
bs as (select item_id, i, max(s) as s, arg_max(v, s) as v from tr join vv using (phrase) group by all),
ex as (select item_id, s, unnest(v) as x, unnest(range(0, 6)) as k from bs), mm as (select item_id, k, sum(x * s) / sum(s) as m, count(*) as hits from ex group by all),
ag as (select item_id, max(hits) as hits, list(m order by k) as v from mm group by 1)
select b.item_id, coalesce(hits, 0) as hits, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) as v from benchmark b left join ag using (item_id)""")
def embed_vocabulary(spark, sf_dir):
    """Items embedded by the fifty most frequent words, whose vectors are their mock embeddings."""
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    words = items.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(vocabulary.TOKEN), F.lit(0))).alias("phrase")).groupBy("phrase").count()
    top = words.orderBy(F.desc("count"), "phrase").limit(50).select("phrase", vectors.normalize(vectors.mock(F.col("phrase"))).alias("v"))
    e = vocabulary.embed(items, "item_id", g.cut(top))
    return e.select("item_id", "hits", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


#: A vocabulary of the words, and of each two words in a row, of the items with an even id, in the order of phrases.
_EVEN = f"""ev as (select {_TOK} as w from benchmark where item_id % 2 = 0), vc as (select distinct unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as phrase from ev),
hh as (select phrase, list_reduce(list_transform(string_split(phrase, ''), lambda c: cast(ord(c) as bigint)), lambda a, c: (a * 31 + c) & 4294967295, cast(0 as bigint)) as h0 from vc),
gg as (select phrase, list_transform(list_reduce(range(1, 7), lambda a, i: list_append(a, (a[len(a)] * 1664525 + 1013904223) & 4294967295), [h0])[2:7], lambda x: x / 2147483647 - 1) as e from hh),
vo as (select phrase, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as v, row_number() over (order by phrase) as ord from gg)"""


def _embed_sql(table: str, key: str) -> str:
    return f"""with {_EVEN}, ii as (select {key} as k, text, {_TOK} as w from {table}), ps as (select k, w, unnest(range(1, len(w) + 1)) as i from ii),
tr as (select k, i, s, array_to_string(w[i:i + s - 1], ' ') as phrase from ps, (select unnest([3, 2, 1]) as s)),
b1 as (select k, i, max(s)::double as s, arg_max(v, s) as v from tr join vo using (phrase) group by all),
ms as (select k, i, w[i] as token from ps where not exists (select 1 from b1 where b1.k = ps.k and b1.i = ps.i)), mt as (select distinct token from ms),
pt as (select token, arg_min(v, ord) as v from mt join vo on contains(phrase, token) or contains(token, phrase) group by token),
bs as (select * from b1 union all select k, i, 0.6::double as s, v from ms join pt using (token)),
ex as (select k, s, unnest(v) as x, unnest(range(0, 6)) as d from bs), mm as (select k, d, sum(x * s) / sum(s) as m, count(*) as hits from ex group by all),
ag as (select k, max(hits) as hits, list(m order by d) as v from mm group by 1),
sd as (select k, (coalesce(list_sum(list_transform(string_split(lower(text), ''), lambda c: cast(ord(c) as bigint))), 0)::bigint * 2654435761) & 4294967295 as h0 from ii),
ow as (select k, list_transform(list_reduce(range(1, 7), lambda a, i: list_append(a, (a[len(a)] * 1664525 + 1013904223) & 4294967295), [h0])[2:7], lambda x: x / 2147483647 - 1) as o from sd)
select ii.k as {key}, coalesce(hits, 0) as hits, list_transform(coalesce(v, o), lambda x: round(x / sqrt(list_sum(list_transform(coalesce(v, o), lambda y: y * y))), 6)) as v from ii left join ag using (k) left join ow using (k)"""


def phrases_of_items(spark, sf_dir):
    """phrase, ord, v: what _EVEN says, each with its mock embedding; phrases are numbered inside ranges of their hash."""
    w = vocabulary.tokens(F.col("text"))
    both = F.concat(w, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    each = g.cut(read(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.explode(both).alias("phrase")).distinct())
    ranked = each.withColumn("head", F.substring("phrase", 1, 1)).withColumn("own", F.row_number().over(W.partitionBy("head").orderBy("phrase")))
    before = each.groupBy(F.substring("phrase", 1, 1).alias("head")).agg(F.count("*").alias("k"))
    before = before.select("head", F.coalesce(F.sum("k").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(before), "head").select("phrase", (F.col("own") + F.col("before")).alias("ord"), vectors.normalize(vectors.mock(F.col("phrase"))).alias("v"))


@query(_embed_sql("benchmark", "item_id"))
def embed_partly(spark, sf_dir):
    """All items by the phrases of every second one, parts of words counted too."""
    e = vocabulary.embed(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", phrases_of_items(spark, sf_dir), partly=True)
    return e.select("item_id", "hits", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(_embed_sql("documents", "doc_id"))
def embed_documents(spark, sf_dir):
    """Whole documents by the phrases of the items, parts of words counted too, and by their characters where none is found."""
    e = vocabulary.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", phrases_of_items(spark, sf_dir), partly=True)
    return e.select("doc_id", "hits", F.transform("v", vectors.rounded).alias("v"))


@query(f"with {SQL_NODES} select id, list_concat([cast((hex_id >> i) & 1 as double) for i in range(0, 6)], list_transform(v, lambda x: round(x, 6))) as signature, 1 - (hex_id & 1) as south from nodes")
def node_signature(spark, sf_dir):
    n = coded(spark, sf_dir)
    bits = F.array(*[F.shiftright("hex_id", i).bitwiseAND(1).cast("double") for i in range(6)])
    return n.select("id", F.concat(bits, F.transform("embedding", vectors.rounded)).alias("signature"), (1 - F.col("hex_id").bitwiseAND(1)).alias("south"))


@query(f"with {SQL_GRAPH} select b.item_id, n.id, n.label from benchmark b join nodes n on contains(lower(n.label), lower('v' || (b.item_id * 7)))")
def label_search(spark, sf_dir):
    """Nodes whose label holds a query's text."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("V"), (F.col("item_id") * 7).cast("string")).alias("text"))
    return search.label_matches(q, nodes(spark, sf_dir)).select(F.col("query").alias("item_id"), "id", "label")


@query(f"with {SQL_GRAPH}, f as (select b.item_id, min(n.id) as id from benchmark b join nodes n on contains(lower(n.label), lower('v' || (b.item_id * 7))) group by 1) select item_id, list_transform(coalesce(n.v[1:6], [0.0, 0, 0, 0, 0, 0]), lambda x: round(x, 6)) as v from benchmark left join f using (item_id) left join nodes n on n.id = f.id")
def search_by_label(spark, sf_dir):
    """The vector that a search for a label starts from: the first six numbers of the first node that it finds."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("V"), (F.col("item_id") * 7).cast("string")).alias("text"))
    v = search.by_label(q, nodes(spark, sf_dir))
    return v.select(F.col("query").alias("item_id"), F.transform(F.slice("v", 1, 6), lambda x: F.round(x, 6)).alias("v"))
