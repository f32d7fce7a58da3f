"""Queries of retrieval contexts. The questions are the nodes whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph as g
from ..operators import rag
from ..operators.nearest import cosine_topk
from ..sources.tables import edges
from .build import _NAMES, _SHAPE, _VECTOR, _signatures
from .cube import coded
from .graph import _DOMINANT, members
from .registry import query

_SQL = f"""{_VECTOR}, {_DOMINANT},
nn as (select community, label, row_number() over (partition by community order by id) as r from member join nodes on id = node_id),
ll as (select community, string_agg(label, ', ' order by r) filter (r <= 5) as five, list(label order by r) filter (r <= 3) as three from nn group by 1),
ry as (select community, v[10:16] as l, v[1] as north from sv),
gl as (select community, '[' || {_NAMES} || '/' || dominant_archetype || '] Q6=' || hex_id || ' skel=' || case when north = 1 then 'tower' else 'fract' end || ' dom=' || ['strength', 'direction', 'temporal', 'confidence', 'scale', 'context', 'source'][list_position(l, list_max(l))] || ': ' || five || case when n_nodes > 5 then ' +' || (n_nodes - 5) else '' end as line, three as sources
 from dom join ll using (community) join sv using (community) join ry using (community) join sh using (community)),
tk as (select q.id as query, n.id, row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, n.v), 5) desc, n.id) as r from nodes q, nodes n where q.id % 100 = 0 and q.id <> n.id),
t5 as (select * from tk where r <= 5), re as (select distinct query, source, target from t5 join edges on source = t5.id or target = t5.id),
r8 as (select *, row_number() over (partition by query order by source, target) as k from re), rs as (select query, string_agg('v' || source || ' -> v' || target, '; ' order by k) as relations from r8 where k <= 8 group by 1),
lc as (select query, list('v' || id order by r) as labels, coalesce(any_value(relations), 'none') as relations from t5 left join rs using (query) group by 1)"""


@query(f"with recursive {_SQL} select * from gl")
def rag_global_context(spark, sf_dir):
    """One line per community and the labels that it cites."""
    return rag.community_lines(_signatures(spark, sf_dir), coded(spark, sf_dir), members(spark, sf_dir))


def _local(spark, sf_dir):
    unit = coded(spark, sf_dir).select("id", vectors.normalize(F.col("embedding")).alias("v"))
    top = g.cut(cosine_topk(unit.where("id % 100 = 0"), unit, 5)).select(F.col("id").alias("query"), F.col("other").alias("id"), "rank")
    return rag.local_contexts(top, coded(spark, sf_dir), edges(spark, sf_dir))


@query(f"with recursive {_SQL} select * from lc")
def rag_local_context(spark, sf_dir):
    """The five nearest nodes of every question and the first eight edges that touch them."""
    return _local(spark, sf_dir)


@query(f"""with recursive {_SQL}, wd as (select string_agg('  ' || line, chr(10) order by community) as wide, flatten(list(sources order by community)) as ws from gl),
md as (select lc.*, wide, ws, ['local', 'global', 'hybrid'][query // 100 % 3 + 1] as mode, 'Entities: ' || array_to_string(labels, ', ') || chr(10) || 'Relations: ' || relations as near from lc, wd),
so as (select *, case mode when 'local' then labels when 'global' then ws else list_concat(labels, ws) end as al from md)
select query, mode, case mode when 'local' then near when 'global' then wide else 'Near the question' || chr(10) || near || chr(10) || chr(10) || 'Across all communities' || chr(10) || left(wide, 500) end as context, list_filter(al, lambda x, i: list_position(al, x) = i)[1:10] as sources from so""")
def rag_query(spark, sf_dir):
    """Every question in one of the three modes."""
    lines = g.cut(rag.community_lines(_signatures(spark, sf_dir), coded(spark, sf_dir), members(spark, sf_dir)))
    modes = F.array(*[F.lit(m) for m in ("local", "global", "hybrid")])
    asked = coded(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query"), F.get(modes, (F.floor(F.col("id") / 100) % 3).cast("int")).alias("mode"))
    return rag.contexts(asked, _local(spark, sf_dir), lines)
