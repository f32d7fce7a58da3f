"""Queries of extraction by rules, over the chunks of whole documents, with the items' words as vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import q6
from ..operators import semantic as s
from ..operators import text as t
from .cube import _CODE
from .more import _EVEN, phrases_of_items
from .registry import query
from .text import _chunk_sql, documents

#: Words of the tables' languages that here stand after a subject.
VERBS = [*s.VERBS, "the", "and", "of", "de", "la", "der", "und", "en", "que"]
_NOT = "[" + ", ".join(f"'{w}'" for w in s.NO_ENTITIES) + "]"
_PAIR = "struct(source varchar, target varchar)"
_BASE = f"""{_EVEN}, ck as ({_chunk_sql("documents", "doc_id", 512, 64)}), lw as (select doc_id, chunk, text, lower(text) as low from ck),
ht as (select doc_id, chunk, phrase, row_number() over (partition by doc_id, chunk order by ord) as r from lw join vo on length(phrase) > 4 and contains(low, phrase)),
hs as (select doc_id, chunk, list(upper(phrase[1]) || phrase[2:] order by r) as hits from ht where r <= 6 group by all),
cm as (select doc_id, chunk, text, list_concat(regexp_extract_all(text, '{s.TERM}')[1:8], coalesce(hits, []), list_filter(regexp_split_to_array(text, '{s.APART}'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))[1:4]) as c from lw left join hs using (doc_id, chunk)),
fl as (select doc_id, chunk, text, list_filter(c, lambda e: length(e) > 3 and not list_contains({_NOT}, e)) as c from cm),
ec as (select doc_id, chunk, text, case when len(c) = 0 then {s.STAND_INS!r} else list_filter(c, lambda e, i: list_position(c, e) = i)[1:10] end as e from fl),
sb as (select doc_id, chunk, e, regexp_extract_all(text, '({s.TERM})\\s+(?:{"|".join(VERBS)})', 1) as u from ec),
pr as (select doc_id, chunk, e, cast(list_filter(list_transform(range(1, len(u)), lambda i: {{'source': u[i], 'target': u[i + 1]}}), lambda p: p.source <> p.target and not list_contains({_NOT}, p.source) and not list_contains({_NOT}, p.target)) as {_PAIR}[]) as p from sb),
rl as (select doc_id, chunk, e, case when len(p) > 0 then p when len(e) >= 2 then cast([{{'source': e[1], 'target': e[2]}}] as {_PAIR}[]) else cast([] as {_PAIR}[]) end as p from pr)"""
# The first phrase by ord is the first in the order of phrases; entities of a chunk keep their places.
SQL_SEMANTIC = f"with recursive {_BASE}"


def extracted(spark, sf_dir):
    return s.extract(t.chunks(documents(spark, sf_dir)).select("doc_id", "chunk", "text"), phrases_of_items(spark, sf_dir), VERBS)


@query(f"{SQL_SEMANTIC} select doc_id, chunk, cast(generate_subscripts(e, 1) - 1 as integer) as j, unnest(e) as label from rl")
def semantic_entities(spark, sf_dir):
    """Every chunk's terms, phrases of the vocabulary and acronyms."""
    return extracted(spark, sf_dir).select("doc_id", "chunk", F.posexplode("entities").alias("j", "label"))


@query(f"{SQL_SEMANTIC} select doc_id, chunk, cast(generate_subscripts(p, 1) - 1 as integer) as j, unnest(p).source as source, unnest(p).target as target from rl")
def semantic_relations(spark, sf_dir):
    """Every chunk's subjects, each to the next."""
    return extracted(spark, sf_dir).select("doc_id", "chunk", F.posexplode("relations").alias("j", "r")).select("doc_id", "chunk", "j", "r.source", "r.target")


_INDEX = f"""{SQL_SEMANTIC}, en as (select doc_id, chunk, generate_subscripts(e, 1) as j, unnest(e) as label from rl),
nd as (select lower(trim(label)) as entity, arg_min(label, doc_id * 1000000000 + chunk * 100 + j) as label from en group by 1),
n0 as (select entity, list_reduce(list_transform(string_split(label, ''), lambda c: cast(ord(c) as bigint)), lambda a, c: (a * 31 + c) & 4294967295, cast(0 as bigint)) as h0 from nd),
n1 as (select entity, list_transform(list_reduce(range(1, 7), lambda a, i: list_append(a, (a[len(a)] * 1664525 + 1013904223) & 4294967295), [h0])[2:7], lambda x: x / 2147483647 - 1) as t from n0),
n2 as (select entity, {_CODE} as hex_id from n1),
rw as (select unnest(p) as r from rl), rp as (select lower(trim(r.source)) as source, lower(trim(r.target)) as target from rw),
ed as (select * from rp where source <> target and source in (select entity from nd) and target in (select entity from nd))"""


@query(f"""{_INDEX}, ce as (select unnest({list(q6.packing(1)[:6])}) as c, generate_subscripts({list(range(6))}, 1) as o),
me as (select entity, arg_min(c, cast(bit_count(xor(hex_id, c)) as integer) * 100 + o) as community from n2, ce group by 1)
select (select count(*) from rl) as n_chunks, (select count(*) from nd) as n_entities, (select count(*) from rp) as n_relations, (select count(*) from nd) as n_nodes, (select count(*) from ed) as n_edges, (select count(distinct community) from me) as n_communities""")
def semantic_index(spark, sf_dir):
    """What indexing all documents by these rules gives."""
    return s.index_counts(*s.index(documents(spark, sf_dir), phrases_of_items(spark, sf_dir), verbs=VERBS))


@query(f"{_INDEX} select source, target, count(*) as n from ed group by all")
def semantic_edges(spark, sf_dir):
    """The edges between entities of all documents, the copies of a pair counted."""
    return s.index(documents(spark, sf_dir), phrases_of_items(spark, sf_dir), verbs=VERBS)[2].groupBy("source", "target").agg(F.count("*").alias("n"))
