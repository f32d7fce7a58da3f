"""Queries of text indexing, query expansion, retrieval contexts, snapshots and incremental indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import q6
from ..operators import graph as g
from ..operators import text as t
from ..operators.borders import touching
from ..sources.tables import ARCHETYPES, KEYWORDS, PRIORITIES, archetype_table, edges, payload, read, snapshot_lines
from .borders import SQL_CURVES
from .cube import SQL_NODES, coded
from .graph import _HYPER, _NAME, SQL_GRAPH, members
from .registry import query


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


_SENTENCES = r"string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _chunk_sql(table: str, key: str, size: int, overlap: int) -> str:
    return rf"""with recursive s as (select {key} as doc_id, {_SENTENCES} as s from {table} where text is not null),
st(doc_id, i, now, len, pos, done) as (select doc_id, 1, cast([] as varchar[]), cast(0 as bigint), cast(0 as bigint), cast(null as struct(text varchar, a bigint, b bigint)) from s
 union all select doc_id, i + 1, list_append(kept, x), list_sum(list_transform(list_append(kept, x), lambda y: length(y)))::bigint, pos + length(x) + 1, case when full_ then {{'text': array_to_string(now, ' '), 'a': pos - len, 'b': pos}} end
 from (select *, case when full_ then list_reverse(list_filter(list_reverse(now), lambda y, k: list_sum(list_transform(list_reverse(now)[1:k], lambda z: length(z))) <= {overlap})) else now end as kept
  from (select st.*, s.s[i] as x, len + length(s.s[i]) > {size} and len(now) > 0 as full_ from st join s using (doc_id) where i <= len(s.s)))),
al as (select doc_id, i, done as c from st where done is not null union all select st.doc_id, i + 1, {{'text': array_to_string(now, ' '), 'a': pos - len, 'b': pos}} from st join s using (doc_id) where i = len(s.s) + 1)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as chunk, c.text as text, cast(c.a as integer) as start, cast(c.b as integer) as "end" from al"""


@query(_chunk_sql("benchmark", "item_id", 120, 64))
def chunk_benchmark(spark, sf_dir):
    """Chunks of 120 characters: an overlap of 64 is at work in these short texts."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return t.chunks(items, 120, 64)


@query(_chunk_sql("documents", "doc_id", 512, 64))
def chunk_documents(spark, sf_dir):
    return t.chunks(documents(spark, sf_dir))


_WORDS = r"list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')"
_STRIP = r"regexp_replace(w, '^[.,!?;:()\"«»]+|[.,!?;:()\"«»]+$', '', 'g')"
_DISTINCT = "list_filter({0}, lambda w, i: list_position({0}, w) = i)[1:5]"
_CAPITAL = rf"list_transform(list_filter(w, lambda w: length(w) > 3 and regexp_matches(w, '^\p{{Lu}}')), lambda w: {_STRIP})"
_LONG = rf"list_transform(list_filter(w, lambda w: length(w) > 4), lambda w: {_STRIP})"
SQL_ENTITIES = rf"""wd as (select doc_id, {_WORDS} as w from documents), cx as (select doc_id, {_CAPITAL} as c, {_LONG} as l from wd),
el as (select doc_id, case when len(c) > 0 then {_DISTINCT.format('c')} else {_DISTINCT.format('l')} end as e from cx),
ent as (select doc_id, cast(unnest(range(0, len(e))) as integer) as j, unnest(e) as label from el)"""


def found(spark, sf_dir):
    return t.extracted(documents(spark, sf_dir), ["doc_id"])


@query(f"with {SQL_ENTITIES} select * from ent")
def extract_entities_mock(spark, sf_dir):
    return found(spark, sf_dir)


_DEDUPE = "dd as (select lower(trim(label)) as entity, arg_min(label, doc_id * 100 + j) as label, count(*) as mentions from ent group by 1)"


@query(f"with {SQL_ENTITIES}, {_DEDUPE} select * from dd")
def entity_dedupe(spark, sf_dir):
    return t.deduplicated(found(spark, sf_dir), ["doc_id", "j"])


@query(f"""with {SQL_ENTITIES}, pr as (select lower(trim(a.label)) as source, lower(trim(b.label)) as target from ent a join ent b on a.doc_id = b.doc_id and b.j = a.j + 1)
select source, target, cast(0.7 as double) as weight, count(*) as n from pr where source <> target group by all""")
def relation_resolve(spark, sf_dir):
    e = g.cut(found(spark, sf_dir))
    return t.resolved(t.relations(e, ["doc_id"]), t.deduplicated(e, ["doc_id", "j"]))


@query(f"""with {SQL_ENTITIES}, pr as (select distinct lower(trim(a.label)) as source, lower(trim(b.label)) as target from ent a join ent b on a.doc_id = b.doc_id and b.j = a.j + 1)
select count(distinct doc_id) as documents, count(*) as mentions, count(distinct lower(trim(label))) as entities, (select count(*) from pr where source <> target) as relations from ent""")
def index_result(spark, sf_dir):
    """What indexing all documents gives: documents with entities, mentions, different entities and relations."""
    e = g.cut(found(spark, sf_dir))
    entities = e.groupBy(F.lower(F.trim("label")).alias("entity")).agg(F.count("*").alias("k")).agg(F.sum("k").alias("mentions"), F.count("*").alias("entities"))
    relations = t.resolved(t.relations(e, ["doc_id"]), t.deduplicated(e, ["doc_id", "j"])).agg(F.count("*").alias("relations"))
    return entities.join(e.where("j = 0").agg(F.count("*").alias("documents")), F.lit(True)).join(relations, F.lit(True))


@query(f"with {SQL_ENTITIES} select doc_id, len(e) as n_entities, e[1] as first from el")
def parse_extraction_json(spark, sf_dir):
    """A round trip: entities written as an answer with text around its JSON, and parsed again."""
    items = F.transform(t.entities(F.col("text")), lambda x: F.struct(F.lit("e").alias("id"), x.alias("label"), F.lit("concept").alias("type")))
    answer = F.concat(F.lit("Here it is: "), F.to_json(F.struct(items.alias("entities"))), F.lit(" done"))
    p = documents(spark, sf_dir).select("doc_id", t.parsed(answer).alias("p"))
    both = F.transform(F.array("p"), lambda x: F.struct(F.size(x["entities"]).cast("long").alias("n"), F.get(x["entities"], F.lit(0))["label"].alias("first")))[0]
    return p.select("doc_id", both.alias("b")).select("doc_id", F.col("b.n").alias("n_entities"), "b.first")


#: The domains' words, and some from the tables' own languages, so that the expansion has something to find.
_MORE = {"urbanism": ["the", "thing"], "science": ["tion", "ning"], "society": ["and", "with"], "culture": ["le", "eau"]}
WORDS = {name: [*words, *_MORE.get(name, [])] for name, words in t.DOMAIN_WORDS.items()}
_NAMES = list(WORDS)
_DOMAIN = "case " + " ".join("when " + " and ".join([f"{a} > 0", *[f"{a} > {b}" for b in _NAMES[:i]], *[f"{a} >= {b}" for b in _NAMES[i + 1 :]]]) + f" then '{a}'" for i, a in enumerate(_NAMES)) + " else 'general' end"
_HITS = ", ".join("(" + " + ".join(f"(contains(lower(text), '{w}'))::integer" for w in ws) + f") as {name}" for name, ws in WORDS.items())
_ASKING = "[" + ", ".join(f"'{w}'" for w in t.ASKING) + "]"
_TOPIC = rf"list_filter(regexp_split_to_array(regexp_replace(text, '[?!.]+$', ''), '\s+'), lambda w: w <> '' and not list_contains({_ASKING}, lower(w)))"
SQL_QUESTIONS = f"qs as (select item_id, text, {_HITS}, case when len({_TOPIC}) > 0 then array_to_string({_TOPIC}, ' ') else text end as topic from benchmark), qd as (select *, {_DOMAIN} as domain from qs)"


def _score_sql(code: str) -> str:
    base = "case " + " ".join(f"when domain = '{d}' then {w[code]}" for d, w in t.DOMAIN_WEIGHTS.items() if code in w) + " else 0.1 end" if any(code in w for w in t.DOMAIN_WEIGHTS.values()) else "0.1"
    hits = " + ".join(f"(contains(lower(text), '{w}'))::integer" for w in KEYWORDS[code]) or "0"
    return f"least(1.0, {base} + least(0.5, ({hits}) * 0.1) + {PRIORITIES[code]} / 5 * 0.2)"


_SCORES = "sc as (" + " union all ".join(f"select item_id, topic, domain, {i} as ord, '{c}' as code, {PRIORITIES[c]} as priority, cast({_score_sql(c)} as double) as score from qd" for i, c in enumerate(ARCHETYPES)) + ")"


def questions(spark, sf_dir):
    return t.archetype_scores(read(spark, sf_dir, "benchmark").select("item_id", "text"), words=WORDS)


@query(f"with {SQL_QUESTIONS} select item_id, domain, topic from qd")
def classify_domain(spark, sf_dir):
    return questions(spark, sf_dir).select("item_id", "domain", "topic")


@query(f"with {SQL_QUESTIONS}, {_SCORES} select item_id, code, round(score, 6) as score from sc")
def archetype_relevance(spark, sf_dir):
    return questions(spark, sf_dir).select("item_id", F.explode("scores").alias("s")).select("item_id", "s.code", F.round("s.score", 6).alias("score"))


_TEXTS = f"[{', '.join(repr(q) for q in t.QUESTIONS)}]"
_RATES = f"[{', '.join(repr(f'Rate the {d} of {{topic}}.') for d in t.DIMENSIONS)}]"


SQL_TREE = f"""{SQL_QUESTIONS}, {_SCORES}, a as (select item_id, topic, ord * 3 + k as o, code as archetype, priority, 'text' as kind, {_TEXTS}[k + 1] as q from sc, range(0, 3) r(k) where score >= 0.2),
h as (select item_id, topic, 1000 + k as o, 'HEPT' as archetype, 3 as priority, 'number' as kind, {_RATES}[k + 1] as q from qd, range(0, 7) r(k)), u as (select * from a union all select * from h),
n as (select *, row_number() over (partition by item_id order by o) as r from u),
tree as (select item_id, r, topic, case when archetype = 'HEPT' then 'H' else 'Q' end || lpad(cast(r as varchar), 3, '0') as id, archetype, priority, kind, replace(q, '{{topic}}', topic) as text from n)"""


def tree(spark, sf_dir):
    return t.expanded(questions(spark, sf_dir), "item_id")


@query(f"with {SQL_TREE} select item_id, id, archetype, priority, kind, text from tree")
def expand_query(spark, sf_dir):
    return tree(spark, sf_dir).drop("topic")


@query(f"with {SQL_TREE} select item_id, id, archetype, priority from tree where archetype = 'ASCO' or priority >= 5")
def question_filters(spark, sf_dir):
    """The questions of one archetype, and those of the highest priority."""
    own = g.cut(tree(spark, sf_dir).select("item_id", "id", "archetype", "priority"))
    return t.by_archetype(own, "ASCO").unionByName(t.by_priority(own, 5)).distinct()


@query(f"with {SQL_TREE} select item_id, count(*) as total, string_agg(id || ':' || archetype || ':' || priority || ':' || text, '|' order by r) as flat, '# ' || any_value(topic) as head from tree group by item_id")
def question_tree(spark, sf_dir):
    """The JSON document of every item's questions, read back, and the first line of its Markdown."""
    own = g.cut(tree(spark, sf_dir))
    back = t.tree_json(own, "item_id").select("item_id", F.from_json("json", "topic string, total long, questions array<struct<id:string,text:string,archetype:string,priority:int>>").alias("x"))
    flat = F.array_join(F.transform("x.questions", lambda q: F.concat_ws(":", q["id"], q["archetype"], q["priority"].cast("string"), q["text"])), "|")
    head = t.tree_markdown(own, "item_id").select("item_id", F.get(F.split("markdown", "\n"), F.lit(0)).alias("head"))
    return back.select("item_id", "x.total", flat.alias("flat")).join(head, "item_id")


_KEYWORDS = "[" + ", ".join(f"{{'code': '{c}', 'words': {KEYWORDS[c]!r}}}" for c in ARCHETYPES) + "]"
_GUESS = "coalesce(list_filter({kw}, lambda a: len(list_filter(a.words, lambda w: contains(w, lower({label})))) > 0)[1].code, {other})"
_TYPES = "case j when 0 then 'MDEF' when 1 then 'MSCF' when 2 then 'MDCF' when 3 then 'ASCO' else 'ASEF' end"


@query(f"with {SQL_ENTITIES}, s as (select doc_id, j, label[1:3] as label from ent) select doc_id, j, label, {_GUESS.format(kw=_KEYWORDS, label='label', other=_TYPES)} as archetype from s")
def guess_archetype(spark, sf_dir):
    """The archetype of every entity by its first three letters, which some keywords hold, else by a type (its place in the text)."""
    kind = F.get(F.array(*[F.lit(k) for k in t.TYPE_ARCHETYPES]), F.col("j"))
    short = found(spark, sf_dir).withColumn("label", F.substring("label", 1, 3))
    return short.select("doc_id", "j", "label", t.guessed_archetype(F.col("label"), kind).alias("archetype"))


@query(rf"with a as (select unnest({_KEYWORDS}) as a, generate_subscripts({_KEYWORDS}, 1) as i), w as (select item_id, lower(unnest(regexp_extract_all(text, '\p{{L}}+'))) as word from benchmark), d as (select distinct item_id, word from w where length(word) >= 3) select item_id, word, list(a.code order by i) as codes from d, a where len(list_filter(a.words, lambda k: contains(k, word))) > 0 group by all")
def archetype_by_keyword(spark, sf_dir):
    """The archetypes whose keywords hold a word of an item."""
    w = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower))).alias("word")).where("length(word) >= 3")
    return w.withColumn("codes", t.by_keyword(F.col("word"))).where("size(codes) > 0")


@query(f"with {SQL_NODES} select archetype as code, left(archetype, 2) as quadrant, cast((archetype[1] = 'M')::integer + 2 * (archetype[2] = 'D')::integer + 4 * (archetype[3] = 'C')::integer + 8 * (archetype[4] = 'O')::integer as integer) as hex_id, count(*) as n from nodes where list_contains({[c for c in ARCHETYPES if PRIORITIES[c] >= 4]!r}, archetype) or left(archetype, 2) = 'MS' group by 1")
def archetype_lookup(spark, sf_dir):
    """Nodes by archetype, of those of the first quadrant and those of priority 4 or more."""
    a = archetype_table(spark).where("quadrant = 'MS' or priority >= 4").select("code", "quadrant", "hex_id")
    n = coded(spark, sf_dir).groupBy(F.col("archetype").alias("code")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(a), "code").select("code", "quadrant", "hex_id", "n")


@query(r"""with w as (select item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from benchmark)
select item_id, case when regexp_matches(text, '[а-яА-Я]') then 'ru' else 'en' end as language, case when len(list_filter(w[2:], lambda x: regexp_matches(x, '^\p{Lu}'))) > 0 then list_filter(w[2:], lambda x: regexp_matches(x, '^\p{Lu}')) else w[1:2] end as entities from w""")
def parse_topic(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark")
    return q.select("item_id", t.language(F.col("text")).alias("language"), t.named(F.col("text")).alias("entities"))


@query(f"with {SQL_GRAPH} select 'node' as kind, count(*) as n, cast(sum(hex_id) as bigint) as total from nodes union all select 'edge', count(*), cast(sum(source) as bigint) from edges")
def snapshot_roundtrip(spark, sf_dir):
    """Nodes and edges as JSON lines, parsed again."""
    lines = g.cut(snapshot_lines(coded(spark, sf_dir).select("id", "label", "embedding", "hex_id"), edges(spark, sf_dir)))
    back = lines.select("kind", F.from_json("json", "hex_id long, source long").alias("x"))
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("x.hex_id", "x.source")).alias("total"))


@query(f"with {SQL_GRAPH} select 'node' as kind, 'n' || id as a, label as b, round(v[1], 6) as value from nodes union all select 'edge', 'n' || source, 'n' || target, round(weight, 6) from edges")
def snapshot_document(spark, sf_dir):
    """A graph written as one JSON document, and read again in byte ranges."""
    from ..sources.tables import read_snapshot, write_document

    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias(c)
    path = f"{g.scratch_path(spark)}/document"
    n = coded(spark, sf_dir).select(name("id"), "label", "archetype", "embedding")
    write_document(n, edges(spark, sf_dir).select(name("source"), name("target"), "weight", "directed"), path)
    nodes, links = read_snapshot(spark, path)
    both = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.round(F.get("embedding", F.lit(0)), 6).alias("value"))
    return both.unionByName(links.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.round("weight", 6).alias("value")))


@query(f"with {SQL_GRAPH} select id, '{{\"id\":' || id || ',\"label\":\"' || label || '\",\"hex\":' || hex_id || ',\"community\":' || community || '}}' as json from nodes join member on node_id = id")
def viz_payload(spark, sf_dir):
    """One JSON object per node for a viewer."""
    n = coded(spark, sf_dir).join(members(spark, sf_dir).withColumnRenamed("node_id", "id"), "id")
    return n.select("id", F.to_json(F.struct("id", "label", F.col("hex_id").alias("hex"), "community")).alias("json"))


_QUOTED = "'[' || array_to_string({0}, ',') || ']'"


@query(f"""with recursive {SQL_CURVES}, {_HYPER} select 'node' as kind, '{{"id":' || id || ',"label":"' || label || '","archetype":"' || archetype || '","hex":' || hex_id || ',"community":' || community || '}}' as json from nodes join member on node_id = id
union all select 'edge', '{{"source":' || source || ',"target":' || target || ',"directed":' || directed || '}}' from edges
union all select 'community', '{{"community":' || community || ',"hex":' || hex_id || '}}' from ch
union all select 'border', '{{"a":' || a || ',"b":' || b || ',"hd":' || hd || '}}' from bp
union all select 'hyper_edge', '{{"node":' || node || ',"members":' || {_QUOTED.format("members")} || ',"label":"' || {_NAME} || '"}}' from hyper""")
def map_payload(spark, sf_dir):
    """Everything that a viewer draws, a JSON object each: nodes, edges, communities, borders and hyper-edges."""
    n, c = coded(spark, sf_dir), g.cut(g.mean_codes(members(spark, sf_dir), coded(spark, sf_dir)))
    e = g.cut(edges(spark, sf_dir))
    own = n.join(members(spark, sf_dir).withColumnRenamed("node_id", "id"), "id").withColumnRenamed("hex_id", "hex")
    borders = touching(c).join(c.select(F.col("community").alias("a"), F.col("hex_id").alias("ha")), "a").join(c.select(F.col("community").alias("b"), F.col("hex_id").alias("hb")), "b")
    parts = {"node": own.select("id", "label", "archetype", "hex", "community"), "edge": e.select("source", "target", "directed"), "community": c.select("community", F.col("hex_id").alias("hex")), "border": borders.select("a", "b", q6.hamming(F.col("ha"), F.col("hb")).alias("hd")), "hyper_edge": g.hyper_edges(e)}
    return payload(parts)


@query("with s as (select ts, event_type, value from events) select date_trunc('hour', ts) as start, event_type, count(*) as n from s group by all")
def stream_event_counts(spark, sf_dir):
    from ..streaming.index import hourly_counts

    return hourly_counts(spark, sf_dir)


@query(f"with {SQL_ENTITIES} select lower(trim(label)) as entity, count(*) as mentions from ent group by 1")
def stream_incremental_index(spark, sf_dir):
    from ..streaming.index import entity_mentions

    return entity_mentions(spark, sf_dir)


@query(f"with {SQL_ENTITIES}, {_DEDUPE} select * from dd")
def stream_entity_index(spark, sf_dir):
    """The first label of every entity and its mentions, kept as state while documents arrive."""
    from ..streaming.index import first_entities

    return first_entities(spark, sf_dir)
