"""Text to graph: sentence chunks, entities and relations, deduplication and resolution; query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import ARCHETYPES, KEYWORDS, PRIORITIES

STRIP = r"^[.,!?;:()\"«»]+|[.,!?;:()\"«»]+$"
#: An entity's archetype by its type, where no keyword tells it.
TYPE_ARCHETYPES = {"person": "MDEF", "place": "MSCF", "event": "MDCF", "concept": "ASCO", "other": "ASEF"}
#: Archetype weights by domain.
DOMAIN_WEIGHTS = {
    "urbanism": {"MDCF": 1.0, "MSCO": 0.8, "ADCO": 0.7, "ADCF": 0.6},
    "biology": {"MDEF": 1.0, "MSCF": 0.8, "MSEO": 0.6, "ASCO": 0.5},
    "technology": {"ADCO": 1.0, "ADEO": 0.9, "MDCO": 0.8, "ASCO": 0.6},
    "geography": {"MSCF": 0.9, "MSCO": 0.7, "ASCF": 0.6, "MDCF": 0.5},
    "culture": {"ASCF": 1.0, "ASEF": 0.9, "ADCF": 0.7, "ASCO": 0.5},
    "science": {"ASCO": 1.0, "ASEO": 0.9, "ADCO": 0.6, "ADEO": 0.5},
    "society": {"ADCF": 1.0, "ASCF": 0.8, "MDCF": 0.7, "ADEF": 0.4},
}
#: Words that mark a domain, in the order in which domains win among equals.
DOMAIN_WORDS = {
    "urbanism": ["город", "city", "урбан", "транспорт", "метро", "улица"],
    "biology": ["организм", "клетка", "ген", "животн", "растен", "биолог"],
    "technology": ["алгоритм", "программ", "код", "систем", "технолог", "ии", "ai"],
    "geography": ["страна", "регион", "климат", "геогр", "территор", "карт"],
    "culture": ["культур", "искусств", "язык", "религ", "традиц", "история"],
    "science": ["теория", "закон", "модель", "эксперим", "наук", "физик", "химик"],
    "society": ["общество", "социум", "политик", "экономик", "движен", "право"],
}
#: Words that ask and aren't part of a topic.
ASKING = "что как где когда зачем почему кто какой какая какие каково чем чего такое является what how where when why who which is are".split()
QUESTIONS = ["What defines {topic}?", "Which parts make up {topic}?", "How does {topic} relate to its surroundings?"]
DIMENSIONS = ["strength", "direction", "temporal", "confidence", "scale", "context", "source"]
LEAST_RELEVANCE = 0.2


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, chunk, text, start, end: sentences packed to `size` characters; the last ones of a chunk, `overlap`
    characters at most, begin the next. Offsets count one character after each sentence. A null text has no chunk."""
    text = F.trim(F.col("text"))
    sentences = F.split(text, r"(?U)(?<=[.!?])\s+")
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")
    lengths = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))

    def chunk(s: Column) -> Column:
        return F.struct(F.array_join(s["now"], " ").alias("text"), (s["pos"] - s["len"]).alias("start"), s["pos"].alias("end"))

    def tail(now: Column) -> Column:
        """The longest end of the list within the overlap."""
        start = F.struct(F.lit(0).alias("len"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def take(a: Column, x: Column) -> Column:
            on = a["on"] & (a["len"] + F.length(x) <= overlap)
            return F.struct(F.when(on, a["len"] + F.length(x)).otherwise(a["len"]).alias("len"), F.when(on, a["n"] + 1).otherwise(a["n"]).alias("n"), on.alias("on"))

        n = F.aggregate(F.reverse(now), start, take, lambda a: a["n"])
        return F.transform(F.array(n), lambda k: F.when(k == 0, empty).otherwise(F.slice(now, F.size(now) - k + 1, k)))[0]

    def step(s: Column, x: Column) -> Column:
        full = (s["len"] + F.length(x) > size) & (F.size(s["now"]) > 0)

        def add(now: Column) -> Column:
            return F.struct(
                F.concat(now, F.array(x)).alias("now"),
                (lengths(now) + F.length(x)).alias("len"),
                (s["pos"] + F.length(x) + 1).alias("pos"),
                F.when(full, F.concat(s["out"], F.array(chunk(s)))).otherwise(s["out"]).alias("out"),
            )

        return F.transform(F.array(F.when(full, tail(s["now"])).otherwise(s["now"])), add)[0]

    start = F.struct(empty.alias("now"), F.lit(0).alias("len"), F.lit(0).alias("pos"), none.alias("out"))
    packed = F.aggregate(sentences, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["out"], F.array(chunk(s)))).otherwise(s["out"]))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk", "c")).select("doc_id", "chunk", "c.text", "c.start", "c.end")


def entities(text: Column, most: int = 5) -> Column:
    """The first distinct capitalized words of more than three characters, else of words of more than four."""
    strip = lambda w: F.regexp_replace(w, STRIP, "")

    def of(words: Column) -> Column:
        capital = F.filter(words, lambda w: (F.length(w) > 3) & F.substring(w, 1, 1).rlike(r"^\p{Lu}"))

        def chosen(some: Column) -> Column:
            return F.slice(F.array_distinct(F.transform(some, strip)), 1, most)

        some = F.when(F.size(capital) > 0, capital).otherwise(F.filter(words, lambda w: F.length(w) > 4))
        return chosen(some)

    # The words are bound once: an expression would otherwise be split again for each use.
    return F.transform(F.array(F.split(F.trim(text), r"(?U)\s+")), of)[0]


def extracted(texts: DataFrame, key: list[str]) -> DataFrame:
    """key, j, label: the entities of each text, in their order."""
    return texts.select(*key, F.posexplode(entities(F.col("text"))).alias("j", "label"))


def relations(found: DataFrame, key: list[str]) -> DataFrame:
    """key, source, target, weight: each entity of a text to the next one."""
    later = F.lead("label").over(W.partitionBy(*key).orderBy("j"))
    return found.select(*key, F.col("label").alias("source"), later.alias("target"), F.lit(0.7).alias("weight")).where("target is not null")


def deduplicated(found: DataFrame, order: list[str]) -> DataFrame:
    """entity (lower-cased, trimmed label) and the first label in the given order: an aggregate that combines early."""
    entity = F.lower(F.trim("label"))
    return found.groupBy(entity.alias("entity")).agg(F.min(F.struct(*order, "label")).alias("first"), F.count("*").alias("mentions")).select("entity", F.col("first.label").alias("label"), "mentions")


def resolved(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """source, target (entities), weight: relations whose ends are known and differ, the copies of a pair counted."""
    pairs = pairs.select(F.lower(F.trim("source")).alias("source"), F.lower(F.trim("target")).alias("target"), "weight").where("source <> target")
    pairs = pairs.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    names = known.select("entity")
    return pairs.join(names.withColumnRenamed("entity", "source"), "source", "left_semi").join(names.withColumnRenamed("entity", "target"), "target", "left_semi")


EXTRACTION = "entities array<struct<id:string,label:string,type:string>>, relations array<struct<source:string,target:string,label:string,weight:double>>"


def parsed(text: Column) -> Column:
    """The outermost braces of an answer as entities and relations, empty lists where there are none or they aren't JSON."""
    kinds = EXTRACTION.replace("entities ", "").split(", relations ")

    def lists(found: Column) -> Column:
        return F.struct(*[F.coalesce(found[c], F.array().cast(k)).alias(c) for c, k in zip(("entities", "relations"), kinds)])

    # The parsed answer is bound once: an expression would otherwise be parsed, and made, for each use.
    return F.transform(F.array(F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), EXTRACTION)), lists)[0]


def type_archetype(kind: Column) -> Column:
    out = F.lit(TYPE_ARCHETYPES["other"])
    for name, code in TYPE_ARCHETYPES.items():
        out = F.when(kind == name, F.lit(code)).otherwise(out)
    return out


def by_keyword(word: Column) -> Column:
    """The codes of the archetypes that have a keyword which holds the word, in their order; all of them for an empty one."""
    w = F.lower(word)
    codes = [F.when(F.contains(F.lit("\n".join(KEYWORDS[c])), w), F.lit(c)) for c in ARCHETYPES]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def guessed_archetype(label: Column, kind: Column) -> Column:
    """The first archetype with a keyword that holds the label, else that of the entity's type."""
    return F.coalesce(F.get(by_keyword(label), F.lit(0)), type_archetype(kind))


def language(question: Column) -> Column:
    return F.when(question.rlike("[а-яА-Я]"), "ru").otherwise("en")


def named(question: Column) -> Column:
    """The words after the first that begin with a capital letter, else the first two words."""
    words = F.filter(F.split(question, r"(?U)\s+"), lambda w: w != "")
    later = F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}"))
    return F.when(F.size(later) > 0, later).otherwise(F.slice(words, 1, 2))


def topic(question: Column) -> Column:
    """The question without its closing marks and the words that ask; all of it if nothing else is left."""
    words = F.filter(F.split(F.regexp_replace(question, r"[?!.]+$", ""), r"(?U)\s+"), lambda w: w != "")
    content = F.filter(words, lambda w: ~F.lower(w).isin(ASKING))
    return F.when(F.size(content) > 0, F.array_join(content, " ")).otherwise(question)


def domain(question: Column, words: dict[str, list[str]] = DOMAIN_WORDS) -> Column:
    """The domain with the most of its words inside the question, the first of equals, else general."""
    q = F.lower(question)
    scores = F.array(*[F.struct(sum((F.contains(q, F.lit(w)).cast("int") for w in ws[1:]), F.contains(q, F.lit(ws[0])).cast("int")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(words.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def relevance(domain_: Column, hits: Column, code: str) -> Column:
    """How relevant an archetype is: its weight in the domain, its keywords in the question, its priority; 1 at most."""
    base = F.lit(0.1)
    for name, weights in DOMAIN_WEIGHTS.items():
        if code in weights:
            base = F.when(domain_ == name, F.lit(weights[code])).otherwise(base)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.5), hits * 0.1) + PRIORITIES[code] / 5 * 0.2)


def archetype_scores(questions: DataFrame, keywords: dict[str, list[str]] = KEYWORDS, words: dict[str, list[str]] = DOMAIN_WORDS) -> DataFrame:
    """questions with domain, topic and scores: an array of (ord, code, priority, score). keywords: those of each archetype."""
    q = F.lower(F.col("text"))

    def hits(code: str) -> Column:
        return sum((F.contains(q, F.lit(w.lower())).cast("int") for w in keywords.get(code, [])), F.lit(0))

    out = questions.withColumn("domain", domain(F.col("text"), words)).withColumn("topic", topic(F.col("text")))

    def scores(d: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("code"), F.lit(PRIORITIES[c]).alias("priority"), relevance(d, hits(c), c).alias("score")) for i, c in enumerate(ARCHETYPES)])

    return out.withColumn("scores", F.transform(F.array("domain"), scores)[0])  # the domain is worked out once


def expanded(scored: DataFrame, key: str) -> DataFrame:
    """key, id, archetype, priority, kind, text: three questions of every relevant archetype, then one of each dimension."""
    relevant = F.filter("scores", lambda s: s["score"] >= LEAST_RELEVANCE)
    own = F.flatten(F.transform(relevant, lambda s: F.array(*[F.struct(s["code"].alias("archetype"), s["priority"].alias("priority"), F.lit("text").alias("kind"), F.lit(q).alias("text")) for q in QUESTIONS])))
    more = F.array(*[F.struct(F.lit("HEPT").alias("archetype"), F.lit(3).alias("priority"), F.lit("number").alias("kind"), F.lit(f"Rate the {d} of {{topic}}.").alias("text")) for d in DIMENSIONS])
    each = scored.select(key, "topic", F.posexplode(F.concat(own, more)).alias("i", "q"))
    number = F.lpad((F.col("i") + 1).cast("string"), 3, "0")
    return each.select(key, F.concat(F.when(F.col("q.archetype") == "HEPT", "H").otherwise("Q"), number).alias("id"), "q.archetype", "q.priority", "q.kind", F.replace("q.text", F.lit("{topic}"), F.col("topic")).alias("text"), "topic")


def by_archetype(questions: DataFrame, code: str) -> DataFrame:
    return questions.where(F.col("archetype") == code)


def by_priority(questions: DataFrame, least: int = 3) -> DataFrame:
    return questions.where(F.col("priority") >= least)


def tree_json(questions: DataFrame, key: str) -> DataFrame:
    """key and json: the questions of a topic (key, topic, id, text, archetype, priority) in their order, as one document."""
    each = F.struct("id", "text", "archetype", "priority")
    tree = questions.groupBy(key, "topic").agg(F.array_sort(F.collect_list(F.struct(F.substring("id", 2, 9).cast("int").alias("n"), each.alias("q")))).alias("qs"))
    return tree.select(key, F.to_json(F.struct("topic", F.size("qs").alias("total"), F.transform("qs", lambda x: x["q"]).alias("questions"))).alias("json"))


def tree_markdown(questions: DataFrame, key: str) -> DataFrame:
    """key and markdown: a heading for the topic, one for each archetype by name, and the questions with their priority."""
    line = F.concat(F.lit("- ["), F.col("priority").cast("string"), F.lit("★] "), F.col("text"))
    own = questions.groupBy(key, "topic", "archetype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    part = F.concat(F.lit("## "), F.col("archetype"), F.lit("\n\n"), F.col("lines"))
    parts = own.groupBy(key, "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("archetype", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("parts"))
    return parts.select(key, F.concat(F.lit("# "), "topic", F.lit("\n\n"), "parts").alias("markdown"))
