"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every run of `window` consecutive words, the smallest hash of its k-word grams is kept. Two equal windows keep the
same hash, so every shared run of at least `window` words is met. A bit set of the benchmark's hashes drops the other
windows of a document inside its row; the few that pass carry their words, are joined with the benchmark's windows on
the words themselves, and hits are extended to the words that they cover.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored, table, with_group

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct benchmark windows that may be broadcast (some 100 bytes each); beyond, the join is shuffled.
BROADCAST_WINDOWS = 200_000
#: The bit set has 2^MAX_BITS bits at most (half a megabyte); it only saves work, the join decides.
MAX_BITS = 22
CANDIDATES = "array<struct<n:int,at:int,words:string>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _upto(last: Column) -> Column:
    """0 to last, or nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _gram(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(n)])


def window_keys(hashes: Column, window: int, k: int) -> Column:
    """For each window of word hashes, the smallest hash of its k-grams."""
    grams = F.transform(_upto(F.size(hashes) - k), lambda i: _gram(hashes, i, k))
    return let(grams, lambda g: F.transform(_upto(F.size(hashes) - window), lambda j: F.least(*[F.get(g, j + i) for i in range(window - k + 1)])))


def whole_keys(hashes: Column, n: int) -> Column:
    """For each run of n words, its hash: for items that have only n words."""
    return F.transform(_upto(F.size(hashes) - n), lambda j: _gram(hashes, j, n))


def _keys(hashes: Column, n: int, window: int, k: int) -> Column:
    return window_keys(hashes, window, k) if n == window else whole_keys(hashes, n)


def _windows(words: Column, at: Column, n: int) -> Column:
    return F.transform(at, lambda j: F.struct(F.lit(n).alias("n"), j.alias("at"), F.array_join(F.slice(words, j + 1, n), " ").alias("words")))


def benchmark_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """Distinct windows of the items: n, words, key, items (sorted item ids as strings)."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    n = F.least(F.size("w"), F.lit(window))
    cut = words.where(F.size("w") > 0).select("item", "w", n.alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    keys = let(F.col("h"), lambda h: F.when(F.col("n") == window, window_keys(h, window, k)).otherwise(_short_key(h, F.col("n"), window)))
    each = cut.select("item", "w", "n", F.posexplode(keys).alias("at", "key"))
    each = each.select("item", "n", "key", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("words"))
    return each.groupBy("n", "words", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _short_key(h: Column, n: Column, window: int) -> Column:
    key = F.lit(None).cast("array<bigint>")
    for i in range(1, window):
        key = F.when(n == i, F.array(_gram(h, F.lit(0), i))).otherwise(key)
    return key


def _bit_set(windows: DataFrame, n: int, bits: int) -> Column:
    """The low bits of the keys of the windows of n words, as an array of 2^(bits-6) longs."""
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    filled = windows.where(F.col("n") == n).select(F.shiftright(low, 6).alias("i"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b"))
    rows = {r.i: r.b for r in filled.groupBy("i").agg(F.bit_or("b").alias("b")).collect()}
    return F.expr("cast(split('" + ",".join(str(rows.get(i, 0)) for i in range(1 << (bits - 6))) + "', ',') as array<bigint>)")


def _passes(bit_set: Column, bits: int, key: Column) -> Column:
    at = F.shiftright(key.bitwiseAND((1 << bits) - 1), 6).cast("int")
    return F.getbit(F.get(bit_set, at), key.bitwiseAND(63).cast("int")) == 1


def _marked(keys: Column, bit_set: Column, bits: int) -> Column:
    """The places of the keys whose bit is set."""
    return let(keys, lambda m: F.filter(_upto(F.size(m) - 1), lambda j: _passes(bit_set, bits, F.get(m, j))))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted array), items_sha256, contaminated.

    A word is hit if it lies in a run of words that is also a window of an item: `window` consecutive words of it, or all
    of them if it has fewer. Null and empty texts have no words; items without words have no windows and items without
    an id are ignored. Repeated rows are answered one by one, by row and not by doc_id. Without items, or without rows,
    nothing is hit. Columns other than doc_id, item_id and text are ignored.
    """
    windows = stored(benchmark_windows(items, window, k), "benchmark-windows")
    sizes = {r.n: r.c for r in windows.groupBy("n").agg(F.countDistinct("key").alias("c")).collect()}  # `window` rows at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"))

    def found(w: Column) -> Column:
        def of(h: Column) -> Column:
            parts = [F.array().cast(CANDIDATES)]
            for n, count in sorted(sizes.items()):
                bits = min(MAX_BITS, max(10, math.ceil(math.log2(count)) + 9))
                at = _marked(_keys(h, n, window, k), _bit_set(windows, n, bits), bits)
                parts.append(_windows(w, at, n).cast(CANDIDATES))
            return F.concat(*parts)

        return let(F.transform(w, lambda x: F.xxhash64(x)), of)

    candidates = rows.select("row", "doc_id", F.size("w").alias("n_words"), let(F.col("w"), found).alias("c"))
    each = candidates.select("row", "doc_id", "n_words", F.explode_outer("c").alias("c")).select("row", "doc_id", "n_words", "c.n", "c.at", "c.words")
    windows = windows.select("n", "words", "items")
    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        met = each.join(F.broadcast(windows), ["n", "words"], "left")
    else:  # a window that very many documents hold goes apart from the others
        each = stored(each, "benchmark-candidates")
        often = each.where("words is not null").groupBy("n", "words").agg(F.count("*").alias("size"))
        met = with_group(each, windows.join(often, ["n", "words"]), ["n", "words"], "size")
    hits = met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("at", "n")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["n"]).alias("end"),
            (a["hit"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"]))).alias("hit"),
        ),
        lambda a: a["hit"].cast("long"),
    )
    return hits.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").select(
        "*", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination(docs, items).drop("items")


_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark where item_id is not null),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') as words
       from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as j from b where len(w) > 0)),
ln as (select distinct n from bw),
dw as (select doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') as words
       from (select *, unnest(range(1, len(w) - n + 2)) as j from d, ln where len(w) >= n)),
h as (select distinct dw.doc_id, dw.j, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.words = bw.words),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(j, j + n)) as p from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
