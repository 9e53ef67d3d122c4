"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A mask looks at five of the words in a short span and ignores the others, so that a changed word spoils only the
seeds that look at it. Seeds of the benchmark meet those at every position of every document; around a hit, the
document is laid beside the whole benchmark item and words that agree are counted. A document is contaminated if some
stretch of ``STRETCH`` item words, or a whole item that is shorter, agrees in ``AGREE_PERCENT`` of its words.

The fixed masks find every such stretch of ``STRETCH`` words. For the lengths of shorter items that the benchmark has,
masks of four or three words are added until every placement of the changed words that the rule admits leaves some seed
whole (``short_masks``), so nothing that the rule calls contaminated is missed at any length.

Words are runs of letters and digits in lower case. Everything up to the hits is a narrow plan over the documents:
hashes of words, one row a position, and a join with the benchmark's seeds, which are broadcast while they are few. A hit
is four numbers (document, its words' hash, item, shift); equal hits are one before anything is compared, and the words
of the documents that were hit are read again, so that no array of words is ever shuffled beside a seed.

Defined results: a null text has no words and is not contaminated; an item of fewer than five words never matches; rows
with equal doc_ids are judged together; a null doc_id is an id like another; of equally good items the smallest id is
named, and equal items are items of their own unless their ids are equal too; an empty benchmark contaminates nothing; an
empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import without
from tessera.llm.store import bounded_batches, saved

#: Offsets that each mask looks at, from the shortest span to the longest.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 6, 7))
STRETCH, AGREE_PERCENT, SHORTEST = 15, 75, 5
#: Seeds (20 bytes each) that are broadcast at most, and hits (32 bytes each); beyond, the joins shuffle.
MOST_BROADCAST, MOST_HITS = 2_000_000, 500_000


def short_masks(lengths: list[int], first: tuple[tuple[int, ...], ...] = MASKS) -> tuple[tuple[int, ...], ...]:
    """Masks that beside ``first`` find every admitted way in which items of these lengths may be changed."""
    masks = list(first)
    for n in sorted({n for n in lengths if SHORTEST <= n < STRETCH}):
        changed = n - -(-AGREE_PERCENT * n // 100)
        left = {frozenset(c) for c in combinations(range(n), changed)}
        finds = lambda mask, c, n=n: any(not c & {o + s for o in mask} for s in range(n - mask[-1]))
        left = {c for c in left if not any(finds(m, c) for m in masks if m[-1] < n)}
        weight, added = 4, []
        while left:
            tried = [(0, *rest) for rest in combinations(range(1, n), weight - 1)]
            best = max(tried, key=lambda m: (sum(finds(m, c) for c in left), -m[-1], tuple(-o for o in m)))
            found = {c for c in left if finds(best, c)}
            # Four words a seed while few masks of them will do, else three.
            if not found or (weight == 4 and len(added) == 3 and found != left):
                weight -= 1
                continue
            added.append(best)
            left -= found
        masks += [m for m in added if m not in masks]
    return tuple(masks[len(first) :])


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    clean = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.filter(F.split(clean, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, words: str = "w") -> DataFrame:
    """Adds (at, seed): a row for each position and each mask that fits there; at counts from 0."""
    n, offsets = F.size(words), sorted({o for mask in masks for o in mask})
    shifted = [F.slice(words, o + 1, F.greatest(n, F.lit(1))).alias(f"w{o}") for o in offsets]
    spots = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("at"), *shifted)
    # A condition inside the generator and not a filter, which would hash the words a second time.
    spread = rows.select("*", F.inline(F.when(n >= min(map(len, masks)), spots)).alias("at", *(f"w{o}" for o in offsets)))
    each = [F.when(F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(",".join(map(str, mask))), *(F.col(f"w{o}") for o in mask))) for mask in masks]
    kept = [c for c in rows.columns if c != words] + ["at"]
    return spread.select(*kept, F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def best_agreement(equal: str, size: int) -> str:
    """SQL: the most words that agree in a stretch of ``size`` of the array of 0 and 1 ``equal`` (or in all of it)."""
    sums = f"aggregate({equal}, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    return f"array_max(transform(array({sums}), s -> array_max(transform(sequence(0, greatest(size(s) - 1 - {size}, 0)), i -> s[least(i + {size}, size(s) - 1)] - s[i]))))"


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_broadcast: int = MOST_BROADCAST, most_hits: int = MOST_HITS) -> DataFrame:
    """(doc_id, item_id, n_equal, n_stretch, n_item_equal): a row for each document and item of which some stretch agrees well enough."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("w")).where(F.size("w") >= SHORTEST).distinct()
    items = saved(items.withColumn("item_key", F.xxhash64("w")), "items")
    lengths = [r["n"] for r in items.where(F.size("w") < STRETCH).select(F.size("w").alias("n")).distinct().collect()]
    masks, few = MASKS, short_masks(lengths)
    item_seeds = seeds(items, masks)
    if few:
        masks, item_seeds = MASKS + few, item_seeds.unionByName(seeds(items.where(F.size("w") < STRETCH), few))
    item_seeds = saved(item_seeds.select("item_id", "item_key", F.col("at").alias("item_at"), F.col("seed").alias("item_seed")).distinct(), "seeds")
    sides = items.select(F.col("item_id").alias("of"), F.col("item_key").alias("of_key"), F.col("w").alias("item_words"))
    if item_seeds.count() <= most_broadcast:
        item_seeds, sides = F.broadcast(item_seeds), F.broadcast(sides)
    else:
        item_seeds, sides = item_seeds.hint("merge"), sides.hint("merge")
    keyed = lambda rows: rows.select("doc_id", word_hashes(F.col(text)).alias("w")).withColumn("doc_key", F.xxhash64("w"))
    hits = seeds(keyed(docs), masks).join(item_seeds, F.col("seed") == F.col("item_seed"))
    # One row a diagonal: hits of one document and item with the same shift tell the same thing.
    hits = saved(hits.select(F.col("doc_id").alias("hit_id"), F.col("doc_key").alias("hit_key"), "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    ids = hits.select("hit_id").distinct()
    if hits.count() <= most_hits:
        hits, ids = F.broadcast(hits), F.broadcast(ids)
    else:
        hits, ids = hits.hint("merge"), ids.hint("merge")
    again = keyed(docs.select("doc_id", text).join(ids, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi"))
    aligned = again.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("doc_key") == F.col("hit_key"))).join(sides, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("item_key") == F.col("of_key")))
    equal = F.expr("transform(item_words, (x, i) -> cast(coalesce(i + shift >= 0 and get(w, i + shift) = x, false) as int))")
    stretch = F.least(F.size("item_words"), F.lit(STRETCH))
    compared = aligned.select("doc_id", "item_id", stretch.cast("long").alias("n_stretch"), equal.alias("equal"))
    scored = compared.withColumn("n_equal", F.expr(best_agreement("equal", STRETCH)).cast("long")).where(100 * F.col("n_equal") >= AGREE_PERCENT * F.col("n_stretch"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("n_stretch").alias("n_stretch"), F.max(F.aggregate("equal", F.lit(0), lambda a, x: a + x)).cast("long").alias("n_item_equal"))


def judged(docs: DataFrame, benchmark: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (of the best agreement), n_equal: a row for each distinct doc_id."""
    best = F.max_by("item_id", F.struct("n_equal", "n_item_equal", -F.col("item_id")))
    found = matches(docs, benchmark, text, **limits).select("doc_id", "item_id", "n_equal", "n_item_equal", F.lit(1).alias("hit"))
    every = docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_equal"), F.lit(0).cast("long").alias("n_item_equal"), F.lit(None).cast("int").alias("hit"))
    out = every.unionByName(found).groupBy("doc_id").agg(F.count("hit").alias("n_items"), best.alias("item_id"), F.max("n_equal").alias("n_equal"))
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id", "n_equal")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    return without(docs, matches(docs, benchmark, text), {"doc_id": F.col("doc_id")})


ORACLE = rf"""
with d as (select doc_id, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') as w from benchmark),
m as (select unnest([{", ".join(str(list(m)) for m in MASKS)}]) as mask),
ds as (select doc_id, pos, mask, list_transform(mask, lambda o: w[pos + o + 1]) as s from (select doc_id, w, unnest(range(0, len(w))) as pos from d) x, m where pos + mask[5] < len(w)),
bs as (select item_id, pos, mask, list_transform(mask, lambda o: w[pos + o + 1]) as s from (select item_id, w, unnest(range(0, len(w))) as pos from b) x, m where pos + mask[5] < len(w)),
h as (select distinct doc_id, item_id, ds.pos - bs.pos as shift from ds join bs using (mask, s)
    union select doc_id, item_id, unnest(range(1 - len(b.w), len(d.w))) as shift from d, b where len(b.w) between {SHORTEST} and {STRETCH - 1}),
e as (select doc_id, item_id, shift, list_transform(range(0, len(b.w)), lambda i: case when i + shift >= 0 and i + shift < len(d.w) and d.w[i + shift + 1] = b.w[i + 1] then 1 else 0 end) as e from h join d using (doc_id) join b using (item_id)),
a as (select doc_id, item_id, least({STRETCH}, len(e)) as n_stretch, list_sum(e) as n_all, list_max(list_transform(range(0, greatest(len(e) - {STRETCH}, 0) + 1), lambda i: list_sum(e[i + 1:i + {STRETCH}]))) as n_equal from e),
g as (select doc_id, item_id, max(n_equal) as n_equal, max(n_all) as n_all from a where 100 * n_equal >= {AGREE_PERCENT} * n_stretch group by doc_id, item_id),
r as (select *, row_number() over (partition by doc_id order by n_equal desc, n_all desc, item_id) as k, count(*) over (partition by doc_id) as n_items from g)
select doc_id, k is not null as contaminated, coalesce(n_items, 0) as n_items, item_id, cast(coalesce(n_equal, 0) as bigint) as n_equal from (select distinct doc_id from d) left join r using (doc_id) where k is null or k = 1
"""
