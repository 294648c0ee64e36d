"""Benchmark passages in training documents, found by spaced seeds and verified around the hits.

A seed is the hash of the tokens under a fixed mask; tokens at the mask's zeros are ignored, so a
replaced token does not break every seed over it. Seeds at all positions of both sides are joined,
a hit gives a diagonal (document token minus item token), and on every diagonal the aligned tokens
are compared: an item leaks where a stretch of 13 aligned tokens (the whole item, if shorter) has
at least 80 % equal ones. The default masks miss no such stretch: every pattern of substitutions
that leaves 80 % holds a seed.

Of hits of one seed in one document, only the first is followed where the tokens around them are the
same as far as an item with that seed reaches, as all of them compare alike and the first place is
reported. So texts that repeat a few words do not multiply with items that do so too. Documents are
cut to the tokens beside each item before they are compared.

Everything is DataFrame functions. Tokens are lower-cased maximal runs of characters other than
ASCII punctuation, white space and controls. Letters of scripts without spaces (Han, Kana,
Bopomofo, Yi, Thai, Lao, Tibetan, Myanmar, Khmer) are tokens of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.grouped import named_texts
from tallyframe.session import saved_table

_NO_TOKEN = r"[\x00-/:-@\[-`{-\x7f]+"
# The first range rules out most letters by one comparison.
_UNSPACED = (
    r"[\u0E00-\x{3FFFF}&&[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u3029\u3031-\u3035"
    r"\u3038-\u30FF\u3100-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\uA4CF\uA9E0-\uA9FF\uAA60-\uAA7F"
    r"\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}]]"
)


@dataclass(frozen=True)
class Seeds:
    """Items of fewer than ``long_from`` tokens have the lighter ``short_masks``, which fewer equal
    tokens fill, and those of fewer than ``tiny_below`` are looked up whole; documents are searched
    by such masks only if there are such items. Masks hold all stretches for the default ``stretch``
    and ``percent``; lower percentages need lighter masks. Seeds are broadcast up to
    ``broadcast_rows`` (about 40 bytes each) and joined by a shuffle beyond. Each copy of a document's
    tokens serves hits that are beside about ``together`` tokens."""

    masks: tuple[str, ...] = ("1110111", "11011011", "11111")
    short_masks: tuple[str, ...] = ("1111", "11011", "10111", "11101")
    long_from: int = 12
    tiny_below: int = 4
    stretch: int = 13
    percent: int = 80
    broadcast_rows: int = 500_000
    together: int = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), _UNSPACED, " $0 "), _NO_TOKEN), "")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    how: Seeds = Seeds(),
) -> DataFrame:
    """Leaking pairs (doc_id, item_id, doc_token, item_token, matched, stretch, doc, mark).

    The place is that of the best stretch, the first among equals; ``matched`` of its ``stretch``
    tokens are equal. ``doc`` and ``mark`` name the text, as ids may be null or clash. Items of one to
    three tokens leak where all of them stand side by side, which may well be by chance: leave out
    items that are no passages. Null and empty texts have no tokens and match nothing. Repeated
    documents and repeated items give their pair once.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col).cast("string")).alias("item_tokens"))
    items = items.where(F.size("item_tokens") > 0)
    # Items with the same tokens are searched once.
    items = saved_table(items.withColumn("item", F.xxhash64("item_tokens")), "leak-items")
    texts = items.groupBy("item").agg(F.first("item_tokens").alias("item_tokens"))
    size = F.size("item_tokens")
    whole = {"1" * n: texts.where(size == n) for n in range(1, how.tiny_below)}
    tiny = [_seeds(rows, "item_tokens", [mask]) for mask, rows in whole.items()]
    light = _seeds(texts.where((size >= how.tiny_below) & (size < how.long_from)), "item_tokens", how.short_masks)
    seeds = _seeds(texts.where(size >= how.long_from), "item_tokens", how.masks).union(light)
    for part in tiny:
        seeds = seeds.union(part)
    sizes = texts.select("item", size.alias("size"))
    seeds = seeds.select("seed", "mask", "item", F.col("at").alias("item_at")).join(sizes, "item")
    seeds = saved_table(seeds, "leak-seeds")
    # Documents are searched by the masks that items have.
    counts = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}
    masks = [m for m in dict.fromkeys(how.masks + how.short_masks) if m in counts]
    tiny_masks = [m for m in whole if m in counts]
    small = sum(counts.values()) <= how.broadcast_rows
    tiny_seeds = seeds.where(F.col("mask").isin(tiny_masks)).drop("mask")
    seeds = seeds.where(~F.col("mask").isin(tiny_masks)).drop("mask")
    reach = seeds.groupBy("seed").agg(F.max("size").alias("reach"))
    if small:
        seeds, reach, tiny_seeds = F.broadcast(seeds), F.broadcast(reach), F.broadcast(tiny_seeds)

    named = named_texts(docs, id_col, text_col)
    words = named.select("id", "doc", "mark", tokens(F.col("text")).alias("words"))
    keys = ["id", "doc", "mark", "item"]
    places = _seeds(words, "words", masks).join(reach, "seed").select("doc", "mark", "at", "seed", "reach").distinct()
    places = saved_table(places, "leak-places")
    hits = _unlike_places(named, places, how).join(seeds, "seed")
    hits = hits.select("doc", "mark", "item", "size", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = saved_table(hits, "leak-hits")

    def beside(hit: Column, words: Column) -> Column:
        start = F.greatest(hit["diagonal"], F.lit(0))
        return F.slice(words, start + 1, hit["diagonal"] + hit["size"] - start)

    aligned = _seen_from(named, hits, "size", how, beside, "words")
    aligned = aligned.select("id", "doc", "mark", "hit.item", "hit.diagonal", "words").join(texts, "item")
    best = _best_stretches(aligned, keys, how).where(F.col("matched") * 100 >= F.col("stretch") * how.percent)
    best = best.groupBy(*keys).agg(F.max(F.struct("matched", "before_doc", "before_item", "stretch")).alias("best"))
    if tiny_masks:
        best = best.unionByName(_whole_items(words, keys, tiny_masks, tiny_seeds))
    found = best.join(items.select("item_id", "item").distinct(), "item")
    return found.select(
        F.col("id").alias("doc_id"),
        "item_id",
        (-F.col("best.before_doc")).alias("doc_token"),
        (-F.col("best.before_item")).alias("item_token"),
        F.col("best.matched").alias("matched"),
        F.col("best.stretch").alias("stretch"),
        "doc",
        "mark",
    )


def _unlike_places(named: DataFrame, places: DataFrame, how: Seeds) -> DataFrame:
    """(doc, mark, at, seed): the first of a document's places that have a seed and all tokens
    within its reach in common, on the left as on the right."""
    def around(hit: Column, words: Column) -> Column:
        left = F.least(hit["at"], hit["reach"])
        return F.xxhash64(left, F.slice(words, hit["at"] - left + 1, left + hit["reach"]))

    seen = _seen_from(named, places, "reach", how, around, "around")
    return seen.groupBy("doc", "mark", F.col("hit.seed").alias("seed"), "around").agg(F.min("hit.at").alias("at")).drop("around")


def _seen_from(named: DataFrame, hits: DataFrame, weight: str, how: Seeds, value: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """(id, doc, mark, hit) for every hit, a struct, and the ``value`` of the hit and its document's
    tokens. Hits of a document are dealt to lists by ``weight``; the document is joined to the lists,
    and only documents that have one are cut into tokens again."""
    columns = [c for c in hits.columns if c not in ("doc", "mark")]
    lists = hits.groupBy("doc", "mark").agg(F.ceil(F.sum(weight) / how.together).alias("lists"))
    dealt = hits.join(lists, ["doc", "mark"]).withColumn("list", F.pmod(F.xxhash64(*columns), F.col("lists")))
    listed = dealt.groupBy("doc", "mark", "list").agg(F.collect_list(F.struct(*columns)).alias("hits"))
    joined = named.select("id", "doc", "mark", "text").join(saved_table(listed, "leak-lists"), ["doc", "mark"])
    each = lambda words: F.transform("hits", lambda hit: F.struct(hit.alias("hit"), value(hit, words).alias(name)))
    # The array of one binds the tokens once for all hits of the list.
    return joined.select("id", "doc", "mark", F.inline(F.flatten(F.transform(F.array(tokens(F.col("text"))), each))))


def _whole_items(words: DataFrame, keys: list[str], masks: Sequence[str], seeds: DataFrame) -> DataFrame:
    """The first place of every item of a few tokens in every document that holds all of them in a
    row. Places meet by document and item, reduced to the first one before the shuffle."""
    hits = _seeds(words, "words", masks).join(seeds, "seed")
    first = hits.groupBy(*keys).agg(F.min("at").alias("at"), F.first(F.length("mask")).alias("n"))
    place = F.struct(F.col("n").alias("matched"), (-F.col("at")).alias("before_doc"), F.lit(0).alias("before_item"), F.col("n").alias("stretch"))
    return first.select(*keys, place.alias("best"))


def remove_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    found = leaks(docs, benchmark, id_col, text_col, **options).select("doc", "mark").distinct()
    found = saved_table(found, "leak-documents")
    named = named_texts(docs, id_col, text_col, docs.columns)
    return named.join(found, ["doc", "mark"], "left_anti").select("row.*")


def _seeds(rows: DataFrame, column: str, masks: Sequence[str]) -> DataFrame:
    """``rows`` without the tokens, once for each seed, with ``mask``, ``seed`` and the position ``at``."""
    keys = [c for c in rows.columns if c != column]
    hashed = rows.select(*keys, F.transform(column, lambda t: F.xxhash64(t)).alias("hashes"))
    size = F.size("hashes")

    def under(mask: str) -> Column:
        held = [k for k, bit in enumerate(mask) if bit == "1"]
        starts = F.when(size >= len(mask), F.sequence(F.lit(0), size - len(mask))).otherwise(F.array().cast("array<int>"))
        seeds = F.transform(starts, lambda i: F.xxhash64(F.lit(mask), *[F.get("hashes", i + k) for k in held]))
        return F.struct(F.lit(mask).alias("mask"), seeds.alias("seeds"))

    none = F.array().cast("array<struct<mask:string,seeds:array<bigint>>>")
    by_mask = hashed.select(*keys, F.inline(F.array(*map(under, masks)) if masks else none))
    return by_mask.select(*keys, "mask", F.posexplode("seeds").alias("at", "seed"))


def _best_stretches(aligned: DataFrame, keys: list[str], how: Seeds) -> DataFrame:
    """Per row with item_tokens, diagonal and, as words, the tokens beside the item: ``matched`` of the ``stretch`` aligned tokens
    of the best stretch, and minus the tokens it starts at, so that the first has the maximum."""
    # Words begin with the item, or with the document if the item begins before it.
    position = lambda i: F.least(F.col("diagonal"), F.lit(0)) + i
    equal = F.transform(
        "item_tokens",
        lambda t, i: F.when(position(i) < 0, 0).otherwise(F.coalesce((F.get("words", position(i)) == t).cast("int"), F.lit(0))),
    )
    compared = aligned.select(*keys, "diagonal", equal.alias("equal"))
    stretch = F.least(F.lit(how.stretch), F.size("equal"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("equal") - stretch),
        lambda i: F.struct(
            F.aggregate(F.slice("equal", i + 1, stretch), F.lit(0), lambda a, b: a + b).alias("matched"),
            (-i).alias("before_item"),
        ),
    )
    top = compared.select(*keys, "diagonal", stretch.alias("stretch"), F.array_max(sums).alias("top"))
    return top.select(
        *keys,
        "stretch",
        "top.matched",
        "top.before_item",
        (F.col("top.before_item") - F.col("diagonal")).alias("before_doc"),
    )
