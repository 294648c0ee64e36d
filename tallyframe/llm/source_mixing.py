"""Mix sources to target weights: whole epochs first, then a weighted sample without replacement.

Every document has an exponential key -ln(u) / weight, u a hash of its id and text; in the order of the keys
documents are a weighted sample without replacement (Efraimidis and Spirakis 2006). A source with
target t and size s gives floor(t / s) whole epochs, and of one more epoch the documents of the
smallest keys, up to the words that are left; the last of them gives only its first words.

Everything is DataFrame functions. A source's documents are cut into slots by a monotone function
of the key, so that the prefix sums of one huge source run in many tasks: sums in slots, sums over
the slots of a source, and their total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.session import saved_table

WORD = r"[^\x20\x09-\x0D]+"
SLOT_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float | None = None, most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight`` and ``target`` in words.

    Sources in code point order, null last, have the weights in turn, repeating. They share
    ``total``, all words by default. A target stops at ``most`` times its source's size and the
    rest is shared again by weight until none is above: target = min(most * size, weight * level),
    where level solves for the total. With the sources ordered by most * size / weight, those that
    stop come first, so running sums give the level. Both orders run over the source table alone,
    a row per source. An empty table gives an empty one, and sources of no words the target 0.
    """
    one = F.lit(0)
    by_name = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    stop = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("stop", stop).withColumn("ratio", F.col("stop") / F.col("weight"))
    order = W.partitionBy(one).orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(one)
    to_share = F.sum("source_size").over(everything) if total is None else F.lit(float(total))
    level = (to_share - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The first source in this order that the level does not reach settles it for all that follow.
    ranked = ranked.withColumn("level", level)
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)
    target = F.least(F.col("stop"), F.col("weight") * F.coalesce(settled["level"], F.lit(float("inf"))))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    quality: DataFrame | None = None,
    total: float | None = None,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, epochs, part, taken.

    The mix holds the whole document ``epochs`` times and its first ``part`` words once more;
    ``taken`` is the sum in words. ``quality`` (doc_id, quality) gives sampling weights: the largest
    of a document, and 1 where there is none or it is not positive. Reruns agree: keys depend on
    the seed, the id, the text and, for rows equal in these, a number, so that rows without an id or
    of one id are drawn one by one. Rows without words take 0.
    """
    text = F.col(text_col).cast("string")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.md5(F.coalesce(text, F.lit(""))).alias("mark"),
    )
    # Equal rows are counted before anything is shuffled, and numbered when they are written out again.
    sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("copies"))
    weight = F.lit(1.0)
    if quality is not None:
        best = quality.where("quality > 0").groupBy("doc_id").agg(F.max("quality").cast("double").alias("weight"))
        sized = sized.join(best, "doc_id", "left")
        weight = F.coalesce("weight", F.lit(1.0))
    copies = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark", F.col("copy").cast("string"))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = saved_table(copies.select("doc_id", "source", "size", (-F.log(u) / weight).alias("key")), "mix-keys")

    sums = keyed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.avg("key").alias("mean_key")
    )
    sums = saved_table(sums, "mix-sources")
    targets = source_targets(sums.select("source", "source_size"), weights, total)
    plan = targets.join(sums.select("source", "rows", "mean_key"), targets["source"].eqNullSafe(sums["source"])).select(
        targets["source"].alias("of"), "source_size", "target", "rows", "mean_key"
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", whole)
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = saved_table(plan, "mix-plan")

    # Keys are near exponential with the source's mean, so slots of 1 - exp(-key / mean) are even.
    slots = F.ceil(F.col("rows") / SLOT_ROWS)
    slot = F.floor((1 - F.exp(-F.col("key") / F.col("mean_key"))) * slots).cast("long")
    placed = keyed.join(plan, keyed["source"].eqNullSafe(plan["of"])).withColumn("slot", F.coalesce(slot, F.lit(0)))
    slot_sums = placed.groupBy("of", "slot").agg(F.sum("size").alias("slot_size"))
    earlier = W.partitionBy("of").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slot_sums = slot_sums.select(
        F.col("of").alias("slot_of"), F.col("slot").alias("slot_no"), F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)).alias("base")
    )
    same_slot = placed["of"].eqNullSafe(slot_sums["slot_of"]) & (placed["slot"] == slot_sums["slot_no"])
    order = W.partitionBy("of", "slot").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("base") + F.sum("size").over(order)
    mixed = placed.join(slot_sums, same_slot).withColumn("end", end)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - (F.col("end") - F.col("size"))))
    mixed = mixed.withColumn("part", part.cast("long"))
    return mixed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )
