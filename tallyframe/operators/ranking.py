"""Ranks inside groups of any size.

A ``row_number`` window over a handful of huge groups (five datasets, three policies) would put
each group into one task. The operators here first count rows per order-preserving bucket,
which partial aggregation keeps cheap, and only look at single rows inside the one bucket that
matters. Row numbers come from a range partitioning: counts per range, offsets, and numbers inside
each range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators.records import join_null_safe
from tallyframe.session import saved_table

def shuffle_key(key: Column, seed: int) -> Column:
    """Seeded pseudo-random sort key that does not depend on the partitioning."""
    text = key.cast("string")
    return F.concat_ws("_", F.md5(F.concat_ws("_", F.lit(str(seed)), text)), text)


def shuffle_bucket(order: Column) -> Column:
    """4096 even buckets, sorted like the hash-led keys they come from."""
    return F.substring(order, 1, 3)


def value_bucket(value: Column) -> Column:
    """Monotone logarithmic bucket of a number, about 0.1 % wide above 0.001."""
    size = F.floor(F.log1p(F.abs(value) * 1000) * 1024).cast("long")
    return F.when(value < 0, -size - 1).otherwise(size)


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    bucket: Column,
    ranks: dict[str, Callable[[Column], Column]],
    numeric: bool = False,
) -> DataFrame:
    """The order value at given ranks of each group, exact for any group size.

    ``ranks`` maps an output column to a function from the group's row count to a rank, which may
    also use the group columns. Ranks past the end give the last value, below one they give null.
    ``<name>_at`` is the place of the rank among the rows that tie with that value, from 1, and
    ``<name>_of`` the number of those rows.
    A ``numeric`` order may crowd into one bucket; the bucket that is hit is then cut once more
    into even steps between its own extremes.
    """
    groups = list(groups)
    keys = [*groups, "_bucket"]
    slim = df.select(*groups, order.alias("_key"), bucket.alias("_bucket")).filter(
        F.col("_key").isNotNull()
    )
    per_bucket = slim.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")
    )
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    total = F.sum("_n").over(whole)
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.least(rank(total).cast("long"), total).alias("rank"),
            )
            for name, rank in ranks.items()
        ]
    )
    counted = (
        per_bucket.withColumn("_upto", F.sum("_n").over(running(whole, "_bucket")))
        .withColumn("_ranks", wanted)
        .withColumn("_wanted", F.explode("_ranks"))
        .withColumn("_rank", F.col("_wanted.rank"))
    )
    hits = saved_table(
        at_rank(counted).select(
            *keys, F.col("_wanted.name").alias("_name"), "_rank", "_lo", "_hi"
        ),
        "rank-buckets",
    )
    inside = join_null_safe(slim, hits, keys)
    place = [*keys, "_name"]
    if numeric:
        span = F.col("_hi") - F.col("_lo")
        step = F.floor(F.try_divide(F.col("_key") - F.col("_lo"), span) * 4095)
        inside = inside.withColumn("_step", F.coalesce(step, F.lit(0)).cast("long"))
        per_step = inside.groupBy(*place, "_rank", "_step").agg(F.count("*").alias("_n"))
        stepped = per_step.withColumn(
            "_upto", F.sum("_n").over(running(W.partitionBy(*place), "_step"))
        )
        finer = saved_table(at_rank(stepped).select(*place, "_rank", "_step"), "rank-steps")
        place = [*place, "_step"]
        inside = join_null_safe(inside.drop("_rank"), finer, place)
    per_key = inside.groupBy(*place, "_rank", "_key").agg(F.count("*").alias("_n"))
    ranked = per_key.withColumn(
        "_upto", F.sum("_n").over(running(W.partitionBy(*place), "_key"))
    )
    return (
        at_rank(ranked)
        .groupBy(*groups)
        .agg(
            *[
                F.max(F.when(F.col("_name") == name, F.col(column))).alias(name + suffix)
                for name in ranks
                for column, suffix in (("_key", ""), ("_rank", "_at"), ("_n", "_of"))
            ]
        )
    )


def running(window: W, order: str):
    """The window from its first row to the current one."""
    return window.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def at_rank(counted: DataFrame) -> DataFrame:
    """The counted piece that holds the rank, which becomes a rank inside the piece."""
    before = F.col("_upto") - F.col("_n")
    return counted.filter(
        (F.col("_rank") > before) & (F.col("_rank") <= F.col("_upto"))
    ).withColumn("_rank", F.col("_rank") - before)


def row_hash(df: DataFrame) -> Column:
    """A number from all columns of a row; maps, which have no hash, by their JSON text."""
    parts = [F.to_json(name) if "map<" in kind else F.col(name) for name, kind in df.dtypes]
    return F.xxhash64(*parts)


def take_first(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    bucket: Column,
    quota: Callable[[Column], Column],
    numeric: bool = False,
) -> DataFrame:
    """First rows of each group, exactly up to a quota that may depend on the group's size.

    Rows that tie with the cut-off are told apart by a hash of the whole row, whose own cut-off is
    found in the same way; equal rows count as one with a number of copies. So no task sees all
    rows of a value. Without such ties the rows are scanned once more and only filtered.
    """
    placed, torn = _placed(df, groups, order, bucket, quota, numeric)
    taken = placed.filter(_surely_first(torn)).select(df.columns)
    if not torn:
        return taken
    copies = _copies(placed, groups, df.columns, lambda n: F.col("_tie_at"))
    return taken.unionByName(copies.select(df.columns))


def mark_first(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    bucket: Column,
    quota: Callable[[Column], Column],
    name: str,
) -> DataFrame:
    """Keep every row and say in ``name`` whether it is among the first of its group, of which exactly
    the quota are; ties as in ``take_first``."""
    placed, torn = _placed(df, groups, order, bucket, quota)
    taken = F.coalesce(_surely_first(torn), F.lit(False)).alias(name)
    if not torn:
        return placed.select(*df.columns, taken)
    clear = placed.filter(~F.coalesce(F.col("_hash") == F.col("_tie"), F.lit(False)))
    copies = _copies(placed, groups, df.columns, lambda n: n)
    marked = copies.select(*df.columns, (F.col("_copy") <= F.col("_tie_at")).alias(name))
    return clear.select(*df.columns, taken).unionByName(marked)


def _surely_first(torn: bool) -> Column:
    """Whether a row is among the first, whichever of the rows at a torn cut-off are taken."""
    if not torn:
        return F.col("_order") <= F.col("_cutoff")
    at_cutoff = F.col("_tie").isNull() | (F.col("_hash") < F.col("_tie"))
    return (F.col("_order") < F.col("_cutoff")) | ((F.col("_order") == F.col("_cutoff")) & at_cutoff)


# Rows that a task makes from one row and its count.
_COPIES = 10_000


def _copies(placed: DataFrame, groups: Sequence[str], columns: Sequence[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """The equal rows that the cut-off falls into, counted, and as many of them written out again as
    are wanted of their number, over several tasks. ``_copy`` numbers them."""
    equal = placed.filter(F.col("_hash") == F.col("_tie"))
    one = equal.groupBy(*groups, "_hash", "_tie_at").agg(
        F.first(F.struct(*columns)).alias("_row"), F.count("*").alias("_n")
    )
    blocks = F.explode(F.sequence(F.lit(0), F.floor((wanted(F.col("_n")) - 1) / _COPIES)))
    dealt = one.withColumn("_block", blocks).repartition("_hash", "_block")
    last = F.least(wanted(F.col("_n")), (F.col("_block") + 1) * _COPIES)
    copies = dealt.withColumn("_copy", F.explode(F.sequence(F.col("_block") * _COPIES + 1, last)))
    return copies.select("_row.*", "_copy", "_tie_at")


def _placed(
    df: DataFrame,
    groups: Sequence[str],
    order: Column,
    bucket: Column,
    quota: Callable[[Column], Column],
    numeric: bool = False,
) -> tuple[DataFrame, bool]:
    """The rows with their order and their group's cut-off, and whether some group takes only part of
    the rows at its cut-off. Then these have a hash, and the cut-off among the hashes."""
    columns = df.columns
    one = [] if groups else ["_one"]
    df = df.withColumn("_one", F.lit(1)) if one else df
    keys = [*groups, *one]
    cutoffs = order_statistics(df, keys, order, bucket, {"_cutoff": quota}, numeric)
    cutoffs = saved_table(cutoffs, "cutoffs")
    joined = join_null_safe(df.withColumn("_order", order), cutoffs, keys, "left")
    torn = cutoffs.filter("_cutoff_at < _cutoff_of")
    if torn.isEmpty():
        return joined, False
    hashed = row_hash(df.select(columns))
    some = join_null_safe(df.withColumn("_order", order), torn, keys)
    ties = order_statistics(
        some.filter(F.col("_order") == F.col("_cutoff")),
        [*keys, "_cutoff_at"],
        hashed,
        F.shiftright(hashed, 52),
        {"_tie": lambda _: F.col("_cutoff_at")},
    )
    ties = saved_table(ties.select(*keys, "_tie", "_tie_at"), "ties")
    placed = join_null_safe(joined, ties, keys, "left")
    return placed.withColumn("_hash", F.when(F.col("_order") == F.col("_cutoff"), hashed)), True


def number_rows(df: DataFrame, groups: Sequence[str], position: str, name: str) -> DataFrame:
    """Dense row numbers from 1 inside each group, in the order of a column of any values.

    Rows are dealt by ranges of group and position and written with their range; a row's number is
    its place in the range plus the rows of its group in earlier ranges. Only the counts per range
    meet in one window. Rows of one position go by a hash of the row, so that they can be dealt too.
    """
    hashed = df.withColumn("_hash", row_hash(df))
    ranged = hashed.repartitionByRange(*groups, position, "_hash").withColumn("_range", F.spark_partition_id())
    ranged = saved_table(ranged, "ranged")
    keys = [*groups, "_range"]
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*keys).orderBy(position, "_hash")
    return (
        join_null_safe(ranged, saved_table(offsets, "offsets"), keys)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_range", "_offset", "_hash")
    )


def exact_median(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Median per group without collecting a group's values."""
    number = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    middle = order_statistics(
        df,
        groups,
        number,
        value_bucket(number),
        {
            "_low": lambda total: F.floor((total + 1) / 2),
            "_high": lambda total: F.floor(total / 2) + 1,
        },
        numeric=True,
    )
    return middle.select(*groups, ((F.col("_low") + F.col("_high")) / 2).alias(name))
