"""Key handling shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(value: Column, order: Column, where: Column | None = None) -> Column:
    """The value of the last row by ``order``, a null order coming first; aggregate.

    Inside a struct a null order is smallest but still counts, so that a row is never lost.
    """
    place = F.struct(order)
    return F.max_by(value, place if where is None else F.when(where, place))


def latest(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Last row per key by ``order``, with the columns ``values`` or all.

    An aggregate rather than a ranking window: each map task already reduces a hot key to one
    row, so duplicates never meet in a single task. A null order comes first.
    """
    kept = [name for name in (df.columns if values is None else values) if name not in keys]
    return (
        df.groupBy(*keys)
        .agg(last_by(F.struct(*kept), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that also pairs null keys; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_right_{key}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_right_{key}" for key in keys])


def merge_maps(defaults: Column, overrides: Column) -> Column:
    """Map union where the overrides win."""
    empty = F.create_map().cast("map<string,string>")
    low = F.coalesce(defaults, empty)
    high = F.coalesce(overrides, empty)
    kept = F.map_filter(low, lambda key, _: ~F.map_contains_key(high, key))
    return F.map_concat(kept, high)


def add_known(*values: Column) -> Column:
    """Sum of the values that are known; null only when none is."""
    total = F.lit(None)
    for value in values:
        total = F.when(total.isNull() & value.isNull(), None).otherwise(
            F.coalesce(total, F.lit(0)) + F.coalesce(value, F.lit(0))
        )
    return total


def sum_known(values: Column) -> Column:
    """Null-skipping sum over an array; null when it holds no value."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("double"), lambda a, v: a + v))
