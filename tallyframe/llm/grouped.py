"""Helpers for work on groups: streams of sorted groups, groups cut into blocks, fresh names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but the named ones. Operators carry these along; a column that has the
    name of an output gives way to it."""
    named = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in named]


def packed(columns: Sequence[str]) -> Column:
    """A struct ``row`` of the columns, which may be none."""
    return F.struct(*(columns or [F.lit(0).alias("none")])).alias("row")


def hash_share(key: Column) -> Column:
    """A uniform number in [0, 1) from a key. Rows below n / count are a sample of about n rows that
    does not depend on partitions and needs no sort."""
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    together: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Apply ``work`` to the rows of each key, or ``together`` to several whole groups at a time.
    Keys are integers without nulls.

    Rows are dealt by key and sorted in their partition, so that groups pass as a stream and one
    group at a time is in memory. Callers keep groups bounded, see ``in_blocks``. ``partitions`` is
    for work whose cost does not show in the size of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            whole = _joined(held)
            cuts = _cuts(whole, keys)
            yield from _results(work, whole, [0, cuts[-1]] if together else cuts)
            held = [whole.slice(cuts[-1])]
        if held:
            whole = _joined(held)
            cuts = [0] if together else _cuts(whole, keys)
            yield from _results(work, whole, [*cuts, whole.num_rows])

    dealt = df.repartition(*keys) if partitions is None else df.repartition(partitions, *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def in_blocks(members: DataFrame, sizes: DataFrame, keys: Sequence[str], by: str, limit: int) -> DataFrame:
    """Cut each group into blocks of about ``limit`` rows and pair the blocks with each other.

    ``sizes`` has the row count ``n`` of each key. A row of block i appears once for every pair of
    blocks that i is part of; the result has columns ``lo``, ``hi`` and ``block``. A group of any
    size thus becomes tasks of at most two blocks.
    """
    blocks = F.ceil(F.col("n") / limit).cast("int")
    return (
        members.join(sizes, list(keys))
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("n", "blocks", "other")
    )


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    held = [b for b in held if b.num_rows] or held[:1]
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _cuts(batch: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    if not batch.num_rows:
        return [0]
    change = np.zeros(batch.num_rows - 1, bool)
    for key in keys:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        change |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist()]


def _results(work, batch: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
    done = []
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        out = work(batch.slice(lo, hi - lo))
        if out is not None and out.num_rows:
            done.append(out)
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def named_texts(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` as (id, doc, mark, text) and a struct ``row`` of the ``carry`` columns.

    doc and mark hold no null and together name a row's text, also where ids are null or clash.
    """
    text = F.col(text_col).cast("string")
    columns = [
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(F.col(id_col).isNull(), text).alias("mark"),
        text.alias("text"),
    ]
    return docs.select(*columns, *([packed(carry)] if carry is not None else []))
