"""Building the mixed dataset: filters, samples, flags, splits, interleaving, chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.text import stable_id, text_or_empty
from tallyframe.operators.ranking import (
    mark_first,
    number_rows,
    row_hash,
    shuffle_bucket,
    shuffle_key,
    take_first,
    value_bucket,
)
from tallyframe.operators.records import join_null_safe
from tallyframe.session import saved_table


def longer_than(column: Column, chars: int) -> Column:
    return F.length(text_or_empty(column)) > chars


def hard_levels(column: Column) -> Column:
    return F.coalesce(column.isin(*fv.HARD_LEVELS), F.lit(False))


def has_text(column: Column) -> Column:
    return text_or_empty(column) != ""


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """First n rows of a seeded shuffle; rows of one key tie and are told apart by a hash."""
    order = shuffle_key(F.col(key), seed)
    return take_first(df, [], order, shuffle_bucket(order), lambda _: F.lit(n))


def label_balanced_sample(
    df: DataFrame, label: str, key: str, n: int, labels: int = 3, seed: int = 42
) -> DataFrame:
    """Sample of n rows holding at most ``n // labels + 1`` of any label.

    Walking the shuffled stream and skipping full labels keeps exactly the rows that rank within
    their label's cap, cut at n.
    """
    order = shuffle_key(F.col(key), seed)
    cap = n // labels + 1
    capped = take_first(df, [label], order, shuffle_bucket(order), lambda _: F.lit(cap))
    return seeded_sample(capped, key, n, seed)


def answerability_sample(
    df: DataFrame, answerable: str, key: str, n: int, share: float = 0.1, seed: int = 42
) -> DataFrame:
    """Sample of n rows of which a rounded share, at least one, is unanswerable."""
    unanswerable = max(1, int(round(n * share)))
    order = shuffle_key(F.col(key), seed)
    flagged = df.withColumn("_can", F.coalesce(F.col(answerable), F.lit(False)))
    quota = F.when(F.col("_can"), n - unanswerable).otherwise(unanswerable)
    taken = take_first(flagged, ["_can"], order, shuffle_bucket(order), lambda _: quota)
    return taken.drop("_can")


def flatten_evidence(evidence: Column) -> Column:
    """Third entry of each evidence item, or its JSON text, one per line."""
    return F.array_join(
        F.transform(
            evidence, lambda e: F.when(F.size(e) > 2, F.get(e, F.lit(2))).otherwise(F.to_json(e))
        ),
        "\n",
    )


def unified_rows(
    df: DataFrame,
    source: str,
    original_id: Column,
    question: Column,
    context: Column | None = None,
    gold_answer: Column | None = None,
    gold_label: Column | None = None,
    unit_tests: Column | None = None,
    metadata: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of one source in the shared schema, empty texts where a source has no value."""

    def text(value: Column | None) -> Column:
        return F.lit("") if value is None else text_or_empty(value)

    tags = F.array(*[F.lit(tag) for tag in fv.SKILL_TAGS[source]])
    return df.select(
        stable_id(F.lit(source), original_id).alias("id"),
        F.lit(source).alias("source_dataset"),
        text(question).alias("question"),
        text(context).alias("context"),
        text(gold_answer).alias("gold_answer"),
        text(gold_label).alias("gold_label"),
        text(unit_tests).alias("unit_tests"),
        tags.alias("skill_tags"),
        F.lit(False).alias("hallucination_subset"),
        F.lit("").alias("split"),
        text(original_id).alias("original_id"),
        (F.lit("{}") if metadata is None else F.to_json(metadata)).alias("metadata"),
        *keep,
    )


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def flag_subset(
    df: DataFrame,
    order: str,
    quotas: dict[str, int] | None = None,
    source: str = "source_dataset",
    key: str = "id",
    name: str = "hallucination_subset",
) -> DataFrame:
    """Flag every row whose id is among the first rows of its source, by a quota per source.

    ``order`` holds hash-led sample keys, unique inside a source.
    """
    quotas = fv.FLAGGED_PER_SOURCE if quotas is None else quotas
    quota = F.lit(0)
    for source_name, rows in quotas.items():
        quota = F.when(F.col(source) == source_name, rows).otherwise(quota)
    firsts = take_first(
        df.filter(F.col(source).isin(*quotas)).select(key, source, order),
        [source],
        F.col(order),
        shuffle_bucket(F.col(order)),
        lambda _: quota,
    )
    chosen = saved_table(firsts.select(key).distinct(), "flagged-ids")
    flagged = df.drop(name).join(chosen.withColumn(name, F.lit(True)), key, "left")
    return flagged.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def split_dev_test(
    df: DataFrame,
    key: str,
    dev_share: float = 0.6,
    seed: int = 42,
    source: str = "source_dataset",
    names: tuple[str, str] = ("dev", "mini-test"),
) -> DataFrame:
    """Exact split per source: ``floor(rows * share)`` rows of a seeded shuffle are dev.

    ``key`` is unique inside a source.
    """
    order = shuffle_key(F.col(key), seed)
    marked = mark_first(
        df,
        [source],
        order,
        shuffle_bucket(order),
        lambda total: F.floor(total * F.lit(dev_share)),
        "_dev",
    )
    split = F.when(F.col("_dev"), names[0]).otherwise(names[1])
    return marked.withColumn("split", split).drop("_dev")


def add_tag(df: DataFrame, key: str, value: object, tag: str) -> DataFrame:
    """Append a skill tag to the rows of one id."""
    tags = F.when(F.col(key) == value, F.array_append("skill_tags", F.lit(tag)))
    return df.withColumn("skill_tags", tags.otherwise(F.col("skill_tags")))


def round_robin(
    df: DataFrame, source: str, position: str, max_rows: int | None = None
) -> DataFrame:
    """One row of each source in turn, in the order sources first appear.

    With ``max_rows`` only rows up to that place inside their source can be needed; a cut-off
    per source keeps the rest out of the sort. Without it every row is numbered.
    """
    firsts = df.groupBy(source).agg(F.min(position).alias("_first_seen"))
    if max_rows is None:
        numbered = number_rows(df, [source], position, "turn")
    else:
        candidates = take_first(
            df,
            [source],
            F.col(position),
            value_bucket(F.col(position)),
            lambda _: F.lit(max_rows),
            numeric=True,
        )
        turn = F.row_number().over(W.partitionBy(source).orderBy(position))
        numbered = candidates.withColumn("turn", turn)
    firsts = saved_table(firsts, "first-seen")
    placed = join_null_safe(numbered, firsts, [source]).orderBy("turn", "_first_seen")
    if max_rows is not None:
        placed = placed.limit(max_rows)
    return placed.drop("_first_seen")


def chunk_rows(
    df: DataFrame,
    groups: Sequence[str],
    position: str,
    batch_size: int,
    max_rows: int | None = None,
) -> DataFrame:
    """Batch number of each row, ``batch_size`` rows per batch inside each group."""
    if max_rows is not None:
        df = take_first(
            df,
            groups,
            F.col(position),
            value_bucket(F.col(position)),
            lambda _: F.lit(max_rows),
            numeric=True,
        )
    numbered = number_rows(df, groups, position, "_rn")
    return numbered.withColumn(
        "batch_id", F.floor((F.col("_rn") - 1) / batch_size).cast("long")
    ).drop("_rn")


def dataset_subset(
    df: DataFrame, names: Sequence[str] | None = None, column: str = "source_dataset"
) -> DataFrame:
    """Rows of the named datasets; all rows without names."""
    if not names:
        return df
    wanted = sorted({name.strip().lower() for name in names})
    return df.filter(F.lower(column).isin(*wanted))


def tail_rows(df: DataFrame, position: str, n: int = 2) -> DataFrame:
    """Last rows, the very last first."""
    return df.orderBy(F.col(position).desc()).limit(n)


def _given(raw: DataFrame, *paths: str) -> Column:
    """The first of the (nested) columns that the table has, null when it has none."""
    for path in paths:
        kind = raw.schema
        for part in path.split("."):
            fields = getattr(kind, "fields", [])
            kind = next((f.dataType for f in fields if f.name == part), None)
        if kind is not None and not isinstance(kind, T.StructType):
            return F.col(path)
    return F.lit(None).cast("string")


def _as_text(raw: DataFrame, *paths: str) -> Column:
    """Text of a column; lists and structs as JSON."""
    value = _given(raw, *paths)
    kind = raw.select(value.alias("v")).schema["v"].dataType
    nested = isinstance(kind, T.ArrayType | T.MapType)
    return text_or_empty(F.to_json(value) if nested else value)


def _evidence(raw: DataFrame) -> Column:
    value = _given(raw, "evidence", "context")
    kind = raw.select(value.alias("v")).schema["v"].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    return flatten_evidence(value) if nested else _as_text(raw, "evidence", "context")


@dataclass(frozen=True)
class Source:
    """How one benchmark's own rows are filtered, sampled and mapped.

    ``stratum`` names the part of the sample a row competes in and ``quota`` the rows of each part
    for a sample of n; the sample as a whole holds n rows at most. ``columns`` are the arguments of
    ``unified_rows``. Rows may have the source's own nested shape or flat columns.
    """

    usable: Callable[[DataFrame], Column]
    stratum: Callable[[DataFrame], Column]
    quota: Callable[[int, Column], Column]
    columns: Callable[[DataFrame], dict[str, Column]]


def _one_stratum(_: DataFrame) -> Column:
    return F.lit("all")


def _whole(n: int, _: Column) -> Column:
    return F.lit(n)


def _answerable(raw: DataFrame) -> Column:
    return F.coalesce(_given(raw, "answerable").cast("boolean"), F.lit(False))


def _unanswerable_share(n: int, stratum: Column) -> Column:
    unanswerable = max(1, int(round(n * 0.1)))
    return F.when(stratum == "true", n - unanswerable).otherwise(unanswerable)


SOURCES = {
    "MuSiQue": Source(
        lambda raw: longer_than(_given(raw, "question"), fv.MIN_QUESTION_LENGTH),
        lambda raw: _answerable(raw).cast("string"),
        _unanswerable_share,
        lambda raw: {
            "original_id": _given(raw, "id", "original_id"),
            "question": _given(raw, "question"),
            "context": _as_text(raw, "paragraphs", "context"),
            "gold_answer": _given(raw, "answer"),
            "metadata": F.struct(_answerable(raw).alias("answerable")),
        },
    ),
    "QuALITY": Source(
        lambda raw: has_text(_given(raw, "document.summary.text", "context")),
        _one_stratum,
        _whole,
        lambda raw: {
            "original_id": _given(raw, "document.id", "original_id"),
            "question": _given(raw, "question.text", "question"),
            "context": _given(raw, "document.summary.text", "context"),
            "gold_answer": _as_text(raw, "answers", "answer"),
        },
    ),
    "FEVER": Source(
        lambda raw: longer_than(_given(raw, "claim", "question"), fv.MIN_CLAIM_LENGTH),
        lambda raw: text_or_empty(_given(raw, "label")),
        lambda n, _: F.lit(n // 3 + 1),
        lambda raw: {
            "original_id": _given(raw, "id", "original_id"),
            "question": _given(raw, "claim", "question"),
            "context": _evidence(raw),
            "gold_answer": _given(raw, "label"),
            "gold_label": _given(raw, "label"),
        },
    ),
    "HARDMATH": Source(
        lambda raw: hard_levels(_given(raw, "level")),
        _one_stratum,
        _whole,
        lambda raw: {
            "original_id": _given(raw, "unique_id", "original_id"),
            "question": _given(raw, "problem", "question"),
            "gold_answer": _given(raw, "solution", "answer"),
        },
    ),
    "HumanEvalPlus": Source(
        lambda raw: F.lit(True),
        _one_stratum,
        _whole,
        lambda raw: {
            "original_id": _given(raw, "task_id", "original_id"),
            "question": _given(raw, "prompt", "question"),
            "gold_answer": _given(raw, "canonical_solution", "answer"),
            "unit_tests": _given(raw, "test", "unit_tests"),
            "metadata": F.struct(text_or_empty(_given(raw, "entry_point")).alias("entry_point")),
        },
    ),
}


def source_rows(raw: DataFrame, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """All rows of one benchmark in the shared schema."""
    return unified_rows(raw, source, keep=keep, **SOURCES[source].columns(raw))


def sample_sources(
    raw_by_source: dict[str, DataFrame], n: int = 100, seed: int = 42, key: str = "row_ordinal"
) -> DataFrame:
    """Unified samples of n rows per source, with their ``sample_order``.

    The tables are scanned once for keys, strata and filters; all quotas are cut off together, and
    only the chosen rows are read again with their texts, in one pass over all sources.
    """
    chosen = _chosen_rows(raw_by_source, n, seed, key)
    return _fetched(raw_by_source, chosen, key).select("*", "_chosen.sample_order").drop("_chosen")


def _chosen_rows(
    raw_by_source: dict[str, DataFrame], n: int, seed: int, key: str, dev_share: float = 0.0
) -> DataFrame:
    """The sample's rows by source, key and stratum: an array of the places, orders and splits of the
    rows that share them."""
    slim = union_sources(
        [
            raw.filter(SOURCES[name].usable(raw)).select(
                F.lit(name).alias("_source"),
                SOURCES[name].stratum(raw).alias("_stratum"),
                shuffle_key(F.col(key), seed).alias("_order"),
                F.col(key).cast("string").alias("_key"),
            )
            for name, raw in raw_by_source.items()
        ]
    )
    quota = F.lit(0)
    for name in raw_by_source:
        mine = F.col("_source") == name
        quota = F.when(mine, SOURCES[name].quota(n, F.col("_stratum"))).otherwise(quota)
    slim = saved_table(slim, "sample-keys").withColumnRenamed("_order", "sample_order")
    order = F.col("sample_order")
    firsts = take_first(slim, ["_source", "_stratum"], order, shuffle_bucket(order), lambda _: quota)
    # A few quotas per source are left, of which n rows stay.
    source = W.partitionBy("_source")
    placed = firsts.withColumn("place", F.row_number().over(source.orderBy("sample_order", "_stratum")))
    placed = placed.filter(F.col("place") <= n)
    second = source.orderBy(shuffle_key(F.col("sample_order"), seed), "place")
    dev = F.row_number().over(second) <= F.floor(F.count("*").over(source) * F.lit(dev_share))
    row = F.struct("place", "sample_order", "dev")
    grouped = placed.withColumn("dev", dev).groupBy("_source", "_key", "_stratum").agg(
        F.array_sort(F.collect_list(row)).alias("_rows")
    )
    return saved_table(grouped, "sample-chosen")


def _fetched(raw_by_source: dict[str, DataFrame], chosen: DataFrame, key: str) -> DataFrame:
    """The chosen rows in the shared schema, each with its ``_chosen`` place, order and split."""
    parts = []
    for name, raw in raw_by_source.items():
        mine = chosen.filter(F.col("_source") == name).select("_key", "_stratum", "_rows")
        named = {"_key": F.col(key).cast("string"), "_stratum": SOURCES[name].stratum(raw)}
        keyed = raw.filter(SOURCES[name].usable(raw)).withColumns(named)
        # Rows of one key are told apart by a hash; no more of them stay than were chosen.
        same = W.partitionBy("_key", "_stratum").orderBy(row_hash(raw))
        rows = join_null_safe(keyed, mine, ["_key", "_stratum"]).withColumn("_nth", F.row_number().over(same))
        rows = rows.withColumn("_chosen", F.get("_rows", F.col("_nth") - 1)).filter("_chosen IS NOT NULL")
        parts.append(source_rows(rows, name, keep=("_chosen",)))
    return union_sources(parts)


def build_mixed_dataset(
    raw_by_source: dict[str, DataFrame],
    rows_per_source: int = 100,
    dev_share: float = 0.6,
    seed: int = 42,
    key: str = "row_ordinal",
    flagged: dict[str, int] | None = None,
) -> DataFrame:
    """Sample every source, unite, flag the hallucination subset and split per source.

    Places in the sample settle all three, so that flags and splits need no further pass; they are
    those of ``flag_subset`` and ``split_dev_test`` on the united sample.
    """
    chosen = _chosen_rows(raw_by_source, rows_per_source, seed, key, dev_share)
    mixed = _fetched(raw_by_source, chosen, key)
    quota = F.lit(0)
    for name, rows in (fv.FLAGGED_PER_SOURCE if flagged is None else flagged).items():
        quota = F.when(F.col("source_dataset") == name, rows).otherwise(quota)
    # Every row of a flagged id is flagged.
    first = F.max(F.col("_chosen.place") <= quota).over(W.partitionBy("id"))
    split = F.when(F.col("_chosen.dev"), "dev").otherwise("mini-test")
    return mixed.withColumns({"hallucination_subset": first, "split": split}).drop("_chosen")
