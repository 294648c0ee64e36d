"""Graded quality by ordinal regression on hashed text.

A cumulative-link model: grades 0..K-1 share one weight vector w over hashed text features, and
ordered thresholds b_1 < ... < b_{K-1} part the grades,

    P(grade >= k) = sigmoid(w . x - b_k).

The expected grade is the sum of these tail probabilities, and the tail at a chosen grade selects
documents. Features are the distinct lower-cased words of the whole text, without punctuation at
their ends, and the distinct last two bytes of the words as they are. A feature's value is how far
the mean grade of the documents with it lies from the mean of all, shrunk where these are few; a
document's values are brought to about length 1. So common words have next to no value. Weights are fitted by rounds of adaptive stochastic gradients inside Spark's
partitions with the parameters averaged in between, so a round sends one parameter vector per
partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.grouped import hash_share, others, packed
from tallyframe.llm.wordscan import mix, scan, slices
from tallyframe.session import saved_table


@dataclass(frozen=True)
class Fitting:
    """``rows``: about so many rated documents are learned from, or all if there are fewer, those
    with the smallest hash of their id, dealt to ``partitions``. ``bits``: 2 ** bits hashed
    features, of which those in fewer than ``least_rows`` of the sampled documents have no value.
    ``shrink``: the value of a feature in so many documents is halved."""

    rows: int = 20_000
    partitions: int = 4
    rounds: int = 5
    bits: int = 20
    least_rows: int = 5
    shrink: float = 30.0
    rate: float = 0.3


@dataclass(frozen=True)
class Grader:
    weights: np.ndarray
    values: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rated: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", how: Fitting = Fitting()) -> Grader:
    """Learn from rows with an id, a text and a grade in 0..grades-1; others are left out, and an id
    that occurs several times counts once, with its lowest grade. Without any such row all weights
    are 0 and the thresholds even."""
    rows = rated.select(F.col(id_col).alias("doc"), F.col(grade_col).cast("int").alias("grade"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("doc").isNotNull() & F.col("text").isNotNull() & F.col("grade").between(0, grades - 1))
    graded = rows.groupBy("doc").agg(F.min("grade").alias("grade"))
    chosen = graded.where(hash_share(F.col("doc")) * max(1, graded.count()) < how.rows)
    chosen = saved_table(chosen.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc"), F.lit(how.partitions))), "grading-sample")
    kind = "doc long, part long, grade int, features array<int>"
    sparse = rows.select("doc", "text").join(chosen, "doc").mapInArrow(_sparse(how), kind).dropDuplicates(["doc"])
    sparse = saved_table(sparse, "grading-features")

    # At most 2 ** bits features come to the driver, like the weights.
    mean = sparse.agg(F.avg("grade")).first()[0] or 0.0
    seen = sparse.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("grade").alias("sum")
    )
    seen = seen.where(F.col("n") >= how.least_rows).toPandas().sort_values("feature")
    common = seen["feature"].to_numpy(np.int64)
    values = np.zeros(1 << how.bits, np.float32)
    values[common] = ((seen["sum"] - seen["n"] * mean).abs() / (seen["n"] + how.shrink)).to_numpy()
    state = np.concatenate([np.zeros(len(common)), np.arange(grades - 1) - (grades - 2) / 2])
    dealt = sparse.repartition(how.partitions, "part").sortWithinPartitions("part", "doc")
    for number in range(how.rounds):
        sent = dealt.mapInArrow(_learn(state, common, values, grades, number, how), "rows long, state binary").collect()
        found = [(r["rows"], np.frombuffer(r["state"], np.float64)) for r in sent]
        total = sum(n for n, _ in found)
        if not total:
            break
        state = sum(n * s for n, s in found) / total
    weights = np.zeros(1 << how.bits, np.float32)
    weights[common] = state[: len(common)]
    return Grader(weights, values, np.sort(state[len(common) :]))


def grade(docs: DataFrame, grader: Grader, at_least: int, keep_from: float = 0.5, text_col: str = "text", how: Fitting = Fitting()) -> DataFrame:
    """``docs`` without its text, with ``expected_grade``, ``tail`` and ``kept``; columns of these
    names are replaced.

    ``tail`` is P(grade >= at_least), and kept says whether it is ``keep_from`` or more. A null or
    empty text has no features: it gets the model's prior.
    """
    carried = others(docs, text_col, "expected_grade", "tail", "kept")
    rows = docs.select(packed(carried), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                scores = _scores(part.column("text"), grader, how)
                tails = grader.tails(scores)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(tails.sum(1)), pa.array(tails[:, at_least - 1])], ["row", "expected_grade", "tail"]
                )

    row = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row}, expected_grade double, tail double")
    return out.select(*[F.col("row")[c].alias(c) for c in carried], "expected_grade", "tail", (F.col("tail") >= keep_from).alias("kept"))


def _features(texts: pa.Array, how: Fitting) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text and their texts, in the order of the texts."""
    words = scan(texts)
    text = words.text_index().astype(np.uint64)
    last = words.data[words.ends - 1].astype(np.uint64) << np.uint64(8)
    last |= words.data[np.maximum(words.ends - 2, words.starts)]
    every = np.concatenate([mix(words.trimmed().hashes(lower=True)), mix(last + np.uint64(1 << 20))]) >> np.uint64(64 - how.bits)
    distinct = np.unique(np.concatenate([text, text]) << np.uint64(how.bits) | every)
    return (distinct & np.uint64((1 << how.bits) - 1)).astype(np.int64), (distinct >> np.uint64(how.bits)).astype(np.int64)


def _length(squares: np.ndarray) -> np.ndarray:
    """What a document's values are divided by, from the sum of their squares."""
    return np.sqrt(squares + 0.1)


def _scores(texts: pa.Array, grader: Grader, how: Fitting) -> np.ndarray:
    features, text = _features(texts, how)
    values = grader.values[features].astype(float)
    sums = np.bincount(text, grader.weights[features] * values, minlength=len(texts))
    return sums / _length(np.bincount(text, values * values, minlength=len(texts)))


def _sparse(how: Fitting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                features, text = _features(part.column("text"), how)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(features.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "part", "grade")), lists], ["doc", "part", "grade", "features"])

    return run


def _learn(start: np.ndarray, common: np.ndarray, values: np.ndarray, grades: int, number: int, how: Fitting):
    """One round over a partition: per row, the gradient of the cumulative logistic losses."""
    known = values[common].astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = start[: len(common)].copy(), start[len(common) :].copy()
        squares = np.full(len(common), 0.01)
        levels = np.arange(1, grades)
        rows = 0
        for batch in batches:
            for features, grade in zip(batch.column("features"), batch.column("grade").to_pylist()):
                held = features.values.to_numpy()
                at = np.searchsorted(common, held)
                at = at[common[np.minimum(at, len(common) - 1)] == held] if len(common) else at[:0]
                x = known[at] / _length(known[at] @ known[at])
                tails = 1 / (1 + np.exp(-np.clip(weights[at] @ x - thresholds, -40, 40)))
                error = tails - (grade >= levels)
                slope = error.sum() * x
                squares[at] += slope * slope
                weights[at] -= how.rate * slope / np.sqrt(squares[at])
                thresholds += 0.05 * error / (1 + number)
                thresholds.sort()
                rows += 1
        if rows:
            state = np.concatenate([weights, thresholds])
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([state.tobytes()], pa.binary())], ["rows", "state"])

    return run
