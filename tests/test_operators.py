"""Operators against brute force on small fixtures."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.operators import (
    cases,
    comparison,
    council,
    leaderboard,
    predictions,
    ranking,
    records,
    sampling,
    scoring,
    summaries,
)
from tallyframe.sources import readers


@pytest.fixture(scope="module")
def skewed(spark):
    """Most rows in one group, values with ties."""
    rng = random.Random(3)
    rows = []
    for i in range(5000):
        group = "hot" if i % 10 else rng.choice(["a", "b", None])
        rows.append((i, group, round(rng.expovariate(0.1), 1) * rng.choice([1, -1])))
    return rows, spark.createDataFrame(rows, "row_ordinal long, source_dataset string, v double")


def by_group(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    return groups


def test_exact_median(skewed):
    rows, df = skewed
    got = {r["source_dataset"]: r["m"] for r in
           ranking.exact_median(df, ["source_dataset"], "v", "m").collect()}
    want = {g: statistics.median(r[2] for r in part) for g, part in by_group(rows).items()}
    assert got == pytest.approx(want)


def test_value_bucket_is_monotone(evaluate):
    values = sorted([0.0, 1e-9, -1e-9, 1e-3, 0.5, 0.51, 1.0, 7.0, 1e6, 1e12, -3.0, -1e7, 2.5])
    buckets = evaluate(ranking.value_bucket, values, "v double")
    assert buckets == sorted(buckets)


def test_split_sizes_and_stability(skewed):
    rows, df = skewed
    once = sampling.split_dev_test(df, "row_ordinal").collect()
    again = sampling.split_dev_test(df.repartition(7), "row_ordinal").collect()
    assert {(r["row_ordinal"], r["split"]) for r in once} == {
        (r["row_ordinal"], r["split"]) for r in again
    }
    for group, part in by_group(rows).items():
        dev = [r for r in once if r["source_dataset"] == group and r["split"] == "dev"]
        assert len(dev) == int(len(part) * 0.6)


def test_label_balanced_sample_equals_greedy_walk(skewed):
    import hashlib

    rows, df = skewed
    n, cap = 50, 50 // 3 + 1
    stream = sorted(rows, key=lambda r: hashlib.md5(f"42_{r[0]}".encode()).hexdigest())
    counts, kept = {}, []
    for row in stream:
        if counts.get(row[1], 0) < cap and len(kept) < n:
            kept.append(row[0])
            counts[row[1]] = counts.get(row[1], 0) + 1
    got = sampling.label_balanced_sample(df, "source_dataset", "row_ordinal", n)
    assert {r["row_ordinal"] for r in got.collect()} == set(kept)


def test_seeded_sample_is_exact_with_repeated_keys(spark, skewed):
    _, df = skewed
    assert sampling.seeded_sample(df, "row_ordinal", 300).distinct().count() == 300
    repeated = spark.createDataFrame([(k // 4, k) for k in range(400)], "key long, v long")
    for n in (1, 10, 11, 399, 400, 500):
        rows = sampling.seeded_sample(repeated, "key", n).collect()
        assert len(rows) == len(set(rows)) == min(n, 400)
    twice = repeated.select("key").union(repeated.select("key"))
    assert sampling.seeded_sample(twice, "key", 10).count() == 10


def test_round_robin(spark):
    data = [(0, "x"), (1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, "y")]
    df = spark.createDataFrame(data, "row_ordinal long, source_dataset string")
    order = [0, 2, 4, 1, 5, 3]
    everything = sampling.round_robin(df, "source_dataset", "row_ordinal").collect()
    assert [r["row_ordinal"] for r in everything] == order
    capped = sampling.round_robin(df, "source_dataset", "row_ordinal", 4).collect()
    assert [r["row_ordinal"] for r in capped] == order[:4]


def test_number_rows_across_buckets(spark):
    rng = random.Random(1)
    keys = rng.sample(range(100_000), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = ranking.number_rows(df, [], "k", "rn").collect()
    rank = {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert {r["k"]: r["rn"] for r in got} == rank


def test_chunk_sizes(spark):
    df = spark.createDataFrame([(i, "d") for i in range(5)], "row_ordinal long, name string")
    chunks = sampling.chunk_rows(df, ["name"], "row_ordinal", 2).groupBy("batch_id").count()
    assert sorted((r["batch_id"], r["count"]) for r in chunks.collect()) == [(0, 2), (1, 2), (2, 1)]


def test_latest_and_known_sums(spark, evaluate):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")],
                               "k string, o long, v string")
    assert {(r["k"], r["v"]) for r in records.latest(df, ["k"], "o").collect()} == {
        ("a", None), ("b", "z")}
    rows = [(1, 2), (None, 2), (1, None), (None, None)]
    assert evaluate(records.add_known, rows, "a long, b long") == [3, 2, 1, None]


def test_oracle_context(spark):
    kind = "paragraphs array<struct<paragraph_text:string,is_supporting:boolean>>"
    marked = [("noise", False), ("support 1", True), (" support 2 ", True)]
    plain = [("one", False), (" ", False), ("three", False), ("four", False), ("five", False)]
    df = spark.createDataFrame([(0, marked), (1, plain), (2, [])], f"i int, {kind}")
    for leading, expected in ((None, "one\n\nthree\n\nfour\n\nfive"), (4, "one\n\nthree\n\nfour")):
        context = cases.oracle_context(df, "paragraphs", leading=leading)
        got = df.select("i", context.alias("c")).orderBy("i").collect()
        assert [r["c"] for r in got] == ["support 1\n\nsupport 2", expected, ""]
    text = spark.createDataFrame([("a\n\n \n\nb\n\nc\n\nd\n\ne",)], "context string")
    assert text.select(cases.oracle_context(text, "context")).first()[0] == "a\n\nb\n\nc\n\nd\n\ne"
    first = cases.oracle_context(text, "context", leading=4)
    assert text.select(first).first()[0] == "a\n\nb\n\nc\n\nd"


def suite_fixture(spark):
    answers = {"ex-1": "Paris", "ex-2": "London", "ex-3": "Rome"}
    said = {"ex-1": "Paris", "ex-2": "Berlin", "ex-3": "Rome"}
    built = [
        (k, "quality", "q", None, None, ([a], None, None, None, None), None)
        for k, a in answers.items()
    ]
    case_table = readers.from_rows(spark, built)
    planned = predictions.fan_out(case_table.select("dataset_name", "example_id"),
                                  ["model-a", "model-b"])
    reply = F.create_map(*[F.lit(x) for pair in said.items() for x in pair])
    made = planned.withColumn("status", F.lit("success")).withColumn(
        "response_text", F.element_at(reply, F.col("example_id")))
    return predictions.match_cases(made, case_table.withColumn("row", F.lit(1)), order="row")


def test_suite_roll_up(spark):
    scores = scoring.score_predictions(suite_fixture(spark))
    summary = summaries.pair_summaries(scores)
    rows = summary.collect()
    assert len(rows) == 2
    assert sum(r["scored_examples"] for r in rows) == 6
    for row in rows:
        assert row["aggregated_metrics"]["exact_match"] == pytest.approx(2 / 3)
    totals = summaries.suite_counters(summary).first()
    assert (totals["total_pairs"], totals["total_examples"], totals["failed_examples"]) == (2, 6, 0)


def test_failing_metric_becomes_metric_error(spark):
    def explode(prediction, reference):
        raise RuntimeError("boom")

    scores = scoring.score_with_metric(
        suite_fixture(spark), scoring.custom_metric(explode), F.lit("x")
    ).collect()
    assert {(r["status"], r["error_type"], r["error_message"]) for r in scores} == {
        ("metric_error", "RuntimeError", "boom")}
    assert len(scores) == 6


def test_unknown_dataset_and_null_metric(spark):
    odd = suite_fixture(spark).withColumn("dataset_name", F.lit("other"))
    assert {r["status"] for r in scoring.score_predictions(odd).collect()} == {"metric_error"}
    assert {r["status"] for r in scoring.null_metric(odd).collect()} == {"scored"}


def test_profiles():
    assert scoring.get_profile(" FEVER ").primary_metric == "label_accuracy"
    assert scoring.list_profiles()[0] == "fever"
    with pytest.raises(ValueError, match="Unsupported dataset profile"):
        scoring.get_profile("nope")


def test_resume_is_idempotent(spark):
    df = spark.createDataFrame([("d", "ex-1"), ("d", "ex-2")], "dataset_name string, example_id string")
    planned = predictions.fan_out(df, ["a", "b"])
    done = planned.withColumn(
        "status", F.when(F.col("example_id") == "ex-2", "error").otherwise("success"))
    assert predictions.pending(planned, predictions.recorded_keys(done)).count() == 0
    retried = predictions.recorded_keys(done, retry_errors=True)
    assert predictions.pending(planned, retried).count() == 2
    none = predictions.recorded_keys(done.limit(0))
    totals = predictions.run_counters(planned, none, done).first()
    assert tuple(totals) == (4, 0, 4, 2, 2)
    again = predictions.run_counters(planned, predictions.recorded_keys(done), done).first()
    assert tuple(again) == (4, 4, 0, 0, 0)


def test_aliases(spark):
    with pytest.raises(ValueError, match="Duplicate alias configured: math"):
        cases.role_aliases(spark, {"qa": ("math",), "reasoning": ("math",)})
    aliases = cases.role_aliases(spark)
    assert aliases.count() == 6
    df = spark.createDataFrame([(" Math ",), ("who",)], "target string")
    got = {r["target"]: (r["role"], r["error_type"]) for r in
           cases.resolve_roles(df, "target", aliases).collect()}
    assert got == {" Math ": ("reasoning", None), "who": (None, "KeyError")}


def test_votes(evaluate):
    texts = ["A", "The answer is B.", "  c  ", "I choose B because...", "nonsense", "", None]
    assert evaluate(council.parse_vote, texts) == ["A", "B", "C", "B", "A", "A", "A"]
    ballots = [["B", "B", "A"], ["C", "C", "C"], ["A", "B", "C"], ["C", "B", "A"], ["C", "B", "B"]]
    got = evaluate(council.majority, [(b,) for b in ballots], "v array<string>")
    assert got == ["B", "C", "A", "A", "B"]


def calls(spark, rows):
    full = [
        (ex, "router", phase, role, f"m-{role}", status, text, lat, tin, 1, tin + 1, None, None, o)
        for o, (ex, phase, role, status, text, lat, tin) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.COUNCIL_CALL)


def test_decision(spark):
    rows = [
        ("e1", "answer", "qa", "success", "old", 1.0, 1),
        ("e1", "answer", "qa", "success", "<think>x</think>one", 10.0, 5),
        ("e1", "answer", "reasoning", "success", "two", 20.0, 6),
        ("e1", "answer", "general", "error", "lost", None, 7),
        ("e1", "vote", "qa", "success", "B", 1.0, 1),
        ("e1", "vote", "reasoning", "error", "C", 1.0, 1),
        ("e1", "vote", "general", "success", "I say b", 1.0, 1),
    ]
    row = council.decide(calls(spark, rows)).first()
    assert row["answer_a"] == "one" and row["answer_c"] == ""
    assert row["votes"] == {"qa": "B", "reasoning": "A", "general": "B"}
    assert (row["winning_label"], row["winning_model"], row["winning_answer"]) == (
        "B", "m-reasoning", "two")
    assert row["answer_latency_ms_total"] == 30.0
    assert row["specialist_usage"]["input_tokens"] == 21
    shuffled = council.decide(calls(spark, rows).repartition(5)).first()
    assert shuffled["winning_label"] == "B"


def test_first_seen_majority_and_best_code(spark):
    df = spark.createDataFrame(
        [("e", "y", 0, 1), ("e", "x", 1, 0), ("e", "x", 2, 1), ("e", "y", 3, 0)],
        "example_id string, extracted_answer string, position long, exit_code long")
    assert council.majority_of_answers(df).first()["council_answer"] == "y"
    best = council.best_of_n_code(df.withColumnRenamed("extracted_answer", "code")).first()
    assert (best["council_answer"], best["any_passed"]) == ("x", True)


def log_rows(spark, rows):
    names = [field.split()[0] for field in schemas.POLICY_LOG.split(", ")]
    full = [tuple(row.get(name) for name in names) for row in rows]
    return spark.createDataFrame(full, schemas.POLICY_LOG)


def test_efficiency_of_two_dialects(spark):
    rows = [
        {"example_id": "ex1", "status": "success", "row_ordinal": 0,
         "usage": {"input_tokens": "10", "output_tokens": "5"}, "latency_ms": 12.0},
        {"example_id": "ex2", "status": "success", "row_ordinal": 1,
         "usage": {"input_tokens": None, "total_tokens": "20"}, "latency_ms": 0.0},
    ]
    log = comparison.normalize_log(log_rows(spark, rows), F.lit("P1"))
    report = comparison.efficiency_report(log).first()
    assert report["avg_tokens_per_question"] == 17.5
    assert report["avg_calls_per_question"] == 1.0
    assert report["avg_latency_per_question"] == 12.0


def test_legacy_log_semantics(spark):
    rows = [
        {"example_id": "a", "status": "success", "dataset_name": "fever", "row_ordinal": 0,
         "usage": {"input_tokens": "1"}, "metrics": {"label_accuracy": 1.0}},
        {"example_id": "b", "status": "error", "dataset_name": "fever", "row_ordinal": 1},
        {"query_id": "c", "failed": True, "dataset": "", "task_type": "qa", "task_tag": "math",
         "routed_role": "qa", "row_ordinal": 2, "metrics": {"accuracy": 0.5}},
    ]
    log = log_rows(spark, rows)
    legacy = {r["row_ordinal"]: r for r in comparison.normalize_log(log, legacy=True).collect()}
    assert legacy[0]["dataset"] is None and legacy[0]["primary_metric"] is None
    assert legacy[1]["status"] == "success"
    assert legacy[2]["status"] == "error" and legacy[2]["dataset"] == "math"
    assert legacy[2]["routed_correctly"] is False and legacy[2]["example_id"] == "c"
    filled = {r["row_ordinal"]: r for r in comparison.normalize_log(log).collect()}
    assert filled[0]["dataset"] == "fever" and filled[0]["primary_metric"] == 1.0
    assert filled[1]["status"] == "error"


def test_disagreements_treat_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [("q1", "P3", "qa", None, 0), ("q1", "P4", "qa", None, 1), ("q2", "P3", "qa", "qa", 2),
         ("q2", "P4", "qa", "x", 3), ("q2", "P4", "qa", None, 4), ("q3", "P4", "qa", "qa", 5)],
        "query_id string, policy string, task_tag string, predicted_tag string, row_ordinal long")
    rows = comparison.disagreements(df).collect()
    assert [(r["query_id"], r["p3_tag"], r["p4_tag"], r["p4_correct"]) for r in rows] == [
        ("q2", "qa", None, False)]


def test_ranks(spark):
    df = spark.createDataFrame(
        [("a", "d1", 0.9), ("b", "d1", 0.9), ("c", "d1", 0.1), ("a", "d2", 0.2), ("b", "d2", 0.8)],
        "model string, dataset string, avg_score double")
    ranks = {r["model"]: r["avg_rank"] for r in leaderboard.average_ranks(df).collect()}
    assert ranks == {"a": 1.75, "b": 1.25, "c": 3.0}
    best = {r["dataset"]: r for r in leaderboard.specialist_map(df).collect()}
    assert best["d1"]["best_model"] == "a" and best["d1"]["runner_up_model"] == "b"
    lone = leaderboard.specialist_map(df.filter("model = 'c'")).first()
    assert lone["runner_up_model"] == "c"
    with pytest.raises(ValueError):
        leaderboard.select_council(df, "random")


def test_samples_of_one_key_are_exact_and_dealt(spark):
    """A million rows of one key: exactly n of them, the same ones again, and no task with all."""
    rows = spark.range(1_000_000).select(F.lit("k").alias("key"), (F.col("id") % 250_000).alias("body"))
    for n in (1000, 600_001):
        sample = sampling.seeded_sample(rows.repartition(8), "key", n)
        assert sample.count() == n
        copies = {r["copies"]: r["n"] for r in sample.groupBy("body").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("n")).collect()}
        # Bodies come four times each; all but one of those taken are taken whole.
        assert set(copies) <= {4, n % 4 or 4} and sum(k * v for k, v in copies.items()) == n
    first = sampling.seeded_sample(rows.repartition(3), "key", 777).agg(F.sum("body"), F.bit_xor("body")).first()
    assert first == sampling.seeded_sample(rows.repartition(11), "key", 777).agg(F.sum("body"), F.bit_xor("body")).first()


def test_equal_rows_are_written_out_by_several_tasks(spark):
    rows = spark.range(1_000_000).select(F.lit("k").alias("key"), F.create_map(F.lit("a"), F.lit(1)).alias("more"))
    sample = sampling.seeded_sample(rows, "key", 500_000)
    # So small a result would otherwise be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sample.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in sizes) == 500_000 and max(r["count"] for r in sizes) <= 250_000
    assert sample.first()["more"] == {"a": 1}


def test_split_of_repeated_keys_is_exact(spark):
    rows = [("a", k % 3, k) for k in range(1000)] + [("b", 1, 1)] * 77 + [("c", k, k) for k in range(10)] + [(None, 5, k) for k in range(9)]
    df = spark.createDataFrame(rows, "source_dataset string, key long, body long")
    split = sampling.split_dev_test(df, "key").drop("old")
    counts = {r["source_dataset"]: (r["dev"], r["n"]) for r in split.groupBy("source_dataset").agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count("*").alias("n")).collect()}
    assert counts == {"a": (600, 1000), "b": (46, 77), "c": (6, 10), None: (5, 9)}
    back = sorted((r["source_dataset"] or "", r["key"], r["body"]) for r in split.collect())
    assert back == sorted((s or "", k, b) for s, k, b in rows)


def test_balanced_samples_of_repeated_keys(spark):
    rows = [(label, 1, k) for label in "xyz" for k in range(500)]
    df = spark.createDataFrame(rows, "label string, key long, body long").withColumn("can", F.col("label") == "x")
    sample = sampling.label_balanced_sample(df, "label", "key", 99)
    assert sample.count() == 99 and max(r["count"] for r in sample.groupBy("label").count().collect()) <= 34
    parts = sampling.answerability_sample(df, "can", "key", 50)
    assert parts.filter("can").count() == 45 and parts.filter("NOT can").count() == 5


def test_numbers_of_one_position_are_dealt(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.lit(7).alias("at"), F.col("id").alias("body"))
    numbered = ranking.number_rows(df, ["g"], "at", "n")
    stats = numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(stats) == (1, 200_000, 200_000) and set(numbered.columns) == {"g", "at", "body", "n"}
    again = ranking.number_rows(df.repartition(5), ["g"], "at", "n")
    assert numbered.join(again, ["body", "n"]).count() == 200_000
