"""Readers. Every JSON read has a fixed schema, so no file is scanned to infer one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.operators.comparison import normalize_log
from tallyframe.operators.ranking import number_rows
from tallyframe.sources.commits import CommittedTable

SPLIT_ALIASES = {"validation": "dev", "test": "mini-test", "mini_test": "mini-test"}


def existing_paths(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Paths or globs that match something, by the file system they live on."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in wanted:
        location = jvm.org.apache.hadoop.fs.Path(path)
        matches = location.getFileSystem(conf).globStatus(location)
        if matches is not None and len(matches) > 0:
            found.append(path)
    return found


_LINE_ORDER = "struct<path:string,block:bigint,row:bigint>"


def read_json(
    spark: SparkSession, paths: str | Sequence[str], schema: str, lines: bool = False
) -> DataFrame:
    """JSON lines; blank lines are skipped and missing paths give no rows.

    With ``lines``, ``line_order`` sorts the rows like the lines of the files, and
    ``broken_line`` holds a line that is no JSON of the schema; its fields are null.
    """
    found = existing_paths(spark, paths)
    if not found:
        extra = f", broken_line string, line_order {_LINE_ORDER}" if lines else ""
        return spark.createDataFrame([], schema + extra)
    if not lines:
        return spark.read.schema(schema).json(found)
    reader = spark.read.schema(f"{schema}, broken_line string")
    rows = reader.option("columnNameOfCorruptRecord", "broken_line").json(found)
    # Numbers grow inside a block of a file, and blocks are told apart by where they start.
    order = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select("*", order.alias("line_order"))


def suite_paths(spark: SparkSession, suite_dir: str) -> list[str]:
    """Globs of the prediction files below a suite folder that match something."""
    root = suite_dir.rstrip("/")
    below = ("predictions/*/predictions/*.jsonl", "predictions/pair=*/*.json")
    return existing_paths(spark, [f"{root}/{glob}" for glob in below])


def read_mixed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Mixed dataset; a split reads only its partition."""
    rows = spark.read.schema(schemas.MIXED_ROW).parquet(path)
    if split is None or split == "full":
        return rows
    return rows.filter(F.col("split") == SPLIT_ALIASES.get(split, split))


def read_numbered(
    spark: SparkSession, path: str, key: str, file_format: str = "parquet", schema=None
) -> DataFrame:
    """Raw rows with a dense ``row_ordinal`` from 0 in the order of an integer key."""
    reader = spark.read.format(file_format)
    if schema is not None:
        reader = reader.schema(schema)
    numbered = number_rows(reader.load(path), [], key, "row_ordinal")
    return numbered.withColumn("row_ordinal", F.col("row_ordinal") - 1)


def from_rows(spark: SparkSession, rows: Iterable, schema: str = schemas.CASE) -> DataFrame:
    """Cases handed over as Python rows."""
    return spark.createDataFrame(list(rows), schema)


def read_policy_log(
    spark: SparkSession, paths: str | Sequence[str], policy: str, legacy: bool = False
) -> DataFrame:
    """Prediction log of one policy in the shared shape, from log files or a suite folder.

    Broken lines count as errors. ``line_order`` stands in for a missing ordinal.
    """
    if isinstance(paths, str):
        paths = suite_paths(spark, paths) or paths
    raw = read_json(spark, paths, schemas.POLICY_LOG, lines=True)
    return normalize_log(raw, F.lit(policy), legacy)


def read_policies(
    spark: SparkSession, inputs: Sequence[tuple[str, str]], legacy: bool = False
) -> DataFrame:
    """Logs of several policies in one DataFrame; a repeated policy keeps its last path."""
    by_policy = {policy.upper(): path for policy, path in inputs}
    whole = None
    for policy, path in by_policy.items():
        part = read_policy_log(spark, path, policy, legacy)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError("Provide at least one policy and path.")
    return whole


def read_suite(spark: SparkSession, suite_dir: str) -> DataFrame:
    """All prediction files of a suite folder with the dataset and model of their path: the file
    name ``dataset__model.jsonl`` or the folder ``pair=dataset__model``."""
    found = suite_paths(spark, suite_dir)
    if not found:
        raise FileNotFoundError(f"No prediction files found under {suite_dir}")
    rows = spark.read.schema(schemas.PREDICTION).json(found)
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, "/pair=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(path, r"/([^/]+)\.jsonl$", 1)
    parts = F.split(F.url_decode(F.when(folder != "", folder).otherwise(name)), "__")
    return rows.select(
        *rows.columns,
        F.get(parts, F.lit(0)).alias("file_dataset"),
        F.get(parts, F.lit(1)).alias("file_model"),
    )


def read_predictions(spark: SparkSession, path: str, schema: str = schemas.PREDICTION) -> DataFrame:
    """Committed predictions, or score records by their schema, with the names they were written with."""
    pair = "dataset_slug string, model_slug string"
    rows = CommittedTable(spark, path).read(f"{schema}, {pair}", "json")
    return rows.drop("dataset_slug", "model_slug")


def read_recorded_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct example ids recorded in committed predictions or in plain prediction files; only that
    field is parsed."""
    table = CommittedTable(spark, path)
    one = "example_id string"
    rows = table.read(one, "json") if table.exists() else read_json(spark, path, one)
    return rows.select("example_id").filter(F.col("example_id").isNotNull()).distinct()


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Model-call log with its time stamps parsed."""
    rows = read_json(spark, path, schemas.CALL)
    return rows.withColumns(
        {
            "started_at": F.try_to_timestamp("started_at"),
            "completed_at": F.try_to_timestamp("completed_at"),
        }
    )
