"""Statistics of a growing table of scores, kept up to date batch by batch.

Every batch leaves behind how often each value occurs, in folders by size of the value, and sums per
group and narrow bucket of values. Sums of batches add up, so that count, mean, deviation and extremes
never need the scores again; of the values, only folders that hold a median are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators.ranking import at_rank, running, value_bucket
from tallyframe.operators.records import join_null_safe
from tallyframe.session import saved_table
from tallyframe.sources.commits import CommittedTable

# Buckets of values per folder.
_FOLDER_BUCKETS = 64
_STEPS = 4096


def _bucket_center(bucket: Column) -> Column:
    """A value inside the bucket, see ``value_bucket``. Sums of distances from it stay exact."""
    size = F.when(bucket < 0, -bucket - 1).otherwise(bucket)
    return F.expm1(size / 1024) / 1000 * F.when(bucket < 0, -1).otherwise(1)


@dataclass(frozen=True)
class RunningStatistics:
    """Statistics of ``value`` by ``keys``, stored below ``path``. ``kinds`` are the types of the keys.

    Null and NaN values are not counted; a group without any other value has a row with n = 0.
    """

    spark: SparkSession
    path: str
    kinds: str = "model string, dataset string"
    value: str = "score"

    @property
    def keys(self) -> list[str]:
        return self.spark.createDataFrame([], self.kinds).columns

    @property
    def _table(self) -> CommittedTable:
        return CommittedTable(self.spark, self.path)

    def add(self, batch: DataFrame, number: int | None = None) -> bool:
        """Take a batch of scores in. With a ``number``, as a stream's batches have, a batch that was
        taken in already is left out and False returned."""

        def write(folder: str) -> None:
            known = F.nullif(F.col(self.value).cast("double"), F.lit(float("nan")))
            rows = batch.select(*self.keys, known.alias("_value")).withColumn("_bucket", value_bucket(F.col("_value")))
            counted = rows.groupBy(*self.keys, "_bucket", "_value").agg(F.count("*").alias("_n"))
            part = F.floor(F.col("_bucket") / _FOLDER_BUCKETS).alias("_folder")
            values = counted.select("*", part)
            values.hint("rebalance", F.col("_folder")).write.partitionBy("_folder").parquet(f"{folder}/values")
            stored = self.spark.read.schema(values.schema).parquet(f"{folder}/values")
            away = F.col("_value") - _bucket_center(F.col("_bucket"))
            counts = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0)
            stored.groupBy(*self.keys, "_bucket").agg(
                F.sum(counts).alias("_n"),
                F.sum(away * counts).alias("_away"),
                F.sum(away * away * counts).alias("_square"),
                F.min("_value").alias("_lo"),
                F.max("_value").alias("_hi"),
            ).write.parquet(f"{folder}/sums")

        if number is None:
            self._table.append(write)
            return True
        return self._table.commit(number, write)

    def statistics(self) -> DataFrame:
        """Count, mean, population deviation, extremes and exact median per group of all batches, as
        ``batch_statistics`` gives them for all their rows together."""
        sums = saved_table(self._sums(), "running-sums")
        center, n = _bucket_center(F.col("_bucket")), F.col("_n")
        basic = sums.groupBy(*self.keys).agg(
            F.sum("_n").alias("n"),
            F.try_divide(F.sum(n * center + F.col("_away")), F.sum("_n")).alias("mean"),
            F.min("_lo").alias("min"),
            F.max("_hi").alias("max"),
        )
        basic = saved_table(basic, "running-means")
        offset = F.col("mean") - center
        around = F.col("_square") - 2 * offset * F.col("_away") + n * offset * offset
        spread = join_null_safe(sums, basic.select(*self.keys, "mean"), self.keys).groupBy(*self.keys).agg(
            F.sqrt(F.greatest(F.try_divide(F.sum(around), F.sum("_n")), F.lit(0.0))).alias("std")
        )
        whole = join_null_safe(basic, spread, self.keys)
        whole = join_null_safe(whole, self._medians(sums), self.keys, "left")
        return whole.select(*self.keys, "n", "mean", "std", "min", "max", "median")

    def _sums(self) -> DataFrame:
        kinds = f"{self.kinds}, _bucket bigint, _n bigint, _away double, _square double, _lo double, _hi double"
        folders = [f"{folder}/sums" for folder in self._table.folders()]
        stored = self.spark.read.schema(kinds).parquet(*folders) if folders else self.spark.createDataFrame([], kinds)
        return stored.groupBy(*self.keys, "_bucket").agg(
            *[F.sum(c).alias(c) for c in ("_n", "_away", "_square")], F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
        )

    def _values(self, folders: Sequence[int]) -> DataFrame:
        """Values of some folders, of all batches."""
        kinds = f"{self.kinds}, _bucket bigint, _value double, _n bigint, _folder bigint"
        stored = [
            self.spark.read.schema(kinds).parquet(f"{folder}/values").filter(F.col("_folder").isin(*folders))
            for folder in self._table.folders()
        ]
        whole = self.spark.createDataFrame([], kinds)
        for part in stored:
            whole = whole.unionByName(part)
        return whole

    def _medians(self, sums: DataFrame) -> DataFrame:
        """The median is found in three steps, each inside the piece that the one before hits: by
        buckets, by even steps of a bucket, by values."""
        keys = self.keys
        group = W.partitionBy(*keys)
        filled = sums.filter("_n > 0")
        total = F.sum("_n").over(group)
        middle = F.array(
            F.struct(F.lit("low").alias("side"), F.floor((total + 1) / 2).alias("rank")),
            F.struct(F.lit("high").alias("side"), (F.floor(total / 2) + 1).alias("rank")),
        )
        counted = (
            filled.withColumns({"_upto": F.sum("_n").over(running(group, "_bucket")), "_wanted": middle})
            .withColumn("_wanted", F.explode("_wanted"))
            .withColumns({"_side": F.col("_wanted.side"), "_rank": F.col("_wanted.rank").cast("bigint")})
        )
        place = [*keys, "_bucket", "_side"]
        hits = saved_table(at_rank(counted).select(*place, "_rank", "_lo", "_hi"), "median-buckets")
        # There are as many folders as magnitudes of values, however many groups there are.
        folders = [r[0] for r in hits.select(F.floor(F.col("_bucket") / _FOLDER_BUCKETS)).distinct().collect()]
        inside = join_null_safe(self._values(folders).drop("_folder"), hits, [*keys, "_bucket"])
        share = F.try_divide(F.col("_value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        inside = inside.withColumn("_step", F.coalesce(F.floor(share * (_STEPS - 1)), F.lit(0)))
        steps = inside.groupBy(*place, "_rank", "_step").agg(F.sum("_n").alias("_n"))
        steps = steps.withColumn("_upto", F.sum("_n").over(running(W.partitionBy(*place), "_step")))
        finer = saved_table(at_rank(steps).select(*place, "_step", "_rank"), "median-steps")
        values = join_null_safe(inside.drop("_rank"), finer, [*place, "_step"])
        values = values.groupBy(*place, "_rank", "_value").agg(F.sum("_n").alias("_n"))
        values = values.withColumn("_upto", F.sum("_n").over(running(W.partitionBy(*place), "_value")))
        return at_rank(values).groupBy(*keys).agg(F.avg("_value").alias("median"))
