"""Stored tables dealt into hash buckets by their keys.

A log of recorded runs or a response cache grows with every run, while the rows that are looked up in
it are those of one run. In buckets, only the new rows are dealt when they are added, and a join or
aggregation by the keys reads the log where it lies: nothing but the other side is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators.predictions import PAIR_KEYS
from tallyframe.sources.readers import existing_paths


@dataclass(frozen=True)
class BucketedStore:
    """Rows below ``path`` in ``buckets`` buckets by ``keys``; every user of a path must name the same.

    A bucket should stay below some hundred MB over the life of the store, as one task reads it whole:
    100 TB want about 500,000 of them. The session's catalog only notes where the files are, so that
    another session opens a store by its path.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str] = PAIR_KEYS
    buckets: int = 200

    @property
    def name(self) -> str:
        """The store's name in the session's catalog."""
        return f"store_{hashlib.md5(self.path.encode()).hexdigest()}"

    def add(self, df: DataFrame) -> None:
        """Add rows, dealt so that each bucket gets one file more. They appear together at the end;
        rows that come twice do no harm to look-ups by key."""
        self._open()
        columns = self.spark.table(self.name).columns
        dealt = df.select(*columns).repartition(self.buckets, *self.keys)
        writer = dealt.write.format("parquet").mode("append").option("path", self.path)
        writer.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def read(self) -> DataFrame:
        """All rows; joins and aggregations by the keys do not shuffle them."""
        self._open()
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def exists(self) -> bool:
        return bool(existing_paths(self.spark, self.path))

    def _open(self) -> None:
        keys = ", ".join(f"`{key}`" for key in self.keys)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
