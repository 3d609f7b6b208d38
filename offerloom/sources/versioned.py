"""A table that is changed by rewriting only the buckets that a change touches.

Rows lie in buckets by a hash of their key, each bucket in a folder of its own. A version is one small file that lists the
buckets' folders. A change reads the touched buckets, writes them anew beside the old ones, and puts the next version in place unless
somebody else did; then it starts over from theirs. Readers of a version see it whole, and untouched buckets keep their files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sinks import put_if_absent

UPSERT, DELETE = "UPSERT", "DELETE"
#: How often a change starts over when others come first.
ATTEMPTS = 20


def _paths(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    return [s.getPath().getName() for s in found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []]


class VersionedTable:
    """keys: the columns that name a row; null keys are keys too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, df: DataFrame, folder: str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """Version 0. Two rows of one key are an error."""
        table = cls(df.sparkSession, folder)
        _no_repeats(df, keys)
        version = {"keys": keys, "buckets": buckets, "schema": json.loads(df.schema.json())}
        table._put(0, version | {"folders": table._write(df, keys, buckets)})
        return table

    def _put(self, number: int, version: dict) -> bool:
        return put_if_absent(self.spark, f"{self.folder}/_versions/{number:010d}.json", json.dumps(version))

    def _write(self, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """The folders of the buckets that have rows."""
        name = uuid.uuid4().hex
        placed = df.withColumn("_bucket", _bucket(keys, buckets))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        return {b.partition("=")[2]: f"{name}/{b}" for b in _paths(self.spark, f"{self.folder}/{name}", "_bucket=*")}

    def version(self, number: int | None = None) -> tuple[int, dict]:
        """(number, what it lists) of a version, the newest by default."""
        if number is None:
            number = max(int(n.removesuffix(".json")) for n in _paths(self.spark, f"{self.folder}/_versions", "*.json"))
        text = self.spark.read.text(f"{self.folder}/_versions/{number:010d}.json", wholetext=True).head()[0]
        return number, json.loads(text)

    def _read(self, version: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        paths = [f"{self.folder}/{f}" for b, f in sorted(version["folders"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        return self._read(self.version(number)[1])

    def change(self, changes: DataFrame) -> int:
        """Applies changes (the table's columns and `op`: UPSERT or DELETE) and returns the new version's number. Two changes of
        one key are an error.
        """
        for _ in range(ATTEMPTS):
            number, version = self.version()
            keys, n = version["keys"], version["buckets"]
            _no_repeats(changes, keys)
            touched = {str(r[0]) for r in changes.select(_bucket(keys, n)).distinct().collect()}  # no more than there are buckets
            current = self._read(version, touched)
            same = F.lit(True)
            named = changes.select(*(F.col(k).alias(f"_{k}") for k in keys))
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            kept = current.join(named, same, "left_anti")
            rows = kept.unionByName(changes.where(F.col("op") == UPSERT).select(*current.columns))
            folders = {b: f for b, f in version["folders"].items() if b not in touched} | (self._write(rows, keys, n) if touched else {})
            if self._put(number + 1, version | {"folders": folders}):
                return number + 1
        raise RuntimeError(f"{self.folder}: others changed the table {ATTEMPTS} times meanwhile")


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _no_repeats(df: DataFrame, keys: list[str]) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for {', '.join(f'{k}={twice[0][k]}' for k in keys)}")
