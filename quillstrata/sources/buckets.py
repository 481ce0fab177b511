"""Tables in buckets with versions: a new version writes the buckets that change, and only these.

A table has a key; a row is in the bucket of its key's hash. A manifest says which version
each bucket of each table has. Files are never changed: a version's files are written
first and its manifest last, so that readers of any version, the last one included, are
not disturbed by a write, a failed one leaves nothing behind that a reader sees, and a
lost executor writes its part again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Buckets:
    """Versioned tables below one folder.

    ``keys`` are the key column of each table, ``count`` the number of buckets, which also
    bounds what the driver holds: one number a table and bucket.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], count: int) -> None:
        self.spark, self.root, self.keys, self.count = spark, root, keys, count
        self.manifest: dict[str, dict[int, int]] = {name: {} for name in keys}
        self.version = -1
        self._schemas: dict[str, StructType] = {}

    def bucket(self, key: str | Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(key), F.lit(self.count)).cast("int")

    def of(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in a table of one column."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Return a table as of the last commit, or some of its buckets; no other file is opened."""
        held = self.manifest[table]
        versions: dict[int, list[int]] = {}
        for bucket in held if buckets is None else buckets:
            if bucket in held:
                versions.setdefault(held[bucket], []).append(bucket)
        schema = self._schemas[table]
        placed = StructType([*schema.fields, StructField("bucket", IntegerType())])
        parts = [self.spark.read.schema(placed).parquet(f"{self.root}/{table}/v{version}").where(F.col("bucket").isin(listed)) for version, listed in sorted(versions.items())]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return rows.drop("bucket")

    def commit(self, changes: dict[str, tuple[DataFrame, list[int] | None]]) -> None:
        """Write a new version: for each table the whole rows of some buckets (None: of all buckets).

        A bucket that is named and has no rows becomes empty.
        """
        version = self.version + 1
        for table, (rows, buckets) in changes.items():
            self._schemas.setdefault(table, rows.schema)
            placed = rows.withColumn("bucket", self.bucket(F.col(self.keys[table])))
            placed.hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{table}/v{version}")
            for bucket in range(self.count) if buckets is None else buckets:
                self.manifest[table][bucket] = version
        listed = [(table, bucket, at) for table, held in self.manifest.items() for bucket, at in held.items()]
        self.spark.createDataFrame(listed, "name string, bucket int, version int").coalesce(1).write.parquet(f"{self.root}/manifest/v{version}")
        self.version = version
