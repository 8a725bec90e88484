"""A table in versions with a log of commits, for micro-batches that bring a table up to date.

`data` holds one folder for each attempt to write a version, `commits` one row for each version: who made it (run
and batch), the clock it stands for, where its window began, and which folder holds it. A version counts once its
row stands. A batch that is run again finds its row and does nothing; a folder without a row is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

COMMIT = "run string, batch long, clock timestamp, since timestamp, judged_until timestamp, data string"


class VersionedTable:
    """Versions of a table under a folder that all machines share; version 0 is empty."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        first = f"{self.path}/data/v0"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(first)
        self._row(("", -1, None, None, None, "v0")).write.mode("ignore").parquet(f"{self.path}/commits/n=0")

    def _row(self, values: tuple) -> DataFrame:
        return self.spark.createDataFrame([values], COMMIT).coalesce(1)

    def commits(self) -> DataFrame:
        """(n, run, batch, clock, since, judged_until, data) of every version."""
        return self.spark.read.schema(f"{COMMIT}, n long").parquet(f"{self.path}/commits")

    def latest(self) -> Row:
        return self.commits().orderBy(F.desc("n")).first()

    def made_by(self, run: str, batch: int) -> bool:
        """Whether a batch has committed its version."""
        return not self.commits().where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty()

    def read(self, n: int | None = None) -> DataFrame:
        """A version, the latest by default."""
        row = self.latest() if n is None else self.commits().where(F.col("n") == n).first()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{row['data']}")

    def commit(self, rows: DataFrame, before: Row, run: str, batch: int, clock, since, judged_until) -> None:
        """Write the version after `before`. Fails if another writer was faster, and leaves its version alone."""
        n = before["n"] + 1
        data = f"v{n}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{data}")
        self._row((run, batch, clock, since, judged_until, data)).write.mode("error").parquet(f"{self.path}/commits/n={n}")
