"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Sizing stays with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def bound_batches(spark: SparkSession, limit: str = "4m") -> SparkSession:
    """Bound the Arrow batches that go to Python by bytes, unless the session does so already.

    Spark counts rows alone, so 10,000 long texts are one batch, which the executor and the Python process hold
    more than once each.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, set only where it is unset.

    A machine-local default is allowed for a local master only: on a cluster the
    files must outlive the executor that wrote them.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="fleetsift-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write df to the shared folder as Parquet and continue from the files.

    Later steps read only the columns they need, their size is known to the
    planner, and a lost executor costs one read instead of the steps before.
    options are the writer's.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
