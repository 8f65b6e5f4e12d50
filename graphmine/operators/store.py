"""Tables between jobs, and room on disk: kept tables are columnar, and a job's shuffle files go with the job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a job shuffles at once.
SLICE_ROWS = 60_000_000


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block leave no shuffle files behind (a retried stage makes its own again)."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder if the session has one, else cached; ``release`` frees it."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Free a table that ``keep`` returned."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        df.unpersist()
        return
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if top.rsplit("/", 1)[-1].startswith("kept-"):
            path_of(top).getFileSystem(conf).delete(path_of(top), True)


def slices(column: str, rows: int) -> list[Column]:
    """Conditions that split a table of ``rows`` rows by ``column``, each value in one of them; one job shuffles about ``SLICE_ROWS``."""
    n = max(1, -(-rows // SLICE_ROWS))
    return [F.pmod(F.xxhash64(column), F.lit(n)) == k for k in range(n)]
