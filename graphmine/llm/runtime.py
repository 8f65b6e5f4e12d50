"""What every operator of this subpackage needs from the session: code on the executors and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from graphmine.operators.store import tidy

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


#: Bytes of a batch that goes to a Python worker at once, unless the session says otherwise: long texts make small batches.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application (files go through Spark's file server), and bound their batches."""
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), "graphmine_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("graphmine", os.path.relpath(full, _PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder in the warehouse (shared as well) where the session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/graphmine-shared"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def collect_garbage(spark: SparkSession) -> None:
    """Free what finished jobs have left on the driver: plans, task results, broadcasts and network buffers.

    The collector would else let the heap grow to its limit first, and buffers outside the heap are held by garbage inside it.
    """
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with tidy(spark):  # the job's shuffle files go with it
        df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(frames: Iterable[DataFrame]) -> None:
    """Delete the written tables that ``frames`` read, if they are below the shared folder; no frame over them can be used afterwards."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        shared = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(top)
            if path.toUri().getPath().startswith(shared + "/"):
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
