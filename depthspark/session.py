"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Runtime settings, safe to set on a session somebody else made. Partition counts and memory stay
# with whoever runs the cluster; AQE sizes shuffles from what it measures.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange: a hot symbol or user
    # otherwise decides how long the whole stage runs.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STREAMING = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in {**RUNTIME, **STREAMING}.items():
        spark.conf.set(name, value)
    return spark


def new_session(master: str = "local[*]", app: str = "depthspark", shuffle_partitions: int | None = None,
                **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for name, value in {**RUNTIME, **STREAMING, **extra}.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_WRITTEN: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for intermediate tables; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _marked(df: DataFrame) -> DataFrame:
    df.__dict__["_stored"] = True
    return df


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Writes a table whose plan is run this once, so its shuffle files go as soon as it is written and not at some later collection."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def materialize(make: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """Writes a table once per application and name, and reads it from there afterwards.

    Cuts the lineage in a way that survives lost executors, and gives readers column pruning and
    filters. Without a shared folder the table is computed in place each time.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        folder = shared_folder(spark)
        if folder is None:
            return make()
        path = f"{folder}/table-{uuid.uuid4().hex}"
        _write(make(), path)
        _WRITTEN[key] = path
    return _marked(spark.read.parquet(_WRITTEN[key]))


def new_folder(spark: SparkSession) -> str:
    """A folder for one run's output, in the shared folder; without one there is an error, as executors could not read each other's files."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder}/out-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table that an operator reads several times, written once into the shared folder; the same plan where there is none.

    A table that ``stored`` or ``materialize`` returned is not written again.
    """
    if df.__dict__.get("_stored"):
        return df
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/part-{uuid.uuid4().hex}"
    _write(df, path)
    return _marked(df.sparkSession.read.schema(df.schema).parquet(path))
