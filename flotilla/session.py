"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"
ROCKSDB_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "flotilla",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session configured the way every plan in this library expects.

    On a cluster, pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small partitions and
    splits skewed ones at runtime).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": UTC,
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(
    input_bytes: int, total_cores: int, partition_bytes: int = 512 << 20, most_partitions: int | None = None
) -> dict[str, str]:
    """Settings sized to the data for a cluster run.

    The initial shuffle partition count aims at ``partition_bytes`` per
    partition for a shuffle the size of the input, and at two waves of the
    cluster's cores at least. The driver tracks map output per partition; a
    caller short of driver memory bounds the count with ``most_partitions``.
    AQE then coalesces toward the advisory size and splits skewed partitions;
    file splits of 512 MiB keep scan tasks in memory.
    """
    partitions = max(-(-input_bytes // partition_bytes), 2 * total_cores)
    if most_partitions is not None:
        partitions = min(partitions, most_partitions)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        # Coalesce toward the advisory size rather than toward the core count.
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        # Stream state (open days, evaluation ids inside the watermark) in
        # RocksDB rather than on the JVM heap.
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STATE_STORE,
    }


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is only read here; a
    missing one is an error, since driver and executors share no local disk.
    Only a local master, where all tasks run in this process, gets a folder of
    its own, recorded on the session so that every later call agrees.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (remote sessions have no SparkContext)
        sc = None
    configured = (sc.getConf().get("spark.checkpoint.dir", None) if sc else None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        master = sc.master if sc else ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="flotilla-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


# Folders that scratch paths of the calling code go to, innermost last.
_scopes: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scratch scopes", default=())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root (or the folder of the scope) for one job's output."""
    scopes = _scopes.get()
    root = scopes[-1] if scopes else checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """One folder for all that is materialized inside; it is deleted at the end.

    Gives a function that writes a result outside of that folder and reads it
    back. Only what went through it may be used after the scope.
    """
    result = scratch_path(spark, name)
    folder = f"{result}-scratch"

    def keep(df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(result)
        return df.sparkSession.read.parquet(result)

    token = _scopes.set((*_scopes.get(), folder))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        remove_path(spark, folder)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through Spark's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The result's lineage starts at the written files: later actions read
    them instead of recomputing ``df``, and a lost executor costs a re-read,
    not a replay of the upstream plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
