"""Session settings and the shared scratch folder.

Everything that has to outlive a stage (staged tables, stream checkpoints,
model folders) goes under the folder the cluster names in
``spark.checkpoint.dir``.  Only a local session without that setting gets a
temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# shuffle files of a write go when it ends, not when the driver next collects garbage
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings a cluster job needs for these plans. Shuffle partitions are left to
# AQE: it starts from a high number and coalesces small partitions.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM does not compile methods beyond 8000 bytes of bytecode; wide projections
    # run faster split up than as one interpreted method
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # the state of a standing job lies on disk, not in the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # sessions of a hot key are merged in each task before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cores: int | str = "*", app: str = "keystead", **conf: str) -> SparkSession:
    """A local session with the cluster settings, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**CLUSTER_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables; the session's setting always wins."""
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="keystead-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the true size
    of the table, so that a later join broadcasts it only when it really is
    below ``spark.sql.autoBroadcastJoinThreshold``.  The shuffles of the write are
    deleted with it: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path  # for release
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder under the shared one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that `stage` returned, once whatever reads them has been written."""
    for table in tables:
        delete(table.sparkSession, table._staged)
