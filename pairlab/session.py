"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every pairlab job relies on.  Shuffle partition count is left to
# the caller (cluster jobs size it from the input; tests use the core count).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Local runs hold little data per shuffle but much regex work per byte; let AQE
# keep small post-shuffle partitions apart so the text work uses every core.
LOCAL_CONF = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.pairlab.textTasks": "8"}


def build_session(master: str | None = None, app: str = "pairlab", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or a checkpoint dir already set
    on the context).  Where neither is set, a local run (``local[..]`` master) uses
    a folder below the warehouse; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        conf_dir = warehouse.rstrip("/") + "/_pairlab_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def local_test_session(tmp_root: str | None = None, cores: int = 8) -> SparkSession:
    """Session for tests / local benches: sets a checkpoint dir only if unset."""
    extra = {}
    if tmp_root:
        extra["spark.sql.warehouse.dir"] = os.path.join(tmp_root, "warehouse")
    spark = build_session(master=f"local[{cores}]", shuffle_partitions=cores,
                          extra={**extra, **LOCAL_CONF, "spark.driver.memory": "8g"})
    if tmp_root and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(tmp_root, "checkpoints"))
    return spark


#: Spark's own switch: remove the shuffle files of a statement when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` as a parquet table in the shared folder and read
    it back.  One job (no double evaluation as with an unpersisted checkpoint),
    survives executor loss, and the re-read carries real size statistics.  The
    shuffles that made the table go once it is written: nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.parquet(path)
    out._scratch_path = path
    out._written = True
    return out


def is_written(df) -> bool:
    """Whether ``df`` is (columns of) a table that ``materialize`` wrote, so reading it twice evaluates nothing twice."""
    return df.__dict__.get("_written", False)


def columns_of(table, *columns):
    """``table.select(...)`` that is still known as written if ``table`` is."""
    out = table.select(*columns)
    out._written = is_written(table)
    return out


def discard(*tables) -> None:
    """Delete tables that ``materialize`` wrote; only when nothing will read them again."""
    for df in tables:
        path = df.__dict__.pop("_scratch_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
