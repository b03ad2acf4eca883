"""Session defaults and lineage helpers.

All jobs in this package are lazy DataFrame -> DataFrame functions; the few
places that must materialise an interim table (to cut lineage, or to size a
join side before broadcasting it) go through :func:`materialize`, which writes
a reliable checkpoint into the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every job here assumes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A bucket that is one file is read in the order it was written in.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # Long texts: keep Arrow batches small so one Python worker never holds
    # a large slice of the corpus at once (rows and bytes are both capped).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "eventlens", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # checkpoint files go away with the DataFrames that use them
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = b.getOrCreate()
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (static ones skipped)."""
    for k, v in SESSION_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must exist (a machine-local folder is not
    visible to other executors). Only in local mode, when it is unset, a
    folder under the system temp dir is used, as tests do.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="eventlens-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's interim tables inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/eventlens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path for an interim table inside the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this application's interim tables, through the store's own file
    system. Call it when no DataFrame that reads them is used any more; other
    applications' tables in the same shared folder stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes ``df`` once, writes it to the shared
    folder and returns a DataFrame whose lineage starts there. Survives the
    loss of any executor (unlike ``localCheckpoint``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

