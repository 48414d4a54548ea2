"""Session helpers: a tuned local/cluster session and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Partition counts are left to AQE: it coalesces
# small shuffles and splits skewed ones at run time.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # long-running drivers (streams, timer refreshes): bound the execution
    # metadata the status store keeps even with the UI off
    "spark.sql.ui.retainedExecutions": "100",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "400",
}


# Suggested settings for a large cluster (hundreds of TB, ~1000 executors).
# Shuffles start wide and AQE coalesces them to ~256 MB partitions; skewed
# partitions (a key holding a third of the rows) are split at run time.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # rows carrying image bytes: keep Arrow batches to the scorer/provider small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, app_name: str = "binsight",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the cluster-shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local folder is made and registered with
    ``SparkContext.setCheckpointDir`` (the core setting itself cannot change at
    run time), but only under a ``local`` master: on a cluster the executors
    could not see it, so this raises.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="binsight-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared folder."""
    return f"{shared_dir(spark)}/binsight/{name}-{uuid.uuid4().hex}"


_SHIPPED: set = set()


def _zip_package() -> bytes:
    import io
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for fn in filenames:
                if fn.endswith(".py"):
                    full = os.path.join(dirpath, fn)
                    zf.write(full, os.path.relpath(full, root))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``binsight`` importable by the Python workers (like ``--py-files``).

    The zip is written once per application to the shared folder and added
    with ``addPyFile``; harmless when the package is installed on the workers.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    target = f"{scratch_path(spark, 'pyfiles')}/binsight.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(_zip_package()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
