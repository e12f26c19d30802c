"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every metrolens job relies on. Anything already set on the
# session (by spark-submit / cluster defaults) wins over these.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "metrolens") -> SparkSession:
    """Return the active session (creating a local one if none exists) with
    the metrolens defaults applied where the deployment left them unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULT_CONF.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (to a folder every executor can reach);
    only when it is unset - local runs and tests - we pick a scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="metrolens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(spark: SparkSession):
    """A lineage cut that survives executor loss: ``Dataset.checkpoint`` into
    the shared checkpoint folder (never ``localCheckpoint``). The checkpoint
    keeps the frame's partitioning, so later joins on the same keys do not
    shuffle it again."""
    checkpoint_dir(spark)
    return lambda df: df.checkpoint(eager=True)
