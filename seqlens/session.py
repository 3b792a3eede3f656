"""Session helpers.

A session that runs already, or that ``spark-submit`` starts, is used as it is
configured. Only a session that a plain Python program builds (tests, local
runs) gets the settings below.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "seqlens", extra: dict | None = None) -> SparkSession:
    """The running session, unchanged; or a new one. Under ``spark-submit`` its
    settings hold; otherwise the arguments make a local session."""
    running = SparkSession.getActiveSession()
    if running is not None:
        return running
    builder = SparkSession.builder.appName(app_name)
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # not started by spark-submit
        conf = {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **(extra or {})}
        builder = builder.master(master).config(map=conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only a local-mode session without one (tests) gets a fresh scratch
    folder; a cluster session without one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        # a machine-local folder is not reachable by other executors
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    local = tempfile.mkdtemp(prefix="seqlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()
