"""Spark session defaults for evalpack jobs.

On a cluster the session is created by the platform; ``configure`` only fills
settings that are still unset, so cluster-provided values (shuffle partitions,
checkpoint directory) always win.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every evalpack job relies on. They do not change results except for
# the time zone (dates are compared as UTC) and the map-key policy (provenance
# stamping overwrites keys, last value wins).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark broadcasts a join side by itself, up to the default size.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


# Settings results depend on; always applied.
REQUIRED = ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy")


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``DEFAULTS``: required ones always, the rest only when unset."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if key in REQUIRED or conf.get(key, None) is None:
            conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "evalpack") -> SparkSession:
    """Session for tests and the local bench (local[N], UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.default.parallelism", str(cores))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only when it is unset in a single local process
    (tests, the local bench) a fresh scratch folder is created and registered;
    on a cluster a machine-local folder would not be shared, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="evalpack-ckpt-", dir=os.environ.get("EVALPACK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
