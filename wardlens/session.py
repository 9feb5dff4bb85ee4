"""Session helpers: a tuned builder for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Shuffle settings that hold from local[8] up to a large cluster: AQE
# coalesces small shuffle partitions and splits skewed join partitions at
# run time, so the static partition count only needs to be an upper bound.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Wide projections (the 48-column feature matrix) fuse into one method
    # larger than HotSpot will JIT-compile (8000 bytes); past that size,
    # Spark's per-operator code is faster than an interpreted fused method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "wardlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only invent one when unset.

    On a cluster the setting names a shared folder that survives executor
    loss.  A private temp folder is created only for local runs (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="wardlens-ckpt-", dir=os.environ.get("TMPDIR") or "/tmp")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared checkpoint dir.

    Used where one intermediate feeds several outputs, so a lost executor
    re-reads the checkpoint instead of recomputing the whole upstream plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
