"""Session defaults and shared-folder helpers.

Cluster settings win: a default here is applied only when the key is still
unset, so a job submitted with its own shuffle width, event log or checkpoint
folder keeps them. The one exception is the session time zone, which is set to
UTC: stored dates and hours are UTC texts, and any other zone would shift them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the package relies on, applied only where the session leaves them
# unset. Dates are stored as strings, but the fixture views format timestamps,
# so the zone is pinned.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the package defaults to an existing session, leaving set keys alone."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    # Time zone is a correctness setting, not a tuning one.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "rankspark", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark (UI off, no server ports).

    ``checkpoint_dir`` plays the part of the shared folder a cluster would name.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Falls back to the context's checkpoint dir; raises if neither is set, so a
    cluster job never silently writes state to a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
