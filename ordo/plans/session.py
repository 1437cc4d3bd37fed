"""Session construction and cluster-level settings.

The library never hard-codes a machine-local path: the lineage-cutting folder
comes from ``spark.checkpoint.dir`` as the cluster names it, and a private
folder is only created when the setting is absent (unit tests on one host).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tunables read from the session (``spark.conf``) so a job can be resized
# without code changes.  Defaults target a local test box; on a cluster set
# them with ``--conf``.
CONF_BLOCKS = "ordo.blocks"  # least order-range blocks a hot key is split into
CONF_HOT_ROWS = "ordo.hotKeyRows"  # rows above which one key counts as hot
CONF_MAX_HOT_KEYS = "ordo.maxHotKeys"  # hot keys up to which their table is broadcast
CONF_BROADCAST_ROWS = "ordo.broadcastRows"  # row bound for a checked broadcast


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "ordo") -> SparkSession:
    """Session with the settings every operator here assumes are sensible."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; with a local master, create one if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="ordo-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value not in (None, "") else default


def default_blocks(spark: SparkSession) -> int:
    par = spark.sparkContext.defaultParallelism
    return conf_int(spark, CONF_BLOCKS, max(8, 4 * par))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_if_few(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """``df`` marked for a broadcast join if it has no more than ``most`` (or ``ordo.broadcastRows``) rows."""
    return F.broadcast(df) if rows <= conf_int(df.sparkSession, CONF_BROADCAST_ROWS, most) else df
