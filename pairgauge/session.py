"""Session helpers. On a cluster the submitting side sets everything; this only fills gaps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairgauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only where none is named make a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError(
                "Set spark.checkpoint.dir to a folder that the driver and all executors share."
            )
        named = tempfile.mkdtemp(prefix="pairgauge-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


#: Row groups of tables whose rows are whole documents.
LONG_ROWS = 1 << 20


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write an intermediate result to the checkpoint folder and read it back.

    For small results that several later steps use: the lineage is cut, lost executors cost
    nothing, and the planner sees the true size when it chooses join strategies.

    A task reads up to 4096 rows of a row group at once, whatever their length; ``group_bytes`` (as written,
    compressed) keeps the groups of long rows small.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairgauge-{uuid.uuid4().hex}"
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
