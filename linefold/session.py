"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_CONF = {
    # Repeated JSON keys and repeated key=value keys: the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Epoch arithmetic and date text must not depend on the machine.
    "spark.sql.session.timeZone": "UTC",
}

#: How many times its share of the rows a core may get.
UNEVEN = 1.5


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app_name: str = "linefold", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small inputs are heavy on expressions, not on bytes: keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder the cluster names, or ``fallback`` where none is named."""
    return spark.conf.get("spark.checkpoint.dir", None) or fallback


def spread(rows: DataFrame) -> DataFrame:
    """Rows of which some cores would get far more than their share, dealt over all cores.

    Reading text is far more work than moving it. One file with one row group is one task, into however many splits
    the file is cut, so what counts is the rows in each split; they come from the footers alone. Inputs that fill the
    cores evenly, as all large ones, stay as they are.
    """
    if rows.isStreaming:
        return rows
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.groupBy(F.spark_partition_id().alias("split")).count()
    most, total, held = splits.agg(F.max("count"), F.sum("count"), F.count("*")).first()
    if not total or most * cores <= UNEVEN * total:
        return rows
    return rows.repartition(max(cores, held))


def scratch(spark: SparkSession, name: str = "run") -> str:
    """A new place in the shared folder the cluster names, or in a local one on a local master."""
    shared = checkpoint_folder(spark)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again.

    For rows that are dear to make and used more than once: they are made once, later steps
    read the columns they need, and a lost executor costs no more than reading them again.
    """
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
