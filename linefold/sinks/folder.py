"""Folder target: JSON lines, one file per batch or packed, with a manifest."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.sinks import store

# Fixed value: default gzip level.
DEFAULT_LEVEL = 9


def level_name(level: int) -> str:
    """Writer's name for a gzip level from 1 to 9."""
    if not 1 <= level <= 9:
        raise ValueError("Compression level must be between 1 and 9")
    if level <= 3:
        return "BEST_SPEED"
    return "DEFAULT_COMPRESSION" if level <= 6 else "BEST_COMPRESSION"


def write_lines(
    lines: DataFrame,
    folder: str,
    epoch: int = 0,
    compress: bool = True,
    level: int = DEFAULT_LEVEL,
    layout: str = "batch",
) -> None:
    """Write ``line`` under ``folder/epoch=N/source_id=.../``.

    ``layout='batch'`` gives every batch its own file ``session=.../chunk-N.txt``: the rows of a batch meet in one
    task, ordered by ``slot``; a batch is never longer than the batch size. Such files are small and many, so tasks
    write each at once and they share folders. ``layout='packed'`` writes large files per source without moving rows,
    for volumes where a file per batch is too many. An epoch written twice replaces itself.
    """
    target = f"{folder}/epoch={epoch}"
    if layout == "batch":
        _write_batches(lines, target, level if compress and level_name(level) else None)
    elif layout == "packed":
        writer = lines.select("source_id", "line").write.mode("overwrite").partitionBy("source_id")
        if compress:
            writer = writer.option("compression", "gzip").option("zlib.compress.level", level_name(level))
        writer.text(target)
    else:
        raise ValueError(f"unknown layout: {layout}")


def _folder_value(value: object) -> str:
    """A value as Spark names a partition folder by it."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(value))


def _write_batches(lines: DataFrame, target: str, level: int | None) -> None:
    """One file per batch, gzip at ``level`` unless that is None."""
    keys = ["source_id", "session", "chunk"]
    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, "slot").select(*keys, "line")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(i).to_pylist() for i in range(4)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for (source, session, chunk), rows in itertools.groupby(pieces(batches), key=lambda r: r[:3]):
            data = "".join(f"{'' if row[3] is None else row[3]}\n" for row in rows).encode()
            name = f"{target}/source_id={_folder_value(source)}/session={_folder_value(session)}/chunk-{chunk}.txt"
            if level is not None:
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                name, data = f"{name}.gz", packer.compress(data) + packer.flush()
            store.put(name, data)
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])

    spark = lines.sparkSession
    written = ordered.mapInArrow(write, "files BIGINT")
    if store.exists(spark, target):
        store.remove(spark, target)
    written.agg(F.sum("files")).first()
    store.put(f"{target}/_SUCCESS", b"")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered lines with their file and partition columns, and ``chunk`` where files are batches."""
    held, file = spark.read.text(folder), F.col("_metadata.file_path")
    chunk = []
    if "session" in held.columns:
        chunk = [F.regexp_extract(file, r"/chunk-(-?[0-9]+)\.txt(\.gz)?$", 1).cast("bigint").alias("chunk")]
    return held.select("*", *chunk, file.alias("file"))


def manifest_entries(
    spark: SparkSession, folder: str, epoch: int, stamp: str, compress: bool = True, level: int = DEFAULT_LEVEL
) -> DataFrame:
    """One row per written file, counted from what was written."""
    written = spark.read.text(f"{folder}/epoch={epoch}").select(
        F.col("_metadata.file_path").alias("filename")
    )
    return written.groupBy("filename").agg(F.count("*").alias("count")).select(
        "filename",
        F.lit(stamp).alias("timestamp"),
        "count",
        F.lit(compress).alias("compressed"),
        F.lit(level if compress else None).cast("int").alias("compression_level"),
    )


def append_manifest(entries: DataFrame, manifest: str, epoch: int) -> None:
    """Manifest table, one part per epoch; a repeated epoch replaces its part."""
    entries.write.mode("overwrite").parquet(f"{manifest}/epoch={epoch}")


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.parquet(manifest)


def deliver(
    lines: DataFrame,
    folder: str,
    manifest: str,
    stamp: str,
    epoch: int = 0,
    compress: bool = True,
    level: int = DEFAULT_LEVEL,
    layout: str = "batch",
) -> None:
    """Write an epoch and list its files."""
    write_lines(lines, folder, epoch, compress, level, layout)
    entries = manifest_entries(lines.sparkSession, folder, epoch, stamp, compress, level)
    append_manifest(entries, manifest, epoch)
