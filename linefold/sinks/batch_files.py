"""Folder target, one file per batch with its source's own settings, and the manifest of what was written.

The rows of a batch meet in one task, in order, and go through the compressor line by line; the task writes the file
and gives one manifest row for it. Folder, compression and level are columns, so any number of settings is one job
that runs the plan once, and nothing is read back to be counted. File names follow from stamp, epoch and batch, so a
repeated task or epoch replaces its own files.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.sinks import store
from linefold.sinks.folder import DEFAULT_LEVEL

MANIFEST = (
    "source_id STRING, session BIGINT, chunk BIGINT, filename STRING, timestamp STRING, count BIGINT, "
    "compressed BOOLEAN, compression_level INT"
)
#: Lines of a file; a batch is smaller, a whole minute or source goes on in another file.
MOST_LINES = 100_000


def folder_settings(sources: DataFrame) -> DataFrame:
    """Folder sources with compression on at the default level unless they say otherwise."""
    level = F.coalesce(F.col("compression_level").cast("int"), F.lit(DEFAULT_LEVEL))
    wrong = F.raise_error(F.lit("Compression level must be between 1 and 9")).cast("int")
    return sources.where(F.col("target_type") == "FOLDER").select(
        "source_id",
        "folder_path",
        F.coalesce(F.col("compression_enabled").cast("boolean"), F.lit(True)).alias("compressed"),
        F.when(level.between(1, 9), level).otherwise(wrong).alias("level"),
    )


def _file(folder: str, stamp: str, epoch: int, batch: tuple, part: int, compressed: bool) -> str:
    source, session, chunk = batch
    rest = f"-{part}" if part else ""
    return f"{folder.rstrip('/')}/{stamp}-{epoch}-{source}-{session}-{chunk}{rest}.json{'.gz' if compressed else ''}"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """(source, session, chunk, folder, compressed, level) and neighbouring lines of it."""
    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(7)])
        for key, group in itertools.groupby(rows, key=lambda r: r[:6]):
            yield key, [row[6] for row in group]


def written(lines: DataFrame, sources: DataFrame, stamp: str, epoch: int = 0) -> DataFrame:
    """Manifest rows of the files that evaluating this writes.

    ``lines`` has ``source_id, slot, line`` and ``session, chunk``, or ``minute``, which stands in the place of the
    chunk. An action runs it once; ``deliver`` does so by writing the manifest.
    """
    names = lines.columns
    session = F.col("session") if "session" in names else F.lit(0)
    chunk = F.col("chunk") if "chunk" in names else F.col("minute") if "minute" in names else F.lit(0)
    placed = lines.select("source_id", session.cast("bigint").alias("session"), chunk.cast("bigint").alias("chunk"), "slot", "line")
    placed = placed.join(folder_settings(sources), "source_id")
    keys = ["source_id", "session", "chunk"]
    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple]:
            for key, group in itertools.groupby(_pieces(batches), key=lambda p: p[0]):
                source, session, chunk, folder, compressed, level = key
                held = itertools.chain.from_iterable(part for _, part in group)
                for part in itertools.count():
                    some = itertools.islice(held, MOST_LINES)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31) if compressed else None
                    data, count = [], 0
                    for line in some:
                        raw = f"{line}\n".encode()
                        data.append(packer.compress(raw) if packer else raw)
                        count += 1
                    if not count:
                        break
                    if packer:
                        data.append(packer.flush())
                    name = _file(folder, stamp, epoch, key[:3], part, compressed)
                    store.put(name, b"".join(data))
                    yield source, session, chunk, name, stamp, count, compressed, level if compressed else None

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32()]
        fields = [f.split()[0] for f in MANIFEST.split(", ")]
        made = files()
        while some := list(itertools.islice(made, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*some), kinds)], names=fields)

    return ordered.select(*keys, "folder_path", "compressed", "level", "line").mapInArrow(write, MANIFEST)


def deliver(lines: DataFrame, sources: DataFrame, manifest: str, stamp: str, epoch: int = 0) -> None:
    """Write the files of an epoch and list them; a repeated epoch replaces its files and its part of the manifest."""
    written(lines, sources, stamp, epoch).write.mode("overwrite").parquet(f"{manifest}/epoch={epoch}")


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, epoch BIGINT").parquet(manifest)


def index_document(entries: DataFrame) -> DataFrame:
    """``folder, value``: the index of each folder as JSON, files in order of name."""
    folder = F.regexp_extract("filename", "^(.*)/[^/]*$", 1)
    entry = F.struct(
        F.regexp_extract("filename", "[^/]*$", 0).alias("filename"),
        "timestamp",
        "count",
        F.when(F.col("compressed"), True).alias("compressed"),
        "compression_level",
    )
    files = entries.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    return files.select("folder", F.to_json(F.struct("files")).alias("value"))
