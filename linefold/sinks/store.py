"""Small files in a shared folder: written whole from tasks, and looked up."""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Files that a task holds at once.
HELD = 256


def local_path(uri: str) -> str | None:
    """The path of a URI on a mounted file system, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """One whole file; it appears under its name only when complete, and replaces an older one."""
    path = local_path(uri)
    if path is None:
        store, inner = _store(uri)
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def has(uri: str) -> bool:
    path = local_path(uri)
    if path is not None:
        return os.path.exists(path)
    from pyarrow import fs

    store, inner = _store(uri)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def get(uri: str) -> bytes | None:
    """The content of a file, None if there is none."""
    path = local_path(uri)
    try:
        if path is not None:
            with open(path, "rb") as file:
                return file.read()
        store, inner = _store(uri)
        with store.open_input_file(inner) as file:
            return file.read()
    except FileNotFoundError:
        return None


def names(folder: str) -> list[str]:
    """Names of the complete files in a folder; none if there is no such folder."""
    path = local_path(folder)
    if path is not None:
        held = os.listdir(path) if os.path.isdir(path) else []
    else:
        from pyarrow import fs

        store, inner = _store(folder)
        held = [f.base_name for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True))]
    return [name for name in held if not name.startswith(".")]


def with_text(rows: DataFrame, uri: str) -> DataFrame:
    """Rows with ``value``, the unpacked text of the file that a column names; rows whose file is missing go.

    Tasks read the files by name. For many small files that is far less than listing them and giving a task to each few.
    """
    schema, at = T.StructType([*rows.schema.fields, T.StructField("value", T.StringType())]), rows.columns.index(uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, HELD):
                part = batch.slice(a, HELD)
                places = part.column(at).to_pylist()
                held = [None if p is None else get(p) for p in places]
                found = pa.array([h is not None for h in held])
                texts = [(gzip.decompress(h) if p.endswith(".gz") else h).decode() for p, h in zip(places, held) if h is not None]
                kept = part.filter(found)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def _hadoop(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Asked on the driver, of any store Spark knows."""
    held, system = _hadoop(spark, path)
    return system.exists(held)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    held, system = _hadoop(spark, path)
    system.delete(held, True)
