"""Helpers shared by the operators: scratch tables, appended columns, words and their hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to one call of a batch function; bounds the memory of a Python worker.
CHUNK_BYTES = 4 << 20
#: Text whose words are hashed at once, at some 40 bytes of memory for each of its own.
HASH_BYTES = 1 << 19

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}
SPARK = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="linefold-")
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    return f"file://{base}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts lineage, runs the plan once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that everything made from them has been written without.

    The driver's collector then lets go of what is not referenced any more, so that Spark clears the shuffle files
    of finished steps.
    """
    for path in paths:
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)
    gc.collect()
    spark._jvm.System.gc()


def local_path(uri: str) -> str | None:
    """The path of a URI on a mounted file system, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write_bytes(uri: str, data: bytes) -> None:
    """One whole file; it appears under its name only when complete."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(inner) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the folder is mounted, else read."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_input_file(inner) as file:
            return np.frombuffer(file.read(), dtype=dtype)
    if os.path.getsize(path) == 0:
        return np.empty(0, dtype=dtype)
    return np.memmap(path, dtype=dtype, mode="r")


def bucket_of(column: str, modulus: int) -> F.Column:
    """crc32 of a key as text modulo a number; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(lengths: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring rows of about `limit` bytes in all, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def add_columns(
    df: DataFrame,
    text: str,
    columns: dict[str, str],
    make: Callable[[], Callable[[list[str | None]], Sequence[Sequence]]],
) -> DataFrame:
    """df with columns computed from a text column, in Arrow batches, with no shuffle.

    `columns` maps names to types; `make` is called once per task and gives a function from a list of
    texts to one sequence per column. Every other column passes unchanged; a column of the same name
    is replaced, as in withColumn.
    """
    kept = [f for f in df.schema.fields if f.name not in columns]
    if text in columns:
        raise ValueError(f"{text} is read and can't be replaced")
    names = [f.name for f in kept]
    if len(set(names)) < len(names):
        raise ValueError("column names must differ")
    schema = T.StructType([*kept, *(T.StructField(n, SPARK[t]) for n, t in columns.items())])
    kinds = [ARROW[t] for t in columns.values()]
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                made = compute(part.column(place).to_pylist())
                arrays = [pa.array(v, type=k) for v, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*names, *columns])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def word_bytes(text: str | None, lower: bool) -> bytes:
    """Words `[^\\x20\\x09-\\x0D]+` joined by single spaces; bytes.split cuts at exactly these characters."""
    raw = (text or "").encode()
    return b" ".join((raw.lower() if lower else raw).split())


def hash_words(rows: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and the number of words of each row.

    A row is words joined by single spaces. The hash of a word depends on its bytes alone.
    """
    counts = np.array([r.count(b" ") + 1 if r else 0 for r in rows], dtype=np.int64)
    full = [r for r in rows if r]
    hashes = [_hashes(b" ".join(full[a:b])) for a, b in slices([len(r) for r in full], HASH_BYTES)]
    return np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64), counts


def _hashes(words: bytes) -> np.ndarray:
    stream = np.frombuffer(words, dtype=np.uint8)
    up, down = _powers(len(stream) + 1)
    sums = np.zeros(len(stream) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[stream] * up[: len(stream)], out=sums[1:])
    ends = np.append(np.flatnonzero(stream == 32), len(stream))
    starts = np.append(0, ends[:-1] + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def digest(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
