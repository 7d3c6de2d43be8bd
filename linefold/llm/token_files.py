"""Token ids as flat files: unsigned integers of all documents in order, and 64-bit document offsets.

`write` range-partitions documents by id, encodes each partition and writes three files for it in the
shared folder: `.ids` (ids back to back, 16 bits wide if the vocabulary allows, else 32), `.offsets`
(64-bit, one more than documents, from 0) and `.keys` (64-bit document ids, ascending). The manifest has
one row per partition; where a partition starts in the whole corpus is the prefix sum of the counts of
those before it. `read` maps the files into memory, a partition per row of the manifest.

A file gets a fresh name in each attempt of a task and only the manifest row of the attempt that
succeeded names it, so lost executors and repeated tasks do no harm. Rows with equal ids keep an order
by text. A null id is written as the lowest 64-bit integer and read back as null. A null text counts as
empty: only its end id is written. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.llm.common import digest, mapped, slices, write_bytes
from linefold.llm.encoder import encoder

NULL_KEY = np.iinfo(np.int64).min
MANIFEST = "part long, name string, width string, documents long, tokens long"


@dataclass(frozen=True)
class TokenFiles:
    """A written corpus: its folder and one entry per partition, in corpus order, with its base."""

    folder: str
    parts: list[tuple[str, str, int]]  # name, integer type, ids before the partition


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encodes and writes all documents in ascending order of their ids."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, keys, counts, pieces, part = encoder(tokenizer), [], [], [], None
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(sizes):
                rows = batch.slice(a, b - a)
                part = rows.column(2)[0].as_py()
                keys.append(rows.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
                for ids in coder.encode(rows.column(1).to_pylist()):
                    pieces += [ids.tobytes(), np.array([end_id], dtype=coder.width).tobytes()]
                    counts.append(len(ids) + 1)
        if part is None:
            return
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
        write_bytes(f"{name}.ids", b"".join(pieces))
        write_bytes(f"{name}.offsets", np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
        write_bytes(f"{name}.keys", np.concatenate(keys).astype("<i8").tobytes())
        row = [[part], [name], [coder.width], [len(counts)], [int(sum(counts))]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(row, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
            names=["part", "name", "width", "documents", "tokens"],
        )

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("body"))
    ordered = source.repartitionByRange("key", F.xxhash64("body")).sortWithinPartitions("key", "body")
    numbered = ordered.withColumn("part", F.spark_partition_id().cast("long"))
    # One row per partition: as many as tasks, not documents.
    manifest = sorted(numbered.mapInArrow(save, MANIFEST).collect())
    bases = np.concatenate([[0], np.cumsum([m.tokens for m in manifest], dtype=np.int64)])
    return TokenFiles(folder, [(m.name, m.width, int(b)) for m, b in zip(manifest, bases)])


def read(
    spark: SparkSession, files: TokenFiles, derive: Callable[[np.ndarray], object], name: str, kind: str
) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and what `derive` makes of its ids.

    Each task maps the files of its partitions; ids are never copied as a whole.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, width, base in zip(frame.name, frame.width, frame.base):
                ids = mapped(f"{at}.ids", width)
                offsets = mapped(f"{at}.offsets", "<u8").astype(np.int64)
                keys = mapped(f"{at}.keys", "<i8")
                for a in range(0, len(keys), 20_000):
                    b = min(len(keys), a + 20_000)
                    made = [derive(ids[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
                    chunk = pd.Series(np.asarray(keys[a:b])).astype("Int64")
                    yield pd.DataFrame(
                        {
                            "doc_id": chunk.mask(chunk == NULL_KEY),
                            "start": offsets[a:b] + base,
                            "n_tokens": np.diff(offsets[a : b + 1]),
                            name: made,
                        }
                    )

    n = max(1, len(files.parts))
    rows = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(files.parts)], "part long, name string, width string, base long"
    ).repartition(n)
    return rows.mapInPandas(load, f"doc_id long, start long, n_tokens long, {name} {kind}")


def read_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    return read(spark, files, digest, "ids_crc32", "long")
