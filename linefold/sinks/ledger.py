"""What was sent to HTTP targets, so that nothing accepted is sent again.

Each accepted request leaves a record, a small file named by its id, before the next one is sent. A task that is run
again looks its requests up one by one and sends the rest. Records are dealt over folders, so that tasks list and read
them. When all requests of an epoch are through, its records become one part of the ledger's table, which later epochs are compared with as a whole. A request that was accepted
while its record could not be written is sent again: delivery is at least once, and once in all other cases.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.sinks import store

RECORD = "request_id STRING, source_id STRING, session BIGINT, chunk BIGINT, events BIGINT, status INT"
#: Folders over which the records of an epoch are dealt.
FOLDERS = 256


def request_id(*parts: Column) -> Column:
    """An id from what a request is about; no two lists of parts agree in it."""
    sized = [F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in sized]).cast("binary"), 256)


def _place(open_folder: str, request: str) -> str:
    return f"{open_folder}/{zlib.crc32(request.encode()) % FOLDERS}/{request}"


def recorded(open_folder: str, request: str) -> bool:
    return store.has(_place(open_folder, request))


def record(open_folder: str, request: str, batch: tuple[str, int, int], events: int, status: int) -> None:
    body = dict(zip(("request_id", "source_id", "session", "chunk", "events", "status"), (request, *batch, events, status)))
    store.put(_place(open_folder, request), json.dumps(body).encode())


def records(spark: SparkSession, open_folder: str) -> DataFrame:
    """The records of an open epoch."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    fields = [f.split()[0] for f in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                folder = f"{open_folder}/{number}"
                names = store.names(folder)
                for a in range(0, len(names), store.HELD):
                    held = [json.loads(store.get(f"{folder}/{name}")) for name in names[a : a + store.HELD]]
                    arrays = [pa.array([r[f] for r in held], k) for f, k in zip(fields, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=fields)

    return spark.range(0, FOLDERS, 1, FOLDERS // 8).mapInArrow(read, RECORD)


class Ledger:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def open_folder(self, epoch: int) -> str:
        return f"{self.folder}/open/epoch={epoch}"

    def sent(self, spark: SparkSession) -> DataFrame:
        """Requests of settled epochs."""
        if not store.exists(spark, f"{self.folder}/sent"):
            return spark.createDataFrame([], f"{RECORD}, epoch BIGINT")
        return spark.read.schema(f"{RECORD}, epoch BIGINT").parquet(f"{self.folder}/sent")

    def settle(self, spark: SparkSession, epoch: int) -> None:
        """Records of an epoch become a part of the table."""
        place = self.open_folder(epoch)
        if not store.exists(spark, place):
            return
        held = records(spark, place)
        # A repeated epoch adds to what an earlier attempt settled.
        before = self.sent(spark).where(F.col("epoch") == epoch).select(*held.columns)
        part, new = f"{self.folder}/sent/epoch={epoch}", f"{self.folder}/new/epoch={epoch}"
        held.unionByName(before).distinct().write.mode("overwrite").parquet(new)
        spark.read.schema(RECORD).parquet(new).write.mode("overwrite").parquet(part)
        store.remove(spark, place)
