"""HTTP Event Collector target: one POST per batch."""

from __future__ import annotations

import hashlib
import importlib
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceStreamWriter,
    DataSourceWriter,
    WriterCommitMessage,
)

from linefold.sinks import ledger, store

# Request settings.
TIMEOUT_SECONDS = 30
CONTENT_TYPE = "text/plain; charset=utf-8"

BODY_SCHEMA = (
    "source_id STRING, session LONG, chunk LONG, hec_url STRING, hec_token STRING, body STRING, events LONG, "
    "request_id STRING"
)


def post(url: str, token: str, body: str) -> int:
    """Send one body and return the status."""
    request = urllib.request.Request(
        url,
        data=body.encode("utf-8"),
        headers={"Authorization": f"Bearer {token}", "Content-Type": CONTENT_TYPE},
        method="POST",
    )
    with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as response:
        return response.status


def drop(url: str, token: str, body: str) -> int:
    """Poster for trial runs without a server: the body becomes a file in the folder that the address names."""
    data = body.encode("utf-8")
    store.put(f"{url.rstrip('/')}/{hashlib.sha256(data).hexdigest()}", data)
    return 200


def batch_bodies(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per batch: address, token, the joined lines in order, and an id of the request.

    A batch holds at most the batch size of its source, so its lines fit one row.
    """
    keys = ["source_id", "session", "chunk"]
    bodies = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "line"))).alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda p: p["line"]), "\n")
    return (
        bodies.join(sources.select("source_id", "hec_url", "hec_token"), "source_id")
        .select(*keys, "hec_url", "hec_token", body.alias("body"), F.size("_lines").cast("bigint").alias("events"))
        .withColumn("request_id", ledger.request_id(F.col("hec_url"), *[F.col(k) for k in keys], F.col("body")))
        .select(*keys, "hec_url", "hec_token", "body", "events", "request_id")
    )


@dataclass
class Posted(WriterCommitMessage):
    requests: int
    events: int


def _load(name: str) -> Callable[[str, str, str], int]:
    module, _, attribute = name.rpartition(":")
    return getattr(importlib.import_module(module), attribute)


@dataclass
class Sender:
    """Posts rows one by one; with a folder for records, leaves out what has one."""

    poster_name: str
    records: str | None

    def write(self, iterator: Iterator) -> Posted:
        poster = _load(self.poster_name)
        requests = events = 0
        for row in iterator:
            if self.records and ledger.recorded(self.records, row.request_id):
                continue
            status = poster(row.hec_url, row.hec_token, row.body)
            if status != 200:
                # A failed task is run again, from the first row without a record.
                raise RuntimeError(f"HEC request failed with status {status}")
            if self.records:
                ledger.record(self.records, row.request_id, (row.source_id, row.session, row.chunk), row.events, status)
            requests += 1
            events += row.events
        return Posted(requests, events)


class HecWriter(Sender, DataSourceWriter):
    pass


class HecStreamWriter(Sender, DataSourceStreamWriter):
    pass


class HecDataSource(DataSource):
    """``format("hec")`` for batch and streaming writes of request rows.

    Option ``poster`` names the sending function as ``module:name``; ``records`` is a shared folder in which each
    accepted request leaves a record and is not sent again.
    """

    @classmethod
    def name(cls) -> str:
        return "hec"

    def schema(self) -> str:
        return BODY_SCHEMA

    def _settings(self) -> tuple[str, str | None]:
        return self.options.get("poster", "linefold.sinks.hec:post"), self.options.get("records")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return HecWriter(*self._settings())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return HecStreamWriter(*self._settings())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HecDataSource)


def deliver(
    lines: DataFrame, sources: DataFrame, poster: str | None = None, book: ledger.Ledger | None = None, epoch: int = 0
) -> None:
    """Post every batch of the HEC sources; with a ledger, none that it holds as sent."""
    spark = lines.sparkSession
    register(spark)
    bodies = batch_bodies(lines, sources.where(F.col("target_type") == "HEC"))
    if book:
        bodies = bodies.join(book.sent(spark).select("request_id"), "request_id", "left_anti").select(*bodies.columns)
    writer = bodies.write.format("hec").mode("append")
    if poster:
        writer = writer.option("poster", poster)
    if book:
        writer = writer.option("records", book.open_folder(epoch))
    writer.save()
    if book:
        book.settle(spark, epoch)
