"""Delivery of an epoch to all its targets, evaluated once and committed target by target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.sinks import batch_files, hec, store
from linefold.sinks.ledger import Ledger

Target = Callable[[DataFrame, int], None]


class Dispatch:
    """Hands an epoch's lines to the target of each line's source.

    The lines are written once, split by target, and every target reads its own part; the plan never runs twice.
    A target that is through is entered in the commit log. An epoch that is run again, because a target failed or the
    driver was lost, starts from the written lines and leaves out the targets already entered, so one failing target
    does not make another repeat its work. Usable as the ``deliver`` of ``streaming.ingest``.
    """

    def __init__(self, place: str, targets: dict[str, Target]):
        self.place, self.targets = place.rstrip("/"), targets

    def __call__(self, lines: DataFrame, epoch: int) -> None:
        spark = lines.sparkSession
        held, failures = self.held(lines, epoch), []
        for name, deliver in self.targets.items():
            if self.committed(spark, epoch, name):
                continue
            try:
                deliver(held.where(F.col("target_type") == name), epoch)
            except Exception as error:  # the other targets go on; the epoch fails below
                failures.append((name, error))
                continue
            row = spark.range(1).select(F.current_timestamp().alias("at"))
            row.write.mode("overwrite").parquet(self._commit(epoch, name))
        if failures:
            name, error = failures[0]
            raise RuntimeError(f"epoch {epoch} is open for {', '.join(n for n, _ in failures)}") from error

    def _commit(self, epoch: int, name: str) -> str:
        return f"{self.place}/commits/epoch={epoch}/target={name}"

    def held(self, lines: DataFrame, epoch: int) -> DataFrame:
        """The lines of an epoch, from what was written if that is whole."""
        path = f"{self.place}/lines/epoch={epoch}"
        if not store.complete(lines.sparkSession, path):
            lines.write.mode("overwrite").partitionBy("target_type").parquet(path)
        return lines.sparkSession.read.schema(lines.schema).parquet(path)

    def committed(self, spark: SparkSession, epoch: int, name: str) -> bool:
        return store.complete(spark, self._commit(epoch, name))

    def commits(self, spark: SparkSession) -> DataFrame:
        """``epoch, target, at`` of everything that is through."""
        return spark.read.schema("at TIMESTAMP, epoch BIGINT, target STRING").parquet(f"{self.place}/commits")

    def forget(self, spark: SparkSession, epoch: int) -> None:
        """Drops the lines of an epoch that every target has."""
        if all(self.committed(spark, epoch, name) for name in self.targets):
            store.remove(spark, f"{self.place}/lines/epoch={epoch}")


def to_targets(place: str, sources: Callable[[SparkSession], DataFrame], stamp: str, poster: str | None = None) -> Dispatch:
    """Folder and HEC delivery of every source by its own settings; manifest and ledger lie in ``place``."""

    def to_folder(lines: DataFrame, epoch: int) -> None:
        batch_files.deliver(lines, sources(lines.sparkSession), f"{place}/manifest", stamp, epoch)

    def to_hec(lines: DataFrame, epoch: int) -> None:
        hec.deliver(lines, sources(lines.sparkSession), poster, Ledger(f"{place}/ledger"), epoch)

    return Dispatch(place, {"FOLDER": to_folder, "HEC": to_hec})
