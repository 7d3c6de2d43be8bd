"""Per-source metrics, status and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.functions.text import format_timestamp, severity_tag
from linefold.functions.values import ellipsize


def processed_metrics(delivered: DataFrame, ts: str = "recv_ts") -> DataFrame:
    """Lines after collapse and the last time, per source."""
    return delivered.groupBy("source_id").agg(
        F.count("*").alias("processed"), F.max(ts).alias("last_processed")
    )


def backlog(lines: DataFrame, delivered: DataFrame) -> DataFrame:
    """Lines of each source not yet delivered; both sides carry ``source_id, seq``."""
    waiting = lines.join(delivered.select("source_id", "seq"), ["source_id", "seq"], "left_anti")
    return waiting.groupBy("source_id").agg(F.count("*").alias("backlog"))


def status_report(
    sources: DataFrame,
    metrics: DataFrame,
    field_counts: DataFrame,
    policies: DataFrame,
    waiting: DataFrame | None = None,
) -> DataFrame:
    """One status row per source, unset parts included."""
    enabled = policies.select(
        "source_id", F.coalesce(F.col("enabled"), F.lit(False)).alias("collapses")
    )
    out = (
        sources.select("source_id", "source_name", "listener_port", "protocol", "target_type")
        .join(metrics, "source_id", "left")
        .join(field_counts, "source_id", "left")
        .join(enabled, "source_id", "left")
    )
    if waiting is None:
        out = out.withColumn("backlog", F.lit(0).cast("bigint"))
    else:
        out = out.join(waiting, "source_id", "left")
    template = F.when(
        F.col("fields").isNotNull(), F.concat(F.lit("[T:"), F.col("fields").cast("string"), F.lit("]"))
    )
    return out.select(
        "source_id",
        ellipsize(F.col("source_name"), 18, 16, "..").alias("name"),
        F.coalesce("backlog", F.lit(0)).cast("bigint").alias("backlog"),
        F.coalesce("processed", F.lit(0)).cast("bigint").alias("processed"),
        format_timestamp(F.col("last_processed")).alias("last_activity"),
        F.concat_ws(" ", template, F.when(F.col("collapses"), F.lit("[A]"))).alias("marks"),
    )


def health_sources(
    sources: DataFrame, waiting: DataFrame | None = None, workers: DataFrame | None = None
) -> DataFrame:
    """Health row per source *name*; of equal names the last source counts.

    Where ``waiting`` has a ``moment``, as ``backlog_at`` gives it, there is a row per name and moment.
    """
    out = sources.select("source_id", "source_name", "listener_port", "protocol", "target_type")
    none = F.lit(0).cast("bigint")
    out = out.join(waiting, "source_id", "left") if waiting is not None else out.withColumn("backlog", none)
    out = (
        out.join(workers, "source_id", "left")
        if workers is not None
        else out.withColumn("active_workers", none)
    )
    keys = [c for c in ("moment",) if c in out.columns]
    return (
        out.groupBy("source_name", *keys)
        .agg(
            F.max_by(
                F.struct(
                    F.coalesce("backlog", none).alias("queue_size"),
                    F.coalesce("active_workers", none).alias("active_processors"),
                    F.col("listener_port").alias("listener_port"),
                    F.col("protocol").alias("protocol"),
                    F.col("target_type").alias("target_type"),
                ),
                "source_id",
            ).alias("s")
        )
        .select("source_name", *keys, "s.*")
    )


def load_percent(load: Column, cpu_count: Column) -> Column:
    return F.transform(load, lambda x: x / cpu_count * 100)


def backlog_at(
    lines: DataFrame, delivered: DataFrame, moments: DataFrame, ts: str = "recv_ts", done: str = "delivered_ts"
) -> DataFrame:
    """``source_id, moment, backlog``: lines received and not delivered before each moment, for every source.

    Moments count by whole second. Lines combine to one row per source and second before they
    meet the moments, so the running totals go over seconds, not lines. The result has a row
    per source and moment, as the heartbeats that report them have.
    """
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    steps = lines.groupBy("source_id", second(ts).alias("_s")).agg(F.count("*").alias("_n"))
    steps = steps.unionByName(delivered.groupBy("source_id", second(done).alias("_s")).agg((-F.count("*")).alias("_n")))
    every = moments.agg(F.array_distinct(F.collect_list(F.unix_timestamp(F.col("moment").cast("timestamp")))).alias("m"))
    asked = lines.select("source_id").distinct().withColumn("_s", F.explode(every.scalar()))
    both = steps.withColumn("_asked", F.lit(False)).unionByName(
        asked.select("source_id", "_s", F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_asked"))
    )
    # Untimed lines count as received from the start.
    before = Window.partitionBy("source_id").orderBy(F.col("_s").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return both.withColumn("backlog", total).where("_asked").select(
        "source_id", F.timestamp_seconds("_s").alias("moment"), "backlog"
    )


def _map_by_name(entry: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def _named_sources() -> Column:
    stats = F.struct("queue_size", "active_processors", "listener_port", "protocol", "target_type")
    return _map_by_name(F.struct(F.col("source_name"), stats)).alias("sources")


#: Parts of a heartbeat and the host columns they are made of.
HOST_PARTS = {
    "memory": {"total": "mem_total", "available": "mem_available", "percent": "mem_percent", "used": "mem_used"},
    "disk": {"total": "disk_total", "used": "disk_used", "free": "disk_free", "percent": "disk_percent"},
    "network": {c: c for c in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv")},
}


def heartbeat(health: DataFrame, host_metrics: DataFrame, time: Column | None = None) -> DataFrame:
    """Heartbeat documents: one per host metrics row, with all sources by name.

    Host columns that are missing are left out of the document. Where ``health`` has a
    ``moment``, each host row gets the sources as they were then; else all get the same.
    """
    stamp = F.unix_timestamp(F.col("ts").cast("timestamp")) if time is None else time
    if "moment" in health.columns:
        then = health.groupBy(F.unix_timestamp("moment").alias("_at")).agg(_named_sources())
        at = F.unix_timestamp(F.col("ts").cast("timestamp"))
        joined = host_metrics.withColumn("_at", at).join(then, "_at", "left").drop("_at")
    else:
        # One row, of the size of the registry: a scalar subquery, so host rows are not joined.
        joined = host_metrics.withColumn("sources", health.agg(_named_sources()).scalar())
    parts = [
        F.struct(
            F.col("cpu_percent").alias("percent"),
            F.col("cpu_count").alias("count"),
            load_percent(F.col("load"), F.col("cpu_count")).alias("load"),
        ).alias("cpu")
    ]
    for part, names in HOST_PARTS.items():
        held = [F.col(column).alias(name) for name, column in names.items() if column in host_metrics.columns]
        if held:
            parts.append(F.struct(*held).alias(part))
    parts += [F.col("sources"), *[F.col(c) for c in ("pid", "process_memory") if c in host_metrics.columns]]
    return joined.select(
        stamp.cast("bigint").alias("time"), F.struct(*parts).alias("event"), F.lit("Heartbeat").alias("source")
    )


def tail(lines: DataFrame, count: int = 100, order: list[str] | None = None) -> DataFrame:
    """Last ``count`` lines in order: by file and place in it where the lines have those."""
    keys = order or [c for c in ("file", "block", "ord") if c in lines.columns]
    last = lines.orderBy(*[F.desc(k) for k in keys]).limit(count)
    return last.orderBy(*keys)


def severity_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.groupBy(severity_tag(F.col(line)).alias("tag")).agg(F.count("*").alias("lines"))
