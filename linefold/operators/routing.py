"""Attribution of raw messages to configured sources, and what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_address(sources: DataFrame, order: str | None = None) -> DataFrame:
    """``(port, source_ip) -> source_id``; of equal addresses the last source counts.

    ``order`` names the registry order; by default it is ``position`` where the sources
    have one, else the greatest ``source_id`` is last.
    """
    rank = F.col(order or ("position" if "position" in sources.columns else "source_id"))
    return sources.groupBy(
        F.col("listener_port").cast("int").alias("port"), "source_ip"
    ).agg(F.max_by("source_id", rank).alias("source_id"))


def open_ports(sources: DataFrame) -> DataFrame:
    """Ports and transports that some source listens on."""
    return sources.select(
        F.col("listener_port").cast("int").alias("port"), F.col("protocol").alias("transport")
    ).distinct()


def attribute(raw: DataFrame, sources: DataFrame, order: str | None = None) -> DataFrame:
    """Messages on an open port from a configured address, with their ``source_id``.

    The address list of a port holds every source on it, whatever its protocol.
    """
    listened = raw.join(open_ports(sources), ["port", "transport"], "left_semi")
    return listened.join(latest_by_address(sources, order), ["port", "source_ip"])


def unauthorized(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages on an open port from an address not configured there."""
    listened = raw.join(open_ports(sources), ["port", "transport"], "left_semi")
    known = sources.select(F.col("listener_port").cast("int").alias("port"), "source_ip")
    return listened.join(known, ["port", "source_ip"], "left_anti")


def unauthorized_counts(raw: DataFrame, sources: DataFrame) -> DataFrame:
    return unauthorized(raw, sources).groupBy("port", "source_ip").agg(
        F.count("*").alias("messages")
    )


def with_source_settings(logs: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """Lines of known sources with the named settings."""
    return logs.join(sources.select("source_id", *columns), "source_id")


def unknown_sources(logs: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines whose source is no longer configured."""
    return logs.join(sources.select("source_id"), "source_id", "left_anti")


def with_source_name(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules or policies with the source's name, ``Unknown`` where it is gone."""
    return items.join(sources.select("source_id", "source_name"), "source_id", "left").withColumn(
        "source_name", F.coalesce("source_name", F.lit("Unknown"))
    )


def sources_without_policy(sources: DataFrame, policies: DataFrame) -> DataFrame:
    return sources.join(policies.select("source_id"), "source_id", "left_anti")


def sources_with_template(sources: DataFrame, templates: DataFrame) -> DataFrame:
    return sources.join(templates.select("source_id"), "source_id", "left_semi")


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One table of lines from several lanes; absent columns become null."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
