"""The ``{time, event, source}`` wrapper around every delivered line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.functions.values import json_string, strict_json


def event_value(raw: Column) -> Column:
    """Parsed JSON of any kind, else the line itself, as VARIANT."""
    return F.coalesce(strict_json(raw), raw.cast("variant"))


def envelope_json(time: Column, raw: Column, source_name: Column) -> Column:
    """One delivery line. JSON events are embedded as written, so numbers keep their text;
    line breaks between their tokens become spaces."""
    event = F.when(
        strict_json(raw).isNotNull(), F.regexp_replace(raw, "[\\r\\n]", " ")
    ).otherwise(json_string(raw))
    return F.concat(
        F.lit('{"time": '),
        time.cast("string"),
        F.lit(', "event": '),
        event,
        F.lit(', "source": '),
        json_string(source_name),
        F.lit("}"),
    )


def envelope(
    df: DataFrame, time: Column | None = None, raw: str = "raw", source_name: str = "source_name"
) -> DataFrame:
    """Add ``line``. ``time`` is the processing second unless given."""
    stamp = F.unix_timestamp(F.current_timestamp()) if time is None else time
    return df.withColumn("line", envelope_json(stamp, F.col(raw), F.col(source_name)))


def envelope_struct(
    df: DataFrame, time: Column | None = None, raw: str = "raw", source_name: str = "source_name"
) -> DataFrame:
    """Columns ``time, event, source`` with the event as VARIANT."""
    stamp = F.unix_timestamp(F.current_timestamp()) if time is None else time
    return df.select(
        stamp.cast("bigint").alias("time"),
        event_value(F.col(raw)).alias("event"),
        F.col(source_name).alias("source"),
    )
