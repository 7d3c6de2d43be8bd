"""Collapse of look-alike lines by the values of chosen fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.functions.extract import named_text_examples
from linefold.functions.values import (
    bind,
    is_object,
    object_fields,
    path_in,
    strict_json,
    strip,
    value_text,
)
from linefold.operators.batching import minute_of

# Names of the fields added to a collapsed line.
META_NAMES = ["is_aggregated", "first_log_time", "last_log_time", "total_logs_aggregated"]


def active_policies(policies: DataFrame) -> DataFrame:
    """``source_id, policy_fields`` of enabled policies; a missing flag means disabled."""
    return policies.where(
        F.coalesce(F.col("enabled"), F.lit(False)) & (F.size("fields") > 0)
    ).select("source_id", F.col("fields").alias("policy_fields"))


def key_of(raw: str, event: Column, fields: Column, mode: str = "compat") -> Column:
    """MD5 of the joined field values of a line already parsed to ``event``."""
    none = F.lit("None")

    def of_text(pairs: Column) -> Column:
        return F.transform(
            fields,
            lambda f: F.when(F.contains(f, F.lit(".")), none).otherwise(
                F.coalesce(F.try_element_at(pairs, f), none)
            ),
        )

    def of_json(held: Column) -> Column:
        # JSON that is not an object has none of the fields.
        return F.transform(fields, lambda f: F.coalesce(value_text(path_in(held, f)), none))

    values = F.when(event.isNull(), bind(named_text_examples(raw, mode), of_text)).otherwise(
        bind(object_fields(event), of_json)
    )
    return F.when(fields.isNotNull(), F.md5(F.array_join(values, "|").cast("binary")))


def collapse_key(raw: str, fields: Column, mode: str = "compat") -> Column:
    """MD5 of the joined field values of column ``raw``; ``None`` for an absent or null one.

    JSON fields are dotted paths. Text fields are those of key=value or free text. Null
    where ``fields`` is null.
    """
    key = bind(strict_json(F.col(raw)), lambda event: key_of(raw, event, fields, mode))
    return F.when(fields.isNotNull(), key)


def with_collapse_key(
    df: DataFrame, policies: DataFrame, raw: str = "raw", mode: str = "compat"
) -> DataFrame:
    """Add ``agg_key``: null where the source has no active policy."""
    joined = df.join(active_policies(policies), "source_id", "left")
    return joined.withColumn("agg_key", collapse_key(raw, F.col("policy_fields"), mode)).drop(
        "policy_fields"
    )


def _epoch_seconds(us: Column) -> Column:
    return (us.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(20,6)").cast("string")


def _without_meta(json_object: Column) -> Column:
    """JSON object text, with fields named like the added ones removed."""
    kept = F.map_filter(
        F.try_variant_get(F.try_parse_json(json_object), "$", "map<string,variant>"),
        lambda name, _: ~name.isin(META_NAMES),
    )
    clash = json_object.rlike('"(' + "|".join(META_NAMES) + ')"')
    return F.when(clash, F.to_json(kept)).otherwise(json_object)


def render(
    name: str, n: Column, first_us: Column, last_us: Column, mode: str = "compat"
) -> Column:
    """Text of a collapsed line whose first line is in column ``name``.

    One line stays as it is. A JSON object or a text line becomes a JSON object with the
    four added fields, any other JSON gets a note behind it.
    """
    raw = F.col(name)
    tail = F.concat(
        F.lit('"is_aggregated": "yes", "first_log_time": '),
        _epoch_seconds(first_us),
        F.lit(', "last_log_time": '),
        _epoch_seconds(last_us),
        F.lit(', "total_logs_aggregated": '),
        n.cast("string"),
        F.lit("}"),
    )
    note = F.concat(raw, F.lit(" [Aggregated: "), n.cast("string"), F.lit(" logs]"))

    def enhanced(json_object: Column) -> Column:
        head = F.regexp_replace(strip(_without_meta(json_object)), "[ \\t\\r\\n]*\\}$", "")
        return bind(
            head,
            lambda h: F.concat(
                h, F.when(h.rlike("^\\{[ \\t\\r\\n]*$"), F.lit("")).otherwise(F.lit(", ")), tail
            ),
        )

    def of_event(event: Column) -> Column:
        fields = F.when(event.isNull(), F.to_json(named_text_examples(name, mode))).when(
            is_object(event), raw
        )
        return bind(
            fields, lambda f: F.when(f.isNull(), note).otherwise(enhanced(f))
        )

    return F.when(n == 1, raw).otherwise(bind(strict_json(raw), of_event))


def collapse(
    df: DataFrame,
    scope: str = "batch",
    raw: str = "raw",
    ts: str = "recv_ts",
    seq: str = "seq",
    key: Column | str = "agg_key",
    failed: str | None = None,
    mode: str = "compat",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per key of a scope: ``raw, n, first_us, last_us, slot``.

    ``scope`` is ``batch`` (needs the columns of ``assign_batches``), ``minute`` or ``all``.
    Rows without a key pass through. Counts and edges combine before the shuffle, so a key
    that covers most of the input is no hot spot. ``slot`` is the arrival position used for
    ordered output. ``failed`` names a boolean column of rows whose key could not be made:
    they stay as they are, together at the slot of the first of them in the batch.
    ``carry`` names columns that are the same for all lines of a source.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    kept = [F.col(c) for c in carry or []]
    if scope == "batch":
        scope_keys = {"session": F.col("session"), "chunk": F.col("chunk")}
        order = F.col("place")
    elif scope == "minute":
        scope_keys = {"minute": minute_of(F.col(ts))}
        order = F.struct(us, F.col(seq))
    elif scope == "all":
        scope_keys = {}
        order = F.struct(us, F.col(seq))
    else:
        raise ValueError(f"unknown scope: {scope}")

    key = F.col(key) if isinstance(key, str) else key
    keyed = key if failed is None else F.when(~F.col(failed), key)
    # Times and numbers can repeat, so a row without a key is named by itself.
    alone = F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string"))
    keys = ["source_id", *(carry or []), *scope_keys, "_key"]
    rows = df.select(
        "source_id",
        *kept,
        *[column.alias(name) for name, column in scope_keys.items()],
        F.coalesce(keyed, alone).alias("_key"),
        F.col(raw).alias("_line"),
        us.alias("_us"),
        order.alias("_order"),
        *([] if failed is None else [F.col(failed).alias("_failed")]),
    )
    aggregates = [
        F.count("*").alias("n"),
        F.min_by("_line", "_order").alias("raw"),
        F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"),
        F.min("_order").alias("slot"),
    ]
    if failed is not None:
        aggregates.append(F.bool_or("_failed").alias("_failed"))
    groups = rows.groupBy(*keys).agg(*aggregates)
    text = render("raw", F.col("n"), F.col("first_us"), F.col("last_us"), mode)
    columns = [*keys[:-1], text.alias(raw), "n", "first_us", "last_us"]
    if failed is None:
        return groups.select(*columns, "slot")
    together = Window.partitionBy("source_id", *scope_keys, "_failed")
    own = F.col("slot")
    slot = F.when(F.col("_failed"), F.min(own).over(together)).otherwise(own)
    return groups.select(*columns, slot.alias("slot"), own.alias("slot_order"))


def reduction_stats(batched: DataFrame, key: str = "agg_key") -> DataFrame:
    """Lines in and out per batch."""
    alone = F.count_if(F.col(key).isNull())
    return batched.groupBy("source_id", "session", "chunk").agg(
        F.count("*").alias("rows_in"),
        (F.count_distinct(F.col(key)) + alone).alias("rows_out"),
    )
