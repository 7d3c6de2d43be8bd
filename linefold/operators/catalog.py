"""Templates and field catalogs: what fields the lines of a source carry."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.functions.extract import detect_format, named_fields
from linefold.functions.values import bind, ellipsize, is_object, strict_json, strip
from linefold.operators.ordering import micros
from linefold.session import staged

# Fields shown first in a catalog and in a preview.
SPECIAL_FIELDS = [
    "timestamp", "message", "log_level", "severity", "level", "host", "source", "ip_address",
]
PREVIEW_FIELDS = ["timestamp", "message", "log_level", "host", "severity", "source"]
PREVIEW_COUNT = 3


def has_text(raw: Column) -> Column:
    return F.length(strip(raw)) > 0


def is_extractable(raw: Column) -> Column:
    """False for JSON that is not an object. Only lines that may be such are parsed."""
    candidate = raw.rlike('^[ \\t\\r\\n]*[\\["\\-0-9tfn]')
    return ~candidate | bind(strict_json(raw), lambda event: event.isNull() | is_object(event))


def first_lines(logs: DataFrame, skip_blank: bool = False) -> DataFrame:
    """First line per source that can become a template: ``source_id, raw, recv_ts, seq``."""
    usable = logs.where(is_extractable(F.col("raw")))
    if skip_blank:
        usable = usable.where(has_text(F.col("raw")))
    arrival = F.struct("recv_ts", "seq")
    return (
        usable.groupBy("source_id")
        .agg(F.min_by(F.struct("raw", "recv_ts", "seq"), arrival).alias("first"))
        .select("source_id", "first.*")
    )


def learn_templates(logs: DataFrame, mode: str = "compat", skip_blank: bool = False) -> DataFrame:
    """``source_id, raw, fields, learned`` from the first usable line of each source."""
    first = first_lines(logs, skip_blank)
    raw = F.col("raw")
    form = bind(strict_json(raw), lambda event: detect_format(raw, event))
    return first.withColumn("form", form).select(
        "source_id",
        "raw",
        "form",
        named_fields("raw", "form", mode).alias("fields"),
        F.col("recv_ts").alias("learned"),
    )


def new_templates(logs: DataFrame, known: DataFrame, mode: str = "compat") -> DataFrame:
    """Templates for sources that have none yet."""
    waiting = logs.join(known.select("source_id"), "source_id", "left_anti")
    return learn_templates(waiting, mode)


def template_catalog(templates: DataFrame) -> DataFrame:
    """One row per field of a template, with its place."""
    return templates.select("source_id", F.posexplode("fields").alias("ordinal", "f")).select(
        "source_id",
        F.col("f.field").alias("field"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("f.type").alias("type"),
        F.col("f.example").alias("example"),
        F.col("f.formatted").alias("formatted"),
        F.col("f.length").alias("length"),
        F.col("f.original").alias("original"),
        F.col("f.format").alias("format"),
    )


def template_field_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("source_id").agg(F.count("*").alias("fields"))


def format_counts(logs: DataFrame) -> DataFrame:
    """Lines per source and form."""
    raw = F.col("raw")
    form = bind(strict_json(raw), lambda event: detect_format(raw, event))
    return logs.groupBy("source_id", form.alias("form")).agg(F.count("*").alias("lines"))


def line_fields(logs: DataFrame, mode: str = "compat", place: Column | None = None) -> DataFrame:
    """Every field of every line, with the line's time and number, or with ``place``."""
    line = ["source_id", "recv_ts", "seq"] if place is None else ["source_id", place.alias("place")]
    raw = F.col("raw")
    form = bind(strict_json(raw), lambda event: detect_format(raw, event))
    # Generated, so the form is found once although several branches ask for it.
    formed = logs.select(*line, "raw", F.explode(F.array(form)).alias("form"))
    return formed.select(
        *formed.columns[:-2],
        F.posexplode(named_fields("raw", "form", mode)).alias("ordinal", "f"),
    )


def _arrival(ts: str = "recv_ts", seq: str = "seq") -> Column:
    """``(ts, seq)`` as one number of the same order, nulls first: a fixed width, so aggregates of it stay in hash tables.

    Times further than 126,000 years from 1970 count as equal.
    """
    far, span = 4 * 10**18, 2**64 + 1
    us = micros(F.col(ts)).cast("decimal(19,0)")
    near = F.greatest(F.least(us, F.lit(Decimal(far))), F.lit(Decimal(-far)))
    us = F.when(us.isNull(), F.lit(Decimal(-far - 1))).otherwise(near)
    number = F.coalesce(F.col(seq).cast("bigint").cast("decimal(19,0)") + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))
    return (us * F.lit(Decimal(span)) + number).cast("decimal(38,0)")


def field_counts(logs: DataFrame, mode: str = "compat") -> DataFrame:
    """``source_id, field, type, n, longest`` and ``first``, the arrival of the first line with the field."""
    fields = line_fields(logs, mode, place=_arrival())
    return fields.groupBy("source_id", F.col("f.field").alias("field"), F.col("f.type").alias("type")).agg(
        F.count("*").alias("n"), F.max(F.length("f.example")).alias("longest"), F.min("place").alias("first")
    )


def field_catalog(logs: DataFrame, mode: str = "compat") -> DataFrame:
    """Per source and field over all lines: rows, type mix, first example, longest value.

    Counts combine by type before the shuffle; the second step joins the few types of a
    field. Fields by far outnumber lines, so they are only counted, by hash and without
    their text; examples are read again from the lines that are the first of some field.
    """
    counted = field_counts(logs, mode).groupBy("source_id", "field").agg(
        F.sum("n").alias("rows"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.max("longest").cast("bigint").alias("longest"),
        F.min("first").alias("first"),
    )
    counted = staged(counted, "fields")
    lines = logs.withColumn("place", _arrival())
    firsts = counted.select(F.col("source_id").alias("_source"), F.col("first").alias("_first")).distinct()
    first_lines = lines.join(firsts, lines.source_id.eqNullSafe(F.col("_source")) & (lines.place == F.col("_first")), "left_semi")
    examples = (
        line_fields(first_lines, mode, place=F.col("place"))
        .groupBy(F.col("source_id").alias("_source"), F.col("f.field").alias("_field"), F.col("place").alias("_first"))
        .agg(F.min_by("f.example", "ordinal").alias("example"))
    )
    same = counted.source_id.eqNullSafe(F.col("_source")) & (counted.field == F.col("_field")) & (counted["first"] == F.col("_first"))
    return counted.join(examples, same, "left").select("source_id", "field", "rows", "types", "example", "longest")


def with_coverage(catalog: DataFrame, logs: DataFrame) -> DataFrame:
    """Share of a source's lines that carry each field."""
    totals = logs.groupBy("source_id").agg(F.count("*").alias("lines"))
    return catalog.join(totals, "source_id").withColumn(
        "coverage", F.round(F.col("rows") / F.col("lines"), 6)
    )


def source_schema(logs: DataFrame) -> DataFrame:
    """Merged JSON schema of each source's object lines."""
    events = logs.select("source_id", F.explode(F.array(strict_json(F.col("raw")))).alias("event"))
    return (
        events.where(is_object(F.col("event")))
        .groupBy("source_id")
        .agg(F.schema_of_variant_agg("event").alias("schema"))
    )


def _place_in(names: list[str], field: Column) -> Column:
    """Place in the list from 1, or behind it."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), field)
    return F.when(place == 0, F.lit(len(names) + 1)).otherwise(place)


def display_text(catalog_row: str = "") -> Column:
    prefix = f"{catalog_row}." if catalog_row else ""
    return ellipsize(F.coalesce(F.col(prefix + "formatted"), F.col(prefix + "example")), 37, 34)


def display_order(catalog: DataFrame) -> DataFrame:
    """Catalog with ``place``: special fields first, the others by name."""
    ordered = Window.partitionBy("source_id").orderBy(
        _place_in(SPECIAL_FIELDS, F.col("field")), F.col("field")
    )
    return catalog.withColumn("place", F.row_number().over(ordered)).withColumn(
        "shown", display_text()
    )


def preview(catalog: DataFrame) -> DataFrame:
    """Up to three ``field=value`` per source, preferred fields first, then as found."""
    ordered = Window.partitionBy("source_id").orderBy(
        _place_in(PREVIEW_FIELDS, F.col("field")), F.col("ordinal")
    )
    shown = F.concat(
        F.col("field"), F.lit("="), ellipsize(F.coalesce(F.col("example"), F.lit("")), 30, 27)
    )
    picked = catalog.withColumn("place", F.row_number().over(ordered)).where(
        F.col("place") <= PREVIEW_COUNT
    )
    return picked.groupBy("source_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))),
                lambda p: p["shown"],
            ),
            ", ",
        ).alias("preview")
    )
