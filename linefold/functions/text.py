"""Display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linefold.functions.values import bind, fixed2

# Fixed value: terminal escape sequences.
ESCAPES = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
UNITS = ["B", "KB", "MB", "GB", "TB"]


def format_timestamp(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Never"))


def format_bytes(amount: Column) -> Column:
    """``1536`` -> ``1.50 KB``; steps of 1024 up to PB."""

    def build(x: Column) -> Column:
        shown = None
        for power, unit in enumerate(UNITS):
            text = F.concat(fixed2(x / float(1024**power)), F.lit(f" {unit}"))
            fits = x < float(1024 ** (power + 1))
            shown = F.when(fits, text) if shown is None else shown.when(fits, text)
        return shown.otherwise(F.concat(fixed2(x / float(1024**5)), F.lit(" PB")))

    return bind(amount.cast("double"), build)


def format_uptime(seconds: Column) -> Column:
    """``93784`` -> ``1d 2h 3m 4s``; zero parts show once a larger part does."""

    def build(s: Column) -> Column:
        days, hours = F.floor(s / 86400), F.floor(s % 86400 / 3600)
        minutes, rest = F.floor(s % 3600 / 60), s % 60
        part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
        return F.concat_ws(
            " ",
            F.when(s >= 86400, part(days, "d")),
            F.when(s >= 3600, part(hours, "h")),
            F.when(s >= 60, part(minutes, "m")),
            part(rest, "s"),
        )

    return bind(seconds.cast("bigint"), build)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPES, "")


def content_width(text: Column) -> Column:
    return F.length(strip_ansi(text))


def severity_tag(line: Column) -> Column:
    """ERROR, WARNING or INFO if the line holds the word, in that order of precedence."""
    has = lambda word: F.contains(line, F.lit(word))
    return (
        F.when(has("ERROR"), F.lit("ERROR"))
        .when(has("WARNING"), F.lit("WARNING"))
        .when(has("INFO"), F.lit("INFO"))
        .otherwise(F.lit("none"))
    )
