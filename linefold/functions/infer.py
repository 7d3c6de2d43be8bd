"""Type labels and display text for values found in text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linefold.functions.values import bind, ellipsize, fixed2, strip, thousands

# Number texts, as Python reads them.
WHOLE_NUMBER = r"(?U)^[+-]?\d+(?:_\d+)*$"
DECIMAL_NUMBER = (
    r"(?iU)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)$"
)
NUMBER_HINT = r"\p{Nd}|[iI][nN][fF]|[nN][aA][nN]"
# Names and words that decide a type.
TIME_NAMES = ["time", "timestamp", "date"]
LEVEL_NAMES = ["level", "severity", "loglevel"]
TRUE_FALSE = ["true", "false"]
YES_NO = ["yes", "no"]

FIELD_TYPE = (
    "struct<field:string,type:string,example:string,formatted:string,"
    "length:bigint,original:string,format:string>"
)
FIELDS_TYPE = f"array<{FIELD_TYPE}>"


def field(
    name: Column,
    kind: Column | str,
    example: Column,
    formatted: Column | None = None,
    length: Column | None = None,
    original: Column | None = None,
    format: Column | None = None,
) -> Column:
    """One catalog entry."""
    null_text = F.lit(None).cast("string")
    return F.struct(
        name.alias("field"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        example.alias("example"),
        (null_text if formatted is None else formatted).alias("formatted"),
        (F.lit(None).cast("bigint") if length is None else length.cast("bigint")).alias("length"),
        (null_text if original is None else original).alias("original"),
        (null_text if format is None else format).alias("format"),
    ).cast(FIELD_TYPE)


def no_fields() -> Column:
    return F.array().cast(FIELDS_TYPE)


def number_kind(value: Column) -> Column:
    """``int``, ``float`` or null."""
    kind = bind(
        strip(value),
        lambda text: F.when(text.rlike(WHOLE_NUMBER), F.lit("int")).when(
            text.rlike(DECIMAL_NUMBER), F.lit("float")
        ),
    )
    # Most words hold no digit at all and need no closer look.
    return F.when(value.rlike(NUMBER_HINT), kind)


def whole_text(value: Column) -> Column:
    """Whole number text with comma groups, any length."""
    digits = F.regexp_replace(F.regexp_replace(strip(value), "[_+]", ""), "^(-?)0+(?=\\d)", "$1")
    return F.when(digits == "-0", F.lit("0")).otherwise(thousands(digits))


def float_value(value: Column) -> Column:
    text = F.lower(F.replace(strip(value), F.lit("_"), F.lit("")))
    return (
        F.when(text.rlike("^[+-]?nan$"), F.lit("NaN"))
        .when(text.rlike("^\\+?inf"), F.lit("Infinity"))
        .when(text.rlike("^-inf"), F.lit("-Infinity"))
        .otherwise(text)
        .try_cast("double")
    )


def typed_field(name: Column, value: Column, style: Column) -> Column:
    """Catalog entry for a text value.

    ``style`` picks between the small differences of the extraction forms:

    * ``pairs``  - key=value: yes/no show as true/false, names decide time and level,
      only plain strings are cut for display, the original value is kept;
    * ``named``  - header or colon form: as above without the yes/no rewrite, every
      non-number is cut for display;
    * ``placed`` - delimited values without names: no time or level;
    * ``free``   - free text tokens: only true/false are booleans.
    """
    facts = F.struct(
        number_kind(value).alias("number"),
        # Only short words can be a boolean.
        F.when(F.length(value) <= 5, F.lower(value)).otherwise(F.lit("")).alias("lower"),
        F.when(style.isin("pairs", "named"), F.lower(name)).alias("by_name"),
        (style == "pairs").alias("pairs"),
    )

    def build(f: Column) -> Column:
        boolean = f["lower"].isin(TRUE_FALSE) | ((style != "free") & f["lower"].isin(YES_NO))
        label = (
            F.when(f["number"].isNotNull(), f["number"])
            .when(boolean, F.lit("bool"))
            .when(f["by_name"].isin(TIME_NAMES), F.lit("timestamp"))
            .when(f["by_name"].isin(LEVEL_NAMES), F.lit("level"))
            .otherwise(F.lit("string"))
        )
        kept_whole = f["pairs"] & (boolean | f["by_name"].isin(TIME_NAMES + LEVEL_NAMES))
        shown = (
            F.when(f["number"] == "int", whole_text(value))
            .when(f["number"] == "float", bind(float_value(value), fixed2))
            .when(f["pairs"] & (f["lower"] == "yes"), F.lit("true"))
            .when(f["pairs"] & (f["lower"] == "no"), F.lit("false"))
            .when(kept_whole, value)
            .otherwise(ellipsize(value, 40, 37))
        )
        return field(name, label, value, shown, original=F.when(f["pairs"], value))

    return bind(facts, build)
