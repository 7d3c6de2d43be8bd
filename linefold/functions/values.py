"""Value semantics shared by every operator.

Log lines are JSON, key=value text or free text. These helpers give one reading of
"is it JSON", "what is the value at this dotted path" and "what is its text", as
plain Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
BLANK_RUN = "[" + BLANKS + "]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Both-ends trim over the whole blank set, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """Whitespace tokens; no empty tokens, empty array for a blank line."""
    trimmed = strip(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def before(text: Column, mark: Column | str) -> Column:
    """Text before the first occurrence of ``mark``."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.call_function("substring_index", text, mark, F.lit(1))


def after(text: Column, mark: Column | str) -> Column:
    """Text after the first occurrence of ``mark``."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.substr(text, F.instr(text, mark) + F.length(mark))


# -- JSON ---------------------------------------------------------------------------


def strict_json(raw: Column) -> Column:
    """VARIANT of a complete JSON text, or null.

    Spark's parser ignores text after the first value. Wrapping the line in an array
    turns such text into a syntax error or a second element. Only text that closes a
    bracket early could still slip through; lines where a closing bracket follows a
    value are parsed a second time inside an object to rule that out.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"r":'), raw, F.lit("}")))
    closes_early = F.contains(raw, F.lit("]")) & in_object.isNull()
    return F.when(
        looks_like_json(raw) & ~closes_early,
        bind(
            in_array,
            lambda v: F.when(
                F.try_variant_get(v, "$[1]", "variant").isNull(),
                F.try_variant_get(v, "$[0]", "variant"),
            ),
        ),
    )


def looks_like_json(raw: Column) -> Column:
    """Cheap first-character test that spares free text the JSON parser."""
    return raw.rlike('^[ \\t\\r\\n]*[\\[{"\\-0-9tfn]')


def is_object(event: Column) -> Column:
    return F.coalesce(F.schema_of_variant(event).startswith("OBJECT"), F.lit(False))


def object_fields(event: Column) -> Column:
    """Top-level fields of a JSON object; null for any other value."""
    return F.try_variant_get(event, "$", "map<string,variant>")


def path_in(fields: Column, path: Column) -> Column:
    """VARIANT at a dotted path, walking objects only; null where absent.

    ``fields`` comes from ``object_fields``. Spark would parse a JSON path held in a column
    anew for every row, so names are looked up one by one instead.
    """

    def walk(names: Column) -> Column:
        return F.aggregate(
            F.slice(names, F.lit(2), F.size(names)),
            F.try_element_at(fields, F.get(names, F.lit(0))),
            lambda at, name: F.try_element_at(object_fields(at), name),
        )

    return F.when(
        F.contains(path, F.lit(".")), bind(F.split(path, "\\."), walk)
    ).otherwise(F.try_element_at(fields, path))


# -- numbers as text ----------------------------------------------------------------


def float_text(number: Column) -> Column:
    """Shortest text of a double in Python's style: 1.0, 100000.0, 1e+16, 1e-05."""

    def respell(java: Column) -> Column:
        size = F.abs(number)
        plain = F.regexp_replace(
            F.regexp_replace(
                java.cast("decimal(38,21)").cast("string"), "(\\.\\d*?)0+$", "$1"
            ),
            "\\.$",
            ".0",
        )
        mantissa = F.regexp_replace(F.substring_index(java, "E", 1), "\\.0$", "")
        power = F.substring_index(java, "E", -1).cast("int")
        scientific = F.concat(
            mantissa,
            F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
            F.abs(power).cast("string"),
        )
        return (
            F.when(java == "NaN", F.lit("nan"))
            .when(java == "Infinity", F.lit("inf"))
            .when(java == "-Infinity", F.lit("-inf"))
            .when(~F.contains(java, F.lit("E")), java)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(scientific)
        )

    return bind(number.cast("string"), respell)


def fixed2(number: Column) -> Column:
    """Two decimals, exact half-even rounding of the binary value.

    The fraction is compared with one half through a split product, so 0.165 (slightly
    above the tie) gives 0.17 and 0.125 (an exact tie) gives 0.12.
    """

    def round_parts(x: Column) -> Column:
        scaled = F.floor(x * 100.0).cast("double")
        high = x * 134217729.0 - (x * 134217729.0 - x)
        low = x - high
        over_half = ((high * 100.0 - scaled) - 0.5) + low * 100.0
        up = (over_half > 0) | ((over_half == 0) & (scaled % 2 == 1))
        return (scaled + up.cast("double")).cast("decimal(38,0)")

    size = F.abs(number)
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    hundredths = bind(size, round_parts).cast("string")
    padded = F.lpad(hundredths, F.greatest(F.length(hundredths), F.lit(3)), F.lit("0"))
    small = F.concat(
        sign, F.substr(padded, F.lit(1), F.length(padded) - 2), F.lit("."), F.right(padded, F.lit(2))
    )
    large = F.format_string("%.2f", number)
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .when(size < 9e13, small)
        .otherwise(large)
    )


def thousands(digits: Column) -> Column:
    """Comma groups for integer text of any length."""
    return F.regexp_replace(digits, "(?<=\\d)(?=(?:\\d{3})+$)", ",")


def ellipsize(text: Column, limit: int, keep: int, mark: str = "...") -> Column:
    """Cut text longer than ``limit`` to ``keep`` characters plus ``mark``."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(mark))
    ).otherwise(text)


# -- text of a VARIANT --------------------------------------------------------------


def value_text(value: Column) -> Column:
    """Text of a JSON value in Python's style; null for null and absent.

    Booleans are capitalised and floats keep ``.0``. Objects and arrays give JSON text.
    """

    def build(v: Column) -> Column:
        kind, text, event = v["kind"], v["text"], v["event"]
        return (
            F.when(kind.isin("STRING", "BIGINT"), text)
            .when(kind == "BOOLEAN", F.initcap(text))
            .when(kind == "VOID", F.lit(None).cast("string"))
            # Whole numbers beyond 64 bits arrive as decimals and keep all their digits.
            .when(kind.startswith("DECIMAL") & kind.endswith(",0)") & (F.length(text) > 18), text)
            .when(
                (kind == "DOUBLE") | kind.startswith("DECIMAL"),
                bind(F.try_variant_get(event, "$", "double"), float_text),
            )
            .otherwise(F.to_json(event))
        )

    parts = bind(
        value,
        lambda v: F.struct(
            F.schema_of_variant(v).alias("kind"),
            F.try_variant_get(v, "$", "string").alias("text"),
            v.alias("event"),
        ),
    )
    return bind(parts, build)


def json_string(text: Column) -> Column:
    """Text as a quoted JSON string."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)
