"""Field extraction from log lines: format detection and one extractor per format.

Every extractor is a Column of ``array<struct<field,type,example,formatted,length,
original,format>>`` in first-seen order with the last value of a repeated name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linefold.functions.infer import FIELDS_TYPE, field, no_fields, typed_field
from linefold.functions.values import (
    BLANKS,
    after,
    before,
    bind,
    ellipsize,
    fixed2,
    float_text,
    is_object,
    object_fields,
    strip,
    thousands,
    tokens,
    value_text,
)

# Patterns and word lists. Order matters, the first hit counts.
STAMP_PATTERNS = [
    (r"(?U)\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2})?)\b", "ISO8601"),
    (r"(?U)\b(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\b", "datetime"),
    (r"(?U)\b(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})\b", "MM/DD/YYYY"),
    (r"(?U)\b(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\b", "Syslog"),
    (r"(?U)\b(\d{2}-\w{3}-\d{4}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\b", "DD-MMM-YYYY"),
]
LEADING_STAMPS = [
    r"(?U)^\d{4}-\d{2}-\d{2}",
    r"(?U)^\d{2}:\d{2}:\d{2}",
    r"(?U)^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"(?U)^\d{2}/\d{2}/\d{4}",
]
LEVEL_PATTERN = r"(?iU)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)\b"
LEVEL_WORDS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "WARN", "TRACE", "FATAL"]
ADDRESS_PATTERN = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
ADDRESS_HINT = r"\p{Nd}\.\p{Nd}"
MESSAGE_PATTERN = r"(?Ud):\s*(.+)$"
COLON_PATTERN = r"(?sUd)([^:]+):\s*(.+?)(?=\n[^:]+:|\n*$)"
LINE_PAIR_PATTERN = r"(?mUd)^([A-Za-z][A-Za-z0-9_\-\.]*)\s*[:=]\s*(.+?)$"
TOKEN_PAIR_PATTERN = r'(?U)([A-Za-z][A-Za-z0-9_\-\.]*)=(?:"([^"]*)"|([^,;\s]*))'
DELIMITERS = [" ", ",", ";", "|", "\t", " = "]
SEPARATORS = ["=", ":", "->", "=>", " - "]

DELIMITED_FORMS = {"tab": "\t", "semicolon": ";", "comma": ",", "pipe": "|"}

WHOLE_LINE = ""
PAIR_TYPE = "array<struct<k:string,v:string>>"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern that cannot match the empty string, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def count_of(text: Column, mark: Column | str) -> Column:
    """Non-overlapping occurrences of ``mark``."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    without = F.replace(text, mark, F.lit(""))
    return F.floor((F.length(text) - F.length(without)) / F.length(mark)).cast("int")


def split_on(text: Column, mark: Column | str) -> Column:
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.split(text, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1)


def last_wins(entries: Column) -> Column:
    """Collapse entries with equal ``field``: first position, last content."""
    return F.map_values(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["field"], e)))
    )


# -- detection ----------------------------------------------------------------------


def detect_format(raw: Column, event: Column) -> Column:
    """Name of the extraction form a line takes."""
    has = lambda mark: F.contains(raw, F.lit(mark))
    return (
        F.when(event.isNotNull(), F.when(is_object(event), F.lit("json")).otherwise(F.lit("json_value")))
        .when(has("="), F.lit("pairs"))
        .when(has(":") & ~F.startswith(strip(raw), F.lit("{")), F.lit("colon"))
        .when(has("\t"), F.lit("tab"))
        .when(has(";"), F.lit("semicolon"))
        .when(has(",") & ~has('"'), F.lit("comma"))
        .when(has("|"), F.lit("pipe"))
        .otherwise(F.lit("free"))
    )


def detect_stamp(raw: Column) -> Column:
    """``struct<stamp, format>`` of the first timestamp pattern that hits, or null."""
    choice = None
    for pattern, name in STAMP_PATTERNS:
        hit = raw.rlike(pattern)
        value = F.struct(F.regexp_extract(raw, pattern, 1).alias("stamp"), F.lit(name).alias("format"))
        choice = F.when(hit, value) if choice is None else choice.when(hit, value)
    return choice


def detect_level(raw: Column) -> Column:
    """First level word as a whole word in any case, upper-cased."""
    return F.upper(_found(raw, LEVEL_PATTERN))


def detect_level_word(raw: Column) -> Column:
    """First of the level words, in list order, that stands between spaces."""

    def first_word(padded: Column) -> Column:
        choice = None
        for word in LEVEL_WORDS:
            hit = F.contains(padded, F.lit(f" {word} "))
            choice = F.when(hit, F.lit(word)) if choice is None else choice.when(hit, F.lit(word))
        return choice

    return bind(F.concat(F.lit(" "), raw, F.lit(" ")), first_word)


def detect_address(raw: Column) -> Column:
    # Dots between digits are searched for first; the word borders are the slow part.
    return F.when(raw.rlike(ADDRESS_HINT), _found(raw, ADDRESS_PATTERN))


def delimiter_ranking(raw: Column) -> Column:
    """Delimiters as ``array<struct<neg,place,mark,n>>``, busiest first, ties in list order."""
    counted = F.transform(
        F.array(*[F.lit(mark) for mark in DELIMITERS]),
        lambda mark, place: F.struct(
            (-count_of(raw, mark)).alias("neg"), place.alias("place"), mark.alias("mark")
        ),
    )
    return F.array_sort(
        F.transform(counted, lambda d: d.withField("n", -d["neg"]))
    )


# -- key=value ----------------------------------------------------------------------


def _cut(part: Column, mark: Column | str) -> Column:
    return F.struct(strip(before(part, mark)).alias("k"), strip(after(part, mark)).alias("v"))


def _filled(pairs: Column) -> Column:
    """Pairs whose key and value are not blank."""
    return F.filter(pairs, lambda e: (e["k"] != "") & (e["v"] != ""))


def _pairs_of_parts(parts: Column) -> Column:
    """Pairs from every separator in turn, splitting each part at its first one."""
    by_separator = F.transform(
        F.array(*[F.lit(mark) for mark in SEPARATORS]),
        lambda mark: F.transform(
            F.filter(parts, lambda p: F.contains(p, mark)), lambda p: _cut(p, mark)
        ),
    )
    return _filled(F.flatten(by_separator))


def _spaced_equals_pairs(raw: Column) -> Column:
    """Pairs of ``a = 1 b = 2``: value is the first word, the rest is the next key."""
    parts = split_on(raw, " = ")
    start = F.struct(
        strip(F.get(parts, F.lit(0))).alias("key"), F.array().cast("array<string>").alias("out")
    )

    def step(state: Column, part: Column) -> Column:
        text = strip(part)
        more = F.contains(text, F.lit(" "))
        value = before(text, " ")
        joined = F.concat(state["key"], F.lit("="), value)
        return F.struct(
            F.when(more, after(text, " ")).otherwise(state["key"]).alias("key"),
            F.array_append(state["out"], joined).alias("out"),
        )

    joined = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step)["out"]
    return F.transform(joined, lambda p: _cut(p, "="))


def _pattern_pairs(raw: Column, pattern: str, value_groups: list[int]) -> Column:
    keys = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(raw, F.lit(pattern), F.lit(value_groups[0]))
    for group in value_groups[1:]:
        other = F.regexp_extract_all(raw, F.lit(pattern), F.lit(group))
        values = F.zip_with(values, other, lambda a, b: F.when(a != "", a).otherwise(b))
    return _filled(
        F.zip_with(keys, values, lambda k, v: F.struct(strip(k).alias("k"), strip(v).alias("v")))
    )


def pair_writes(raw: Column) -> Column:
    """Every key/value write of the compatible key=value reading, in order."""
    spaced = F.contains(raw, F.lit(" = "))

    def with_ranking(ranked: Column) -> Column:
        marks = F.transform(F.filter(ranked, lambda d: d["n"] > 0), lambda d: d["mark"])
        stop = F.array_position(marks, F.lit(" = ")).cast("int")
        # Absent delimiters all leave the line whole and repeat the same writes; one
        # pass over the whole line stands in for all of them.
        whole = F.array_append(marks, F.lit(WHOLE_LINE))
        plain = F.when(spaced, F.slice(marks, F.lit(1), stop - 1)).otherwise(
            F.when(F.size(marks) < len(DELIMITERS) - 1, whole).otherwise(marks)
        )
        by_mark = F.flatten(
            F.transform(
                plain,
                lambda mark: bind(
                    F.transform(
                        F.when(mark == WHOLE_LINE, F.array(raw)).otherwise(split_on(raw, mark)),
                        strip,
                    ),
                    _pairs_of_parts,
                ),
            )
        )
        return F.concat(
            by_mark,
            F.when(spaced, _spaced_equals_pairs(raw)).otherwise(F.array().cast(PAIR_TYPE)),
        )

    return bind(
        bind(delimiter_ranking(raw), with_ranking),
        lambda found: F.when(F.size(found) > 0, found).otherwise(
            bind(
                _pattern_pairs(raw, LINE_PAIR_PATTERN, [2]),
                lambda lines: F.when(F.size(lines) > 0, lines).otherwise(
                    _pattern_pairs(raw, TOKEN_PAIR_PATTERN, [2, 3])
                ),
            )
        ),
    )


def clean_pair_writes(raw: Column) -> Column:
    """Key=value reading on the busiest delimiter and ``=`` only."""
    mark = F.get(
        F.filter(delimiter_ranking(raw), lambda d: d["mark"] != " = "), F.lit(0)
    )["mark"]
    parts = F.filter(
        F.transform(split_on(raw, mark), strip), lambda p: F.contains(p, F.lit("="))
    )
    return _filled(F.transform(parts, lambda p: _cut(p, "=")))


def _stamp_and_level(raw: Column) -> Column:
    stamp = bind(
        detect_stamp(raw),
        lambda s: F.when(
            s.isNotNull(),
            F.array(
                field(F.lit("timestamp"), "timestamp", s["stamp"], s["stamp"], format=s["format"])
            ),
        ).otherwise(no_fields()),
    )
    level = bind(
        detect_level(raw),
        lambda w: F.when(
            w.isNotNull(), F.array(field(F.lit("log_level"), "level", w, w))
        ).otherwise(no_fields()),
    )
    return F.concat(stamp, level)


def _read(special: Column, writes: Column) -> Column:
    """What an extractor reads: ready fields and key/value writes that still need types."""
    return F.struct(special.alias("special"), writes.cast(PAIR_TYPE).alias("writes"))


def _finish(read: Column, style: Column) -> Column:
    """Types for the surviving writes; the last write of a name decides."""
    final = F.when(
        style.isin("pairs", "named"),
        F.transform(
            F.map_entries(F.map_from_entries(read["writes"])),
            lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")),
        ),
    ).otherwise(read["writes"])
    typed = F.transform(final, lambda e: typed_field(e["k"], e["v"], style))
    # Names by place are distinct already and differ from the special ones.
    return F.when(~style.isin("pairs", "named"), F.concat(read["special"], typed)).when(F.size(read["special"]) == 0, typed).otherwise(
        last_wins(F.concat(read["special"], typed))
    )


def _read_pairs(raw: Column, mode: str) -> Column:
    writes = clean_pair_writes(raw) if mode == "clean" else pair_writes(raw)
    return _read(_stamp_and_level(raw), writes)


def pair_fields(raw: Column, mode: str = "compat") -> Column:
    """Fields of a key=value line. ``clean`` drops the junk keys of ``compat``."""
    return bind(_read_pairs(raw, mode), lambda read: _finish(read, F.lit("pairs")))


def pair_examples(raw: Column, mode: str = "compat") -> Column:
    """``map<field, example>`` of a key=value line without type work, for keys."""
    writes = clean_pair_writes(raw) if mode == "clean" else pair_writes(raw)
    stamp = bind(
        detect_stamp(raw),
        lambda s: F.when(
            s.isNotNull(), F.array(F.struct(F.lit("timestamp").alias("k"), s["stamp"].alias("v")))
        ).otherwise(F.array().cast(PAIR_TYPE)),
    )
    level = bind(
        detect_level(raw),
        lambda w: F.when(
            w.isNotNull(), F.array(F.struct(F.lit("log_level").alias("k"), w.alias("v")))
        ).otherwise(F.array().cast(PAIR_TYPE)),
    )
    return F.map_from_entries(F.concat(stamp, level, writes))


def simple_pairs(raw: Column) -> Column:
    """The deny filter's reading: whitespace tokens split at their first ``=``."""
    held = F.filter(tokens(raw), lambda t: F.contains(t, F.lit("=")))
    return F.map_from_entries(
        F.transform(held, lambda t: F.struct(before(t, "="), after(t, "=")))
    )


# -- delimited and colon ------------------------------------------------------------


def _read_delimited(raw: Column, mark: Column) -> Column:
    lines = F.split(strip(raw), "\n")
    names = split_on(F.get(lines, F.lit(0)), mark)
    values = split_on(F.get(lines, F.lit(1)), mark)
    headed = F.filter(
        F.zip_with(names, values, lambda n, v: F.struct(strip(n).alias("k"), strip(v).alias("v"))),
        # The longer side leaves nulls.
        lambda e: (e["k"] != "") & e["v"].isNotNull(),
    )
    placed = F.transform(
        split_on(raw, mark),
        lambda v, i: F.struct(
            F.concat(F.lit("field_"), (i + 1).cast("string")).alias("k"), strip(v).alias("v")
        ),
    )
    return _read(no_fields(), F.when(F.size(lines) > 1, headed).otherwise(_filled(placed)))


def _delimited_style(raw: Column) -> Column:
    return F.when(F.contains(strip(raw), F.lit("\n")), F.lit("named")).otherwise(F.lit("placed"))


def delimited_fields(raw: Column, mark: Column | str) -> Column:
    """Header plus first data line, or ``field_N`` by place for a single line."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return bind(
        _read_delimited(raw, mark), lambda read: _finish(read, _delimited_style(raw))
    )


def _read_colon(raw: Column) -> Column:
    return _read(no_fields(), _pattern_pairs(raw, COLON_PATTERN, [2]))


def colon_fields(raw: Column) -> Column:
    """``key: value`` runs across lines."""
    return bind(_read_colon(raw), lambda read: _finish(read, F.lit("named")))


# -- free text ----------------------------------------------------------------------


def _leading_stamp(raw: Column) -> Column:
    return F.coalesce(*[_found(raw, pattern, 0) for pattern in LEADING_STAMPS])


def free_parts(raw: Column) -> Column:
    """Special values and the remaining tokens of a free text line.

    ``struct<stamp, level, message, address, rest: array<struct<place, token>>>``. A token
    is kept at its first place only, and never if a special value equals it.
    """
    found = F.struct(
        _leading_stamp(raw).alias("stamp"),
        detect_level_word(raw).alias("level"),
        strip(_found(raw, MESSAGE_PATTERN)).alias("message"),
        detect_address(raw).alias("address"),
        tokens(raw).alias("words"),
    )

    def rest(f: Column) -> Column:
        skip = F.when(f["stamp"].isNull(), F.lit(0)).otherwise(F.size(tokens(f["stamp"])))
        placed = F.transform(
            f["words"], lambda w, i: F.struct(w.alias("token"), i.alias("place"))
        )
        tail = F.slice(placed, skip + 1, F.greatest(F.size(placed) - skip, F.lit(0)))
        # Written back to front, the surviving place of each token is its first one.
        first_place = F.map_from_entries(F.reverse(tail))
        taken = F.array_compact(F.array(f["stamp"], f["level"], f["message"], f["address"]))
        entries = F.map_entries(first_place)
        fresh = F.when(
            F.size(taken) > 0, F.filter(entries, lambda e: ~F.array_contains(taken, e["key"]))
        ).otherwise(entries)
        return F.array_sort(
            F.transform(
                fresh, lambda e: F.struct(e["value"].alias("place"), e["key"].alias("token"))
            )
        )

    return bind(
        found,
        lambda f: F.struct(
            f["stamp"].alias("stamp"),
            f["level"].alias("level"),
            f["message"].alias("message"),
            f["address"].alias("address"),
            rest(f).alias("rest"),
        ),
    )


def _special(parts: Column) -> list[tuple[str, Column]]:
    return [
        ("timestamp", parts["stamp"]),
        ("log_level", parts["level"]),
        ("message", parts["message"]),
        ("ip_address", parts["address"]),
    ]


def _place_name(entry: Column) -> Column:
    return F.concat(F.lit("field_"), (entry["place"] + 1).cast("string"))


def _read_free(raw: Column) -> Column:
    types = {"timestamp": "timestamp", "log_level": "level", "message": "string", "ip_address": "ip"}

    def build(parts: Column) -> Column:
        special = []
        for name, value in _special(parts):
            shown = ellipsize(value, 39, 37) if name == "message" else value
            special.append(F.when(value.isNotNull(), field(F.lit(name), types[name], value, shown)))
        rest = F.transform(
            parts["rest"], lambda e: F.struct(_place_name(e).alias("k"), e["token"].alias("v"))
        )
        return _read(F.array_compact(F.array(*special)), rest)

    return bind(free_parts(raw), build)


def free_fields(raw: Column) -> Column:
    """Fields of a free text line."""
    return bind(_read_free(raw), lambda read: _finish(read, F.lit("free")))


def free_examples(raw: Column) -> Column:
    """``map<field, example>`` of a free text line, for keys."""

    def build(parts: Column) -> Column:
        special = [
            F.when(value.isNotNull(), F.struct(F.lit(name).alias("k"), value.alias("v")))
            for name, value in _special(parts)
        ]
        rest = F.transform(
            parts["rest"], lambda e: F.struct(_place_name(e).alias("k"), e["token"].alias("v"))
        )
        return F.map_from_entries(F.concat(F.array_compact(F.array(*special)), rest))

    return bind(free_parts(raw), build)


# -- JSON ---------------------------------------------------------------------------


def _is_open(item: Column) -> Column:
    """Whether a leaf is still an object; its text tells most others apart cheaply."""
    return F.coalesce(F.startswith(item["text"], F.lit("{")), F.lit(False)) & is_object(item["value"])


def _json_levels(raw: Column) -> Column:
    """Leaves of a JSON object as ``array<struct<path, text, value>>`` in document order.

    Each round opens the objects found so far. The number of rounds comes from the line
    itself: it cannot nest deeper than it has opening braces.
    """
    frontier_type = "array<struct<path:string,text:string,value:variant>>"
    start = F.array(
        F.struct(
            F.lit("").alias("path"), strip(raw).alias("text"), F.try_parse_json(raw).alias("value")
        )
    ).cast(frontier_type)

    def children(item: Column) -> Column:
        texts = F.map_entries(
            F.map_from_entries(F.map_entries(F.from_json(item["text"], "map<string,string>")))
        )
        prefix = F.when(item["path"] == "", F.lit("")).otherwise(
            F.concat(item["path"], F.lit("."))
        )
        # Repeated names keep their first place; the value already holds the last content.
        return bind(
            F.struct(object_fields(item["value"]).alias("values"), prefix.alias("prefix")),
            lambda held: F.transform(
                texts,
                lambda e: F.struct(
                    F.concat(held["prefix"], e["key"]).alias("path"),
                    e["value"].alias("text"),
                    F.try_element_at(held["values"], e["key"]).alias("value"),
                ),
            ),
        ).cast(frontier_type)

    def opened(items: Column, _: Column) -> Column:
        return F.flatten(
            F.transform(
                items,
                lambda item: F.when(_is_open(item), children(item)).otherwise(F.array(item)),
            )
        )

    rounds = F.length(raw) - F.length(F.replace(raw, F.lit("{"), F.lit("")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, opened)


def _scalar_kind(kind: Column, text: Column) -> Column:
    """Type label of a JSON value from its VARIANT type name and text."""
    whole = (kind == "BIGINT") | (
        kind.startswith("DECIMAL")
        & kind.endswith(",0)")
        & ~F.contains(text, F.lit("."))
        & (F.length(text) > 18)
    )
    return (
        F.when(kind == "STRING", F.lit("str"))
        .when(kind == "BOOLEAN", F.lit("bool"))
        .when(kind == "VOID", F.lit("NoneType"))
        .when(whole, F.lit("int"))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.lit("float"))
        .when(kind.startswith("OBJECT"), F.lit("dict"))
        .when(kind.startswith("ARRAY"), F.lit("list"))
    )


def json_value_field(path: Column, text: Column, value: Column) -> Column:
    """Catalog entry of one JSON leaf."""

    def scalar(kind: Column) -> Column:
        def shown_as(example: Column) -> Column:
            label = _scalar_kind(kind, example)
            shown = F.when(label == "int", thousands(example)).when(
                label == "float", bind(F.try_variant_get(value, "$", "double"), fixed2)
            )
            return field(
                path,
                label,
                ellipsize(example, 100, 97),
                shown,
                length=F.when(label == "str", F.length(example)),
            )

        return bind(F.coalesce(value_text(value), F.lit("None")), shown_as)

    def listed(items: Column) -> Column:
        first = F.get(items, F.lit(0))
        first_keys = F.map_keys(F.try_variant_get(first, "$", "map<string,variant>"))
        first_text = F.try_variant_get(first, "$", "string")
        small_objects = is_object(first) & (F.size(first_keys) <= 5)

        def described(small: Column) -> Column:
            item_label = F.when(small, F.lit("object")).otherwise(
                bind(F.schema_of_variant(first), lambda k: _scalar_kind(k, first_text))
            )
            keys = F.concat(
                F.lit("List of objects with keys: "), F.array_join(json_keys(text), ", ")
            )
            return field(
                path,
                F.concat(F.lit("list<"), item_label, F.lit(">")),
                F.when(small, keys).otherwise(F.substring(list_text(items), 1, 100)),
                length=F.size(items),
            )

        empty = field(path, "list", F.lit("[]"), length=F.lit(0))
        return F.when(F.size(items) == 0, empty).otherwise(bind(small_objects, described))

    return bind(
        F.schema_of_variant(value),
        lambda kind: F.when(~kind.startswith("ARRAY"), scalar(kind)).otherwise(
            bind(F.try_variant_get(value, "$", "array<variant>"), listed)
        ),
    )


def json_keys(list_json: Column) -> Column:
    """Key names, in document order, of the first object in a JSON list."""
    first = F.get(F.from_json(list_json, "array<string>"), F.lit(0))
    return F.array_distinct(F.map_keys(F.from_json(first, "map<string,string>")))


def list_text(items: Column) -> Column:
    """A list in Python's style; containers inside it as JSON text."""

    def quoted(shown: Column) -> Column:
        escaped = shown
        for plain, code in [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
            escaped = F.replace(escaped, F.lit(plain), F.lit(code))
        doubled = F.contains(shown, F.lit("'")) & ~F.contains(shown, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(doubled, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)

    def item_text(item: Column) -> Column:
        text = F.coalesce(value_text(item), F.lit("None"))
        return F.when(F.schema_of_variant(item) == "STRING", bind(text, quoted)).otherwise(text)

    return F.concat(F.lit("["), F.array_join(F.transform(items, item_text), ", "), F.lit("]"))


def json_fields(raw: Column) -> Column:
    """Fields of a JSON object line, nested objects as dotted names."""
    leaves = F.filter(_json_levels(raw), lambda leaf: ~_is_open(leaf))
    return last_wins(
        F.transform(leaves, lambda leaf: json_value_field(leaf["path"], leaf["text"], leaf["value"]))
    )


# -- dispatch -----------------------------------------------------------------------


def extract_fields(raw: Column, form: Column, mode: str = "compat") -> Column:
    """Fields of a line in the form named by ``detect_format``.

    Null for JSON that is not an object: such a line gives no template.
    """
    marks = F.create_map(
        *[F.lit(x) for pair in DELIMITED_FORMS.items() for x in pair]
    )
    style = (
        F.when(form == "pairs", F.lit("pairs"))
        .when(form == "colon", F.lit("named"))
        .when(form == "free", F.lit("free"))
        .otherwise(_delimited_style(raw))
    )
    read = (
        F.when(form == "pairs", _read_pairs(raw, mode))
        .when(form == "colon", _read_colon(raw))
        .when(form == "free", _read_free(raw))
        .otherwise(_read_delimited(raw, F.try_element_at(marks, form)))
    )
    text = bind(F.struct(read.alias("read"), style.alias("style")),
                lambda r: _finish(r["read"], r["style"]))
    return (
        F.when(form == "json", json_fields(raw))
        .when(form == "json_value", F.lit(None).cast(FIELDS_TYPE))
        .otherwise(text)
    )


def text_examples(raw: Column, mode: str = "compat") -> Column:
    """``map<field, example>`` used for collapse keys: key=value, else free text."""
    return F.when(F.contains(raw, F.lit("=")), pair_examples(raw, mode)).otherwise(
        free_examples(raw)
    )


@functools.lru_cache(maxsize=16)
def _named_examples(app: str, name: str, mode: str) -> Column:
    return text_examples(F.col(name), mode)


def named_text_examples(name: str, mode: str = "compat") -> Column:
    """``text_examples`` of a named column. The expression is long; it is built once."""
    session = SparkSession.getActiveSession()
    return _named_examples(session.sparkContext.applicationId, name, mode)


def named_fields(raw: str, form: str, mode: str = "compat") -> Column:
    """``extract_fields`` of named columns, built once as well."""
    return _named_fields(SparkSession.getActiveSession().sparkContext.applicationId, raw, form, mode)


@functools.lru_cache(maxsize=16)
def _named_fields(app: str, raw: str, form: str, mode: str) -> Column:
    return extract_fields(F.col(raw), F.col(form), mode)
