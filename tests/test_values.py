"""JSON strictness, value text, numbers and text readings against plain Python."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linefold.functions import extract, text
from linefold.functions.infer import typed_field
from linefold.functions.values import (
    bind, fixed2, float_text, object_fields, path_in, strict_json, value_text,
)
from tests import model

def run(spark, lines, column):
    """Column values in input order."""
    rows = [(i, line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "i int, raw string").repartition(4)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def random_lines(count, seed):
    rnd = random.Random(seed)
    words = ["a", "b=1", "c = 2", "x:y", "k->v", "k=>v", "u - w", ",", ";", "|", "\t", "ERROR", "info", " warn ",
             "10.0.0.1", "2024-01-01 10:00:00", "Jan  5 10:11:12", "12:30:45", "=", "==", "é=ü", "q=\"z z\"", "\n",
             "key=", "=val", "01/02/2024 03:04:05", " ", "  ", "n=1_000", "f=1e5", "msg: done", "a.b=3", "DEBUG"]
    out = []
    for _ in range(count):
        joiner = rnd.choice([" ", "", ",", ";", " "])
        out.append(joiner.join(rnd.choice(words) for _ in range(rnd.randint(0, 8))))
    return out


LINES = random_lines(600, 7) + ["", " ", "=", " = ", "a = ", " = b", "a = b = c", "=a=b", "=\nk=v", "a=b c = d"]


def test_strict_json_agrees_with_python(spark):
    lines = ['{"a":1} x', '{"a":1}] {}', "1,2", "1], [2", "[1] 2", '"s"', "", " {} ", "[1,2]", "nul", "null", "01",
             '{"a":1}}', "1}", '{"r":1}]}', "tru", "-1.5e3", "-", '{"a":[1,{"b":"]"}]}', '{"a":1}\n', "[]", "{", "'a'", '"]"',
             '{"a":1,"a":2}', '["]"] ]']
    got = run(spark, lines, strict_json(F.col("raw")).isNotNull())
    assert got == [model.is_json(line) for line in lines]


def test_value_text(spark):
    values = ["true", "false", "null", "1", "1.0", "-3", "1e5", "12345678.0", "0.0001", "1e-5", "1e16", "1e15", "1.10",
              "123456789012345678901234", "\"s\"", "\"true\"", "0.1234567890123456789", "3.14", "100.0", "1.5e300"]
    lines = ['{"a":{"b":%s}}' % v for v in values]
    got = run(spark, lines, value_text(path_in(object_fields(strict_json(F.col("raw"))), F.lit("a.b"))))
    want = [None if json.loads(v) is None else str(json.loads(v)) for v in values]
    assert got == want


def test_paths(spark):
    lines = ['{"a.b":1}', '{"a":1,"a":2}', '{"a":[{"b":1}]}', '{"a":{"b":{"c":5}}}', "[1]", '{"it\'s \\"q\\"":7}']
    def at(path):
        return run(spark, lines, value_text(path_in(object_fields(strict_json(F.col("raw"))), F.lit(path))))
    assert at("a.b") == [None, None, None, '{"c":5}', None, None]
    assert at("a")[1] == "2"
    assert at("a.b.c")[3] == "5"
    assert at('it\'s "q"')[5] == "7"


def test_numbers(spark):
    rnd = random.Random(3)
    numbers = [0.125, 0.165, 0.145, 2.675, 1.005, -0.125, 0.0, 1e13, 99.995, 1e22, -7.5, 0.005, 0.015]
    numbers += [rnd.uniform(-1e6, 1e6) for _ in range(500)] + [rnd.randint(-8000, 8000) / 8 for _ in range(200)]
    lines = [repr(x) for x in numbers]
    assert run(spark, lines, bind(F.col("raw").cast("double"), fixed2)) == [f"{x:.2f}" for x in numbers]
    plain = [x for x in numbers if x == 0 or 1e-4 <= abs(x) < 1e16]
    assert run(spark, [repr(x) for x in plain], bind(F.col("raw").cast("double"), float_text)) == [repr(x) for x in plain]


# Expected fields of lines of every form, in order for pairs.
GOLDEN = json.loads(Path(__file__).with_name("golden_readings.json").read_text(encoding="utf-8"))


def test_golden_readings(spark):
    lines = [g["line"] for g in GOLDEN]
    got = run(spark, lines, extract.pair_examples(F.col("raw")))
    order = run(spark, lines, F.transform(extract.pair_fields(F.col("raw")), lambda f: f["field"]))
    for g, found, names in zip(GOLDEN, got, order):
        assert found == dict(g["pairs"]), g["line"]
        assert names == [name for name, _ in g["pairs"]], g["line"]
    prose = [g for g in GOLDEN if "free" in g]
    for g, found in zip(prose, run(spark, [g["line"] for g in prose], extract.free_examples(F.col("raw")))):
        assert found == g["free"], g["line"]


def test_reading_properties(spark):
    for line, found in zip(LINES, run(spark, LINES, extract.simple_pairs(F.col("raw")))):
        assert found == model.simple(line), repr(line)
    for line, found in zip(LINES, run(spark, LINES, extract.pair_examples(F.col("raw")))):
        # Spaced equals signs join values to the names before them.
        assert " = " in line or all(v in line for k, v in found.items() if k != "log_level"), repr(line)
    prose = [line for line in LINES if "=" not in line]
    for line, found in zip(prose, run(spark, prose, extract.free_examples(F.col("raw")))):
        words = [v for k, v in found.items() if k.startswith("field_")]
        # A word counts once, at its place in the line.
        assert len(set(words)) == len(words), repr(line)
        assert all(line.split()[int(k[6:]) - 1] == v for k, v in found.items() if k.startswith("field_")), repr(line)


def test_types(spark):
    values = ["1", "+5", "-1_000", "1__0", "1.5", ".5", "5.", "1e3", "nan", "-Inf", "infinity", "yes", "TRUE", "No", "x" * 50,
              "1234567", "1,5", "٣", "0007", "-0", "0.165", "1_0.5"]
    f = typed_field(F.lit("k"), F.col("raw"), F.lit("pairs"))
    got = run(spark, values, F.struct(f["type"].alias("t"), f["formatted"].alias("s")))
    for value, row in zip(values, got):
        kind, shown = model.kind_and_text(value)
        if kind:
            assert row.t == kind, value
            # Display keeps digits of other scripts as they were written.
            assert row.s == (shown if value.isascii() else value), value
    by_value = dict(zip(values, got))
    assert (by_value["yes"].t, by_value["yes"].s) == ("bool", "true")
    assert (by_value["No"].t, by_value["No"].s) == ("bool", "false")
    assert by_value["TRUE"].s == "TRUE"
    assert by_value["x" * 50].s == "x" * 37 + "..."
    named = [r for r in run(spark, ["v"], F.array(*[typed_field(F.lit(n), F.col("raw"), F.lit("pairs"))["type"] for n in ("Date", "LEVEL", "z")]))]
    assert named == [["timestamp", "level", "string"]]


def fields_of(spark, line):
    form = bind(strict_json(F.col("raw")), lambda event: extract.detect_format(F.col("raw"), event))
    df = spark.createDataFrame([(line,)], "raw string").withColumn("form", form)
    row = df.select("form", extract.extract_fields(F.col("raw"), F.col("form")).alias("f")).collect()[0]
    return row.form, None if row.f is None else {f.field: (f.type, f.example) for f in row.f}


@pytest.mark.parametrize("line,form,fields", [
    ("a=1 b=2", "pairs", {"a": ("string", "1 b=2"), "b": ("int", "2")}),
    ("a = 1 b = 2", "pairs", {"a": ("int", "1"), "b": ("int", "2")}),
    ("id;name\n7;bob", "semicolon", {"id": ("int", "7"), "name": ("string", "bob")}),
    ("id;;name;more\n7;x", "semicolon", {"id": ("int", "7")}),
    ("x||y", "pipe", {"field_1": ("string", "x"), "field_3": ("string", "y")}),
    ("Jan  5 10:11:12 host app: started 10.0.0.1", "colon", {"Jan  5 10": ("string", "11:12 host app: started 10.0.0.1")}),
    ("x ERROR x y", "free", {"log_level": ("level", "ERROR"), "field_1": ("string", "x"), "field_4": ("string", "y")}),
    ("", "free", {}),
    ("[1,2]", "json_value", None),
    ("123", "json_value", None),
    ('{"a":{},"b":[],"c":[1.5],"d":[{"x":1,"y":2}],"e":null,"f":"s"}', "json", {
        "b": ("list", "[]"), "c": ("list<float>", "[1.5]"), "d": ("list<object>", "List of objects with keys: x, y"),
        "e": ("NoneType", "None"), "f": ("str", "s")}),
    ('{"a.b":1,"a":{"b":2}}', "json", {"a.b": ("int", "2")}),
    ("a,b", "comma", {"field_1": ("string", "a"), "field_2": ("string", "b")}),
    ('a,"b', "free", {"field_1": ("string", 'a,"b')}),
    ("{a: b", "free", {"message": ("string", "b"), "field_1": ("string", "{a:")}),
])
def test_edge_lines(spark, line, form, fields):
    assert fields_of(spark, line) == (form, fields)


def test_display(spark):
    assert run(spark, ["0", "59", "60", "3600", "86400", "93784"], text.format_uptime(F.col("raw").cast("bigint"))) == [
        "0s", "59s", "1m 0s", "1h 0m 0s", "1d 0h 0m 0s", "1d 2h 3m 4s"]
    assert run(spark, ["0", "1023", "1536", "1048576", "1e18"], text.format_bytes(F.col("raw").cast("double"))) == [
        "0.00 B", "1023.00 B", "1.50 KB", "1.00 MB", "888.18 PB"]
    assert run(spark, ["\x1b[31mred\x1b[0m", "plain"], text.strip_ansi(F.col("raw"))) == ["red", "plain"]
    assert run(spark, ["an ERROR and INFO", "WARNING", "x"], text.severity_tag(F.col("raw"))) == ["ERROR", "WARNING", "none"]
