"""Steps that have to stay small whatever the size of the input."""

import random

import numpy as np
import pandas as pd

from linefold.operators import catalog
from linefold.operators.lockout import LoginState
from linefold.sinks import folder
from linefold.sources import registries
from linefold.streaming import state


class Held:
    """A value state without Spark."""

    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_trigger_of_one_user_leaves_in_small_frames():
    rng = random.Random(5)
    rows = [(rng.randrange(0, 10**11), k, rng.random() < 0.2) for k in range(120_000)]
    watch, got = state.LoginWatch(), []
    watch.init(Held())
    by_time = sorted(rows)
    for part in (by_time[:70_000], by_time[70_000:]):  # two triggers, frames in any order
        rng.shuffle(part)
        frames = (pd.DataFrame(part[k : k + 10_000], columns=["us", "seq", "ok"]) for k in range(0, len(part), 10_000))
        made = list(watch.handleInputRows(("u",), frames, None))
        assert max(map(len, made)) <= state.FRAME_ROWS < len(part)
        got += made
    login, expected = LoginState(), []
    for us, seq, ok in by_time:
        outcome = login.attempt(us, ok)
        expected.append((us, seq, outcome, login.count, login.locked_until if login.locked_until > us else None))
    out = pd.concat(got)
    locks = [None if v is pd.NA else v for v in out.locked_until]
    assert list(zip(out.us, out.seq, out.outcome, out["count"], locks)) == expected
    assert set(out.user) == {"u"} and out.us.dtype == np.int64


def test_fields_are_counted_without_sorting_them(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [
        ("a", at, 2, "x ERROR y"), ("a", at, 1, "zz y"), ("a", None, 9, "later y"), ("a", None, None, "null y"),
        (None, at, -5, '{"k":1}'), (None, at, -7, '{"k":"22"}'), (None, datetime(1950, 1, 1), 3, '{"k":333}'),
        ("b", at, 2**62, "old"), ("b", at, -(2**62), "new"),
    ]
    lines = spark.createDataFrame(rows, "source_id string, recv_ts timestamp, seq long, raw string")
    plan = catalog.field_counts(lines)._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = {(r.source_id, r.field): (r.rows, r.types, r.example, r.longest) for r in catalog.field_catalog(lines).collect()}
    assert got[None, "k"] == (3, "int,str", "333", 3)
    assert got["a", "field_1"][::2] == (4, "null") and got["a", "field_1"][3] == 5
    assert got["b", "field_1"] == (2, "string", "new", 3)


def test_a_large_registry_comes_in_pieces(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(registries, "PIECE_ENTRIES", 10)
    key = F.col("id")
    rules = spark.range(200).select(
        F.when(key % 10 == 0, "b").otherwise("a").alias("source_id"), F.lit("f").alias("field"),
        F.when(key % 7 != 0, key.cast("string")).alias("value"), (key % 3 != 0).alias("enabled"), (-(key % 50)).cast("double").alias("created"),
    )
    document = registries.rules_document(rules)
    assert document.count() >= 20 and document.agg(F.max(F.length("value"))).first()[0] < 1000
    registries.save_document(document, f"{tmp_path}/rules")
    got = [tuple(r) for r in registries.load_rules(spark, f"{tmp_path}/rules").orderBy("source_id", "position").collect()]
    held = sorted(rules.collect(), key=lambda r: (r.source_id, r.created, r.field, (r.value is not None, r.value or ""), r.enabled))
    place = {"a": 0, "b": 0}
    expected = []
    for r in held:
        expected.append((r.source_id, place[r.source_id], r.field, r.value, r.enabled, r.created))
        place[r.source_id] += 1
    assert got == expected

    kept = registries.Registry(f"{tmp_path}/sources", "source_id STRING, source_name STRING")
    named = spark.range(95).select(F.concat(F.lit("s"), "id").alias("source_id"), F.lit("n").alias("source_name"), (-F.col("id")).alias("rank"))
    kept.save(named, "rank")
    document = registries.sources_document(kept.load(spark))
    assert document.count() >= 10
    registries.save_document(document, f"{tmp_path}/document")
    back = registries.load_sources(spark, f"{tmp_path}/document").orderBy("position").select("position", "source_id").collect()
    assert [tuple(r) for r in back] == [(k, f"s{94 - k}") for k in range(95)]

    policies = named.select("source_id", F.array("source_name").alias("fields"), F.lit(1.0).alias("created"), F.lit(True).alias("enabled"))
    templates = catalog.learn_templates(spark.createDataFrame([("t", None, 1, "a=1")], "source_id string, recv_ts timestamp, seq long, raw string"))
    document = registries.policies_document(policies, templates.withColumn("learned", F.lit(0.0)))
    assert document.count() >= 10
    registries.save_document(document, f"{tmp_path}/policies")
    assert registries.load_policies(spark, f"{tmp_path}/policies").select("source_id").distinct().count() == 95
    assert [r.raw for r in registries.load_templates(spark, f"{tmp_path}/policies").collect()] == ["a=1"]


def test_batch_files_share_their_folders(spark, tmp_path):
    from pyspark.sql import functions as F

    lines = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, "a/b=c").otherwise("d").alias("source_id"), F.lit(0).cast("bigint").alias("session"),
        F.floor(F.col("id") / 6).alias("chunk"), (600 - F.col("id")).alias("slot"), F.concat(F.lit("\u00e9"), "id").alias("line"),
    )
    out = str(tmp_path / "out")
    folder.write_lines(lines, out)
    folder.write_lines(lines.where("id >= 300"), out)  # replaces the epoch
    files = [p for p in (tmp_path / "out").rglob("chunk-*.gz") if not p.name.startswith(".")]
    assert len(files) == 100 and len({p.parent for p in files}) == 2
    got = folder.read_lines(spark, out).select("source_id", "session", "chunk", "value").collect()
    assert sorted(tuple(r) for r in got) == sorted((("a/b=c", "d")[k % 2], 0, k // 6, f"\u00e9{k}") for k in range(300, 600))
    import gzip

    first = next(p for p in files if p.name == "chunk-50.txt.gz" and "source_id=d" in str(p))
    assert gzip.open(first, "rt", encoding="utf-8").read() == "\u00e9305\n\u00e9303\n\u00e9301\n"
    folder.write_lines(lines, str(tmp_path / "plain"), compress=False)
    assert folder.read_lines(spark, str(tmp_path / "plain")).count() == 600


def test_one_row_group_in_many_splits_is_dealt_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from linefold.session import spread

    path, size = str(tmp_path / "one"), "spark.sql.files.maxPartitionBytes"
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("raw")).coalesce(1).write.parquet(path)
    spark.conf.set(size, "64k")
    try:
        rows = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert rows.rdd.getNumPartitions() >= cores  # many splits, one of which has all rows
        shares = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
        assert max(shares) * cores <= 1.5 * sum(shares) and sum(shares) == 40_000
        even = spark.range(0, 1000, 1, cores)
        assert spread(even) is even
    finally:
        spark.conf.unset(size)
