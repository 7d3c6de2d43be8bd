"""Versioned registries, their order, and heartbeats as of a moment."""

from pyspark.sql import functions as F

from linefold.operators import reports, routing
from linefold.plans.flow import LogFlow
from linefold.sources import registries
from linefold.streaming import ingest
from tests.test_operators import LOGS, RULES, SOURCES, at, logs, small_flow


def test_versions_and_order(spark, tmp_path):
    held = registries.Registry(f"{tmp_path}/sources", SOURCES)
    assert held.version(spark) == 0 and held.load(spark).count() == 0
    rows = [("b", "B", "1.1.1.1", 514, "UDP", "FOLDER", 3, None, None), ("a", "A", "1.1.1.1", 514, "UDP", "FOLDER", 3, None, None)]
    first = spark.createDataFrame(rows, SOURCES).withColumn("position", F.when(F.col("source_id") == "b", 0).otherwise(1).cast("bigint"))
    assert held.save(first) == 1
    raw = spark.createDataFrame([("1.1.1.1", 514, "UDP")], "source_ip string, port int, transport string")
    # Of equal addresses the one last in the registry counts, though its name is less.
    assert [r.source_id for r in routing.attribute(raw, held.load(spark)).collect()] == ["a"]
    registries.save_document(registries.sources_document(held.load(spark)), f"{tmp_path}/document")
    back = registries.load_sources(spark, f"{tmp_path}/document").orderBy("position")
    assert [r.source_id for r in back.collect()] == ["b", "a"]
    assert held.save(held.load(spark).where("source_id = 'b'")) == 2
    assert [r.source_id for r in routing.attribute(raw, held.load(spark)).collect()] == ["b"]
    assert held.load(spark, version=1).count() == 2
    # A version that was not pointed at is as if it had not been written.
    held.load(spark, 1).write.parquet(f"{tmp_path}/sources/versions/version=3")
    assert held.load(spark).count() == 1 and held.history(spark).count() == 3
    assert held.save(held.load(spark, 1)) == 3 and held.load(spark).count() == 2


def test_a_stream_takes_up_a_new_rule(spark, tmp_path):
    rules = registries.Registry(f"{tmp_path}/rules", RULES)
    flow = lambda s: LogFlow(small_flow(s).sources, rules.load(s), scope="minute")

    def run(*keys):
        rows = [("s0", at(60 * k), k, '{"k":"%d"}' % (k % 2)) for k in keys]
        logs(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(LOGS).parquet(str(tmp_path / "in"))
        query = ingest.start(source, flow, ingest.to_table(str(tmp_path / "out")), str(tmp_path / "check"), time=F.lit(0))
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run(0, 1, 2) == 2  # the last minute stays open
    rules.save(spark.createDataFrame([("s0", "k", "1", True, 1.0)], RULES), "created")
    assert run(3, 5, 7) == 2  # denied; the open minute stays the last
    assert run(8) == 3


def test_backlog_at_moments(spark):
    lines = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("a", None), ("b", at(20))], "source_id string, recv_ts timestamp")
    done = spark.createDataFrame([("a", at(12))], "source_id string, delivered_ts timestamp")
    moments = spark.createDataFrame([(at(0),), (at(11),), (at(11),), (at(13),), (at(30),)], "moment timestamp")
    got = {(r.source_id, int((r.moment - at(0).replace(tzinfo=None)).total_seconds()) if r.moment.tzinfo is None else 0): r.backlog
           for r in reports.backlog_at(lines, done, moments).collect()}
    assert len(got) == 8
    assert [got["a", s] for s in (0, 11, 13, 30)] == [1, 3, 2, 2] and [got["b", s] for s in (0, 11, 13, 30)] == [0, 0, 0, 1]
