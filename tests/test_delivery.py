"""Delivery to folders and HTTP targets: files, manifest, ledger, dispatch; and batches closed by a clock."""

import gzip
import json
import os
import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linefold.operators import batching, lockout, ordering
from linefold.plans import dispatch
from linefold.plans.flow import LogFlow
from linefold.sinks import batch_files, hec, ledger, store
from linefold.sinks.ledger import Ledger
from linefold.streaming import ingest
from tests import model
from tests.test_operators import LOGS, SOURCES, at, logs, small_flow, small_logs


def record(url, token, body):
    """Test poster: one file per request, refused while the folder holds a file named like the token."""
    place = Path(url.removeprefix("file:"))
    if (place / f"refuse-{token}").exists() and '"k":2' in body:
        return 503
    count = len(list(place.glob("request-*")))
    (place / f"request-{count}-{os.getpid()}").write_text(f"{token}\n{body}", encoding="utf-8")
    return 200


POSTER = "tests.test_delivery:record"


def placed_sources(spark, folder, url="file:/nowhere"):
    rows = [
        ("s0", "Zero", "FOLDER", f"{folder}/zero", True, 3, None, None, 3),
        ("s1", "One", "HEC", None, None, None, url, "t1", 4),
        ("s2", "Two", "FOLDER", f"{folder}/two", None, None, None, None, 3),
        ("s3", "Three", "FOLDER", f"{folder}/three", False, 9, None, None, 3),
    ]
    return spark.createDataFrame(
        rows,
        "source_id string, source_name string, target_type string, folder_path string, compression_enabled boolean, "
        "compression_level int, hec_url string, hec_token string, batch_size long",
    )


def four_logs(spark, n=80):
    return logs(spark, [(f"s{i % 4}", at(i), i, '{"k":%d,"i":%d}' % (i // 4 % 3, i)) for i in range(n)])


def test_files_and_manifest(spark, tmp_path):
    sources = placed_sources(spark, tmp_path)
    lines = LogFlow(sources).run(four_logs(spark), F.lit(7))
    for _ in range(2):  # a repeated epoch replaces itself
        batch_files.deliver(lines, sources, f"{tmp_path}/manifest", "2024-01-01-00-00-00", epoch=3)
    entries = batch_files.read_manifest(spark, f"{tmp_path}/manifest").collect()
    sizes = lines.where("target_type = 'FOLDER'").groupBy("source_id", "session", "chunk").count().collect()
    assert sorted((r.source_id, r.session, r.chunk, r["count"]) for r in entries) == sorted(tuple(r) for r in sizes)
    assert {(r.source_id, r.compressed, r.compression_level) for r in entries} == {("s0", True, 3), ("s2", True, 9), ("s3", False, None)}
    seen = 0
    for r in entries:
        data = Path(r.filename).read_bytes()
        text = (gzip.decompress(data) if r.compressed else data).decode()
        events = [json.loads(line)["event"]["i"] for line in text.splitlines()]
        assert len(events) == r["count"] and events == sorted(events) and r.filename.endswith(".gz") == r.compressed
        seen += len(events)
    assert seen == 60 and len(entries) == len([p for p in tmp_path.glob("*/*.json*")])
    documents = {Path(r.folder).name: json.loads(r.value) for r in batch_files.index_document(batch_files.read_manifest(spark, f"{tmp_path}/manifest")).collect()}
    assert set(documents["three"]["files"][0]) == {"filename", "timestamp", "count"}
    assert documents["zero"]["files"][0]["compression_level"] == 3
    wrong = sources.withColumn("compression_level", F.lit(11))
    with pytest.raises(Exception, match="between 1 and 9"):
        batch_files.deliver(lines, wrong, f"{tmp_path}/other", "x")


def requests(place):
    return [p.read_text().split("\n") for p in sorted(Path(place).glob("request-*"))]


def test_no_request_is_sent_twice(spark, tmp_path):
    place = tmp_path / "web"
    place.mkdir()
    sources = placed_sources(spark, tmp_path, f"file:{place}")
    lines = LogFlow(sources).run(four_logs(spark), F.lit(7)).where("source_id = 's1'")
    book = Ledger(str(tmp_path / "ledger"))
    (place / "refuse-t1").touch()
    one_task = lines.coalesce(1)
    with pytest.raises(Exception, match="503"):
        hec.deliver(one_task, sources, POSTER, book, epoch=5)
    sent = requests(place)
    (place / "refuse-t1").unlink()
    hec.deliver(one_task, sources, POSTER, book, epoch=5)
    bodies = requests(place)
    assert len(sent) < len(bodies) == 5 and len({tuple(b) for b in bodies}) == 5
    assert sorted(json.loads(line)["event"]["i"] for b in bodies for line in b[1:]) == list(range(1, 80, 4))
    # The epoch again, and its lines in a later one: all is in the ledger.
    hec.deliver(one_task, sources, POSTER, book, epoch=5)
    hec.deliver(one_task, sources, POSTER, book, epoch=6)
    assert len(requests(place)) == 5
    assert book.sent(spark).agg(F.count("*"), F.sum("events")).first()[:] == (5, 20)


def test_requests_as_a_stream(spark, tmp_path):
    place, inbox = tmp_path / "web", str(tmp_path / "in")
    place.mkdir()
    sources = placed_sources(spark, tmp_path, f"file:{place}")
    bodies = hec.batch_bodies(LogFlow(sources).run(four_logs(spark), F.lit(7)), sources.where("target_type = 'HEC'"))
    bodies.coalesce(1).write.parquet(inbox)
    hec.register(spark)

    def run(check):
        stream = spark.readStream.schema(bodies.schema).parquet(inbox).writeStream.format("hec").option("poster", POSTER)
        stream = stream.option("records", str(tmp_path / "records")).option("checkpointLocation", str(tmp_path / check))
        stream.trigger(availableNow=True).start().awaitTermination()

    run("a")
    assert len(requests(place)) == 5
    run("b")  # another query over the same requests finds their records
    assert len(requests(place)) == 5


def test_dispatch_runs_the_plan_once_and_commits_by_target(spark, tmp_path):
    place = tmp_path / "web"
    place.mkdir()
    sources = placed_sources(spark, tmp_path, f"file:{place}")
    runs = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            runs.add(batch.num_rows)
            yield batch

    source = four_logs(spark)
    source = source.mapInArrow(counted, source.schema)
    lines = LogFlow(sources, scope="minute").run(source, F.lit(7))
    lines = lines.withColumns({"session": F.lit(0).cast("bigint"), "chunk": F.col("minute")})
    send = dispatch.to_targets(str(tmp_path / "out"), lambda s: sources, "2024-01-01-00-00-00", POSTER)
    (place / "refuse-t1").touch()
    with pytest.raises(RuntimeError, match="open for HEC"):
        send(lines, 4)
    assert runs.value == 80
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.json*") if p.is_file() and p.parent.name in ("zero", "two", "three")}
    assert files and [r.target for r in send.commits(spark).collect()] == ["FOLDER"]
    (place / "refuse-t1").unlink()
    send(lines, 4)
    send(lines, 4)
    assert runs.value == 80 and all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert {r.target for r in send.commits(spark).collect()} == {"FOLDER", "HEC"}
    assert len(requests(place)) == 2
    send.forget(spark, 4)
    assert not (tmp_path / "out" / "lines" / "epoch=4").exists()


def test_clock_closes_batches_of_silent_sources(spark, tmp_path):
    flow = LogFlow(placed_sources(spark, tmp_path))

    def land(folder, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    def run():
        stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        query = ingest.start(
            stream("in", LOGS), lambda s: flow, ingest.to_table(str(tmp_path / "out")), str(tmp_path / "check"),
            time=F.lit(0), ticks=stream("ticks", "tick timestamp"),
        )
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.source_id, r.session, r.chunk, r.slot, json.loads(r.line)["event"]) for r in rows)

    clock = lambda s: [(at(86_400 + s),)]
    land("in", [("s0", at(0), 0, "a0"), ("s0", at(1), 1, "a1"), ("s2", at(1), 2, "c0")], LOGS)
    land("ticks", clock(0), "tick timestamp")
    assert run() == []
    land("in", [("s2", at(30), 3, "c1")], LOGS)
    land("ticks", clock(59), "tick timestamp")
    assert run() == []
    # No line comes any more, only the clock goes on: first s0, then s2 has been silent for 60 s.
    land("ticks", clock(60), "tick timestamp")
    first = [("s0", 0, 0, 1, "a0"), ("s0", 0, 0, 2, "a1")]
    assert run() == first
    land("ticks", clock(119), "tick timestamp")
    second = first + [("s2", 0, 0, 1, "c0"), ("s2", 0, 0, 2, "c1")]
    assert run() == second
    land("ticks", clock(400), "tick timestamp")
    assert run() == second
    # A late line opens a new session, which the clock closes as well.
    land("in", [("s0", at(2), 9, "a2")], LOGS)
    land("ticks", clock(401), "tick timestamp")
    land("ticks", clock(461), "tick timestamp")
    assert run() == sorted(second + [("s0", 1, 0, 1, "a2")])


def test_stream_equals_batch_with_untimed_lines(spark, tmp_path):
    flow = LogFlow(placed_sources(spark, tmp_path))
    rows = [("s0", at(i) if i % 4 else None, i, f"x{i}") for i in range(18)] + [("s2", None, 30, "u"), ("s2", at(3), 31, "v")]
    for k in range(4):
        logs(spark, rows[5 * k : 5 * k + 5]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    names = ["source_id", "session", "chunk", "slot", "line"]
    whole = sorted(tuple(r) for r in flow.run(logs(spark, rows), F.lit(0)).select(*names).collect())
    source = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    deliver, place = ingest.to_table(str(tmp_path / "out")), str(tmp_path / "check")
    query = ingest.start(source, lambda s: flow, deliver, place, time=F.lit(0))
    query.awaitTermination()
    for _ in range(2):
        ingest.flush(query, spark, lambda s: flow, deliver, place, time=F.lit(0))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).collect()) == whole


def test_hot_seconds_are_cut(spark, monkeypatch):
    """One source whose lines share one timestamp, numbered in slices of about one size."""
    monkeypatch.setattr(ordering, "CUT_RATE", 8)
    monkeypatch.setattr(ordering, "CUT_EVERY", 20)
    rows = spark.range(20_000).select(
        F.lit("s").alias("source_id"),
        F.when(F.col("id") % 10 > 0, F.lit(at(5))).otherwise(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id"))).alias("recv_ts"),
        (F.col("id") * 7919 % 20_011).alias("seq"),
        F.lit("x").alias("raw"),
    ).repartition(5)
    cuts = ordering.hot_cuts(rows)
    sliced = ordering.add_slices(
        rows.withColumn("_part", ordering.floor_div(ordering.micros(F.col("recv_ts")), ordering.SECOND)), cuts, "source_id", ordering.micros(F.col("recv_ts")), "seq"
    )
    sizes = sorted(r["count"] for r in sliced.groupBy("_part", "_slice").count().collect())
    assert len(sizes) > 80 and sizes[-1] < 2.2 * sizes[len(sizes) // 2]
    got = batching.assign_batches(rows, 7).orderBy("recv_ts", "seq").collect()
    assert [(r.session, r.chunk, r.place) for r in got] == [(0, i // 7, i % 7 + 1) for i in range(20_000)]
    assert ordering.hot_cuts(rows.limit(100)) is None


def test_one_attacked_user_spreads_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CUT_RATE", 4)
    monkeypatch.setattr(ordering, "CUT_EVERY", 10)
    draw = random.Random(8)
    t, attempts = 0.0, []
    for _ in range(3000):
        t += draw.choice([0, 0, 0.5, 1, 40, 299.5, 301, 700])
        attempts.append((t, draw.random() < 0.15))
    rows = [("root", at(s), i, ok) for i, (s, ok) in enumerate(attempts)] + [("quiet", at(0), 0, True), (None, at(0), 1, True)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, seq long, ok boolean").repartition(4)
    made = {r.seq: (r.outcome, r["count"]) for r in lockout.lockout(df).collect() if r.user == "root"}
    assert [made[i] for i in range(3000)] == model.lockout(attempts)


RAW = "recv_ts timestamp, transport string, port int, source_ip string, conn_id string, seq long, payload binary"


def raw_messages(draw):
    """Datagrams and chunks of four connections from three addresses; one falls silent, one is closed."""
    rows, seq = [], 0
    for i in range(120):
        conn = draw.randrange(6)
        seq += 1
        time = at(i * 2 + (40 if i > 70 and conn == 1 else 0))
        if conn > 3:
            rows.append((time, "UDP", 514, f"10.0.0.{conn % 3}", None, seq, f"d{i}\nx".encode()))
        else:
            data = "".join(draw.choice(["\n", "ab", "é", "\n\n", "long" * 9]) for _ in range(draw.randint(0, 4)))
            rows.append((time, "TCP", 515, f"10.0.0.{conn % 3}", f"c{conn}", seq, data.encode()))
    rows += [(at(280 + i), "TCP", 515, f"10.0.0.{i % 3}", f"c{i}", seq + 1 + i, None) for i in range(4)]
    rows.append((at(290), "TCP", 515, "9.9.9.9", "c9", seq + 9, b"nobody\n"))
    return rows


def receiving(spark):
    sources = [(f"s{i}", f"S{i}", f"10.0.0.{i}", port, kind, "FOLDER", 4, None, None)
               for i, (port, kind) in enumerate([(514, "UDP"), (515, "TCP"), (515, "TCP")])]
    more = [("s5", "S5", "10.0.0.0", 515, "TCP", "FOLDER", 4, None, None), ("s6", "S6", "10.0.0.1", 514, "UDP", "FOLDER", 4, None, None)]
    return LogFlow(spark.createDataFrame(sources + more, SOURCES))


@pytest.mark.parametrize("most_bytes", [40, 1 << 20])
def test_messages_to_lines_in_streams_and_batches(spark, tmp_path, most_bytes):
    rows = raw_messages(random.Random(9))
    flow = receiving(spark)
    raw = spark.createDataFrame(rows, RAW)
    from linefold.sources import messages

    whole = flow.run(flow.attribute(messages.arrivals(raw, most_bytes)), F.lit(0))
    names = ["source_id", "session", "chunk", "slot", "line"]
    want = sorted(tuple(r) for r in whole.select(*names).collect())
    # What each connection sent, line by line, in plain Python, wherever nothing is silent or long.
    if most_bytes > 1000:
        sent = b"".join(r[6] or b"" for r in rows if r[4] == "c3").decode()
        lines = [json.loads(r.line)["event"] for r in whole.where("source_id = 's5'").collect()]
        assert all(line in lines for line in sent.split("\n")[:5] if line)
    receiver, out = ingest.Receiver(str(tmp_path / "check"), most_bytes), []
    for epoch, a in enumerate(range(0, len(rows), 50)):
        out += receiver.advance(flow, spark.createDataFrame(rows[a : a + 50], RAW), epoch, F.lit(0)).select(*names).collect()
    out += receiver.flush(spark, flow, epoch, F.lit(0)).select(*names).collect()
    assert sorted(tuple(r) for r in out) == want and len(want) > 50


def test_clock_ends_silent_connections(spark, tmp_path):
    framing = ingest.Framing(str(tmp_path / "rest"))
    chunk = lambda s, seq, data: spark.createDataFrame([(at(s), "TCP", 515, "1.1.1.1", "c", seq, data)], RAW)
    none = spark.createDataFrame([], RAW)
    got = lambda df: [(r.line_no, bytes(r.payload)) for r in df.orderBy("line_no").collect()]
    assert got(framing.advance(chunk(0, 0, b"a\nbc"), 0, at(1))) == [(0, b"a")]
    assert got(framing.advance(none, 1, at(29))) == []
    assert got(framing.advance(none, 2, at(30))) == [(1, b"bc")]
    assert got(framing.advance(none, 3, at(99))) == []
    assert got(framing.advance(chunk(100, 1, b"d\ne"), 4, at(101))) == [(2, b"d")]
    assert got(framing.advance(chunk(101, 2, None), 5, at(102))) == [(3, b"e")]
    assert framing.flush(spark, 5).count() == 0


def test_records_lie_in_folders_that_tasks_read(spark, tmp_path):
    book = Ledger(str(tmp_path / "ledger"))
    for k in range(300):
        ledger.record(book.open_folder(1), f"r{k}", ("src1", None if k == 7 else k, 0), k, 200)
    assert ledger.recorded(book.open_folder(1), "r5") and not ledger.recorded(book.open_folder(1), "r300")
    open_ = tmp_path / "ledger" / "open" / "epoch=1"
    assert all(x.is_dir() for x in open_.iterdir())
    (next(open_.iterdir()) / ".unfinished").write_bytes(b"{")
    scan = ledger.records(spark, book.open_folder(1))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in scan
    book.settle(spark, 1)
    got = {(r.request_id, r.session, r.events, r.epoch) for r in book.sent(spark).collect()}
    assert got == {(f"r{k}", None if k == 7 else k, k, 1) for k in range(300)} and not open_.exists()


def test_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.json").write_text("one\nÄ\n", encoding="utf-8")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b"two\n"))
    rows = [(k, None if name is None else str(tmp_path / name)) for k, name in enumerate(["a.json", "b.json.gz", "c.json", None])]
    got = store.with_text(spark.createDataFrame(rows, "k long, file string"), "file").select("k", "value").collect()
    assert sorted(map(tuple, got)) == [(0, "one\nÄ\n"), (1, "two\n")]
