"""Operators on small fixtures: batches, collapse, sinks, registries, streams, plans."""

import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linefold.operators import batching, collapse, deny, lockout, reports, routing
from linefold.plans.flow import LogFlow, split_targets
from linefold.sinks import folder, hec
from linefold.sources import messages, registries
from linefold.streaming import ingest
from tests import model

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOGS = "source_id string, recv_ts timestamp, seq long, raw string"
SOURCES = "source_id string, source_name string, source_ip string, listener_port int, protocol string, target_type string, batch_size long, hec_url string, hec_token string"
RULES = "source_id string, field string, value string, enabled boolean, created double"
POLICIES = "source_id string, fields array<string>, enabled boolean, created double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def logs(spark, rows):
    return spark.createDataFrame(rows, LOGS)


def plain_batches(times, size, idle):
    """Batch number of each time, closed by size or silence."""
    out, number, held, last = [], 0, 0, None
    for t in times:
        if held and (held == size or t - last >= idle):
            number, held = number + 1, 0
        held += 1
        last = t
        out.append(number)
    return out


def test_batches_match_a_plain_loop(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for source in ("a", "b"):
        # A flood in one interval with many equal times, then sparse lines and exact gaps.
        times = sorted([rnd.choice([0, 0.001, 0.0010005, 3, 59.999]) for _ in range(60)]
                       + [rnd.uniform(60, 4000) for _ in range(60)] + [5000, 5060, 5119.999999])
        for seq, (t, number) in enumerate(zip(times, plain_batches(times, 7, 60))):
            rows.append((source, at(t), seq, "x"))
            want[source, seq] = number
    rnd.shuffle(rows)
    df = logs(spark, rows)
    got = batching.assign_batches(df, 7).collect()
    for source in ("a", "b"):
        keys = sorted({(r.session, r.chunk) for r in got if r.source_id == source})
        for r in got:
            if r.source_id == source:
                assert keys.index((r.session, r.chunk)) == want[source, r.seq]


def test_batch_borders(spark):
    df = logs(spark, [("s", at(t), i, "x") for i, t in enumerate([0, 59.999, 119.999])])
    assert batching.batch_sizes(batching.assign_batches(df, 500)).count() == 2
    seven = logs(spark, [("s", at(i), i, "x") for i in range(7)])
    sizes = batching.batch_sizes(batching.assign_batches(seven, 3)).orderBy("chunk").collect()
    assert [r.rows for r in sizes] == [3, 3, 1]


def test_deny_edge_lines(spark):
    cases = [('{"a":{"b":true}}', "a.b", "True", False), ('{"a":{"b":true}}', "a.b", "true", True), ('{"a":null}', "a", "None", True),
             ('{"a":1.0}', "a", "1.0", False), ('{"a":1.0}', "a", "1", True), ('{"a.b":1}', "a.b", "1", True), ('{"a":1,"a":2}', "a", "2", False),
             ('{"a":1} x', "a", "1", True), ("a=1 b=2", "a", "1", False), ("a.b=1", "a.b", "1", True), ("[1]", "a", "1", True), ("a= b", "a", "", False)]
    df = logs(spark, [(f"s{i}", at(i), i, c[0]) for i, c in enumerate(cases)])
    rules = spark.createDataFrame([(f"s{i}", c[1], c[2], None, 1.0) for i, c in enumerate(cases)], RULES)
    kept = {r.seq for r in deny.apply_deny_rules(df, rules).collect()}
    assert kept == {i for i, c in enumerate(cases) if c[3]}


def test_collapse_edges(spark):
    lines = ["[1,2]", "[3]", "5", '{"p":"a|b","q":"c"}', '{"p":"a","q":"b|c"}', '{"p":null}', "{}", '{"p":"None","is_aggregated":"no"}']
    df = logs(spark, [("s", at(i), i, line) for i, line in enumerate(lines)])
    policies = spark.createDataFrame([("s", ["p", "q"], True, 1.0)], POLICIES)
    out = collapse.collapse(collapse.with_collapse_key(df, policies), scope="all").collect()
    texts = {r.n: r.raw for r in out}
    assert sorted(r.n for r in out) == [2, 6]
    pair = json.loads(texts[2])
    assert pair["p"] == "a|b" and pair["is_aggregated"] == "yes" and pair["total_logs_aggregated"] == 2
    assert pair["first_log_time"] == START.timestamp() + 3 and pair["last_log_time"] == START.timestamp() + 4
    # All-absent keys meet: the first of them is a list.
    assert texts[6] == "[1,2] [Aggregated: 6 logs]"
    clash = logs(spark, [("s", at(i), i, '{"p":1,"is_aggregated":"no"}') for i in range(2)])
    row = collapse.collapse(collapse.with_collapse_key(clash, policies), scope="all").collect()[0]
    assert json.loads(row.raw)["is_aggregated"] == "yes" and row.raw.count("is_aggregated") == 1


def test_policy_flag_defaults_to_off(spark):
    df = logs(spark, [("s", at(0), 0, "{}")])
    policies = spark.createDataFrame([("s", ["p"], None, 1.0)], POLICIES)
    assert collapse.with_collapse_key(df, policies).collect()[0].agg_key is None


def test_framing(spark):
    rows = [("c", 0, b"a\nb"), ("c", 1, b"\r\n\n"), ("c", 2, b"c"), ("d", 0, "é".encode()), ("e", 0, b"\xe9\xff\n")]
    df = spark.createDataFrame(rows, "conn_id string, seq long, payload binary")
    out = messages.frame_lines(df, block_rows=1).withColumn("raw", messages.decode(F.col("payload"))).orderBy("conn_id", "line_no")
    assert [(r.conn_id, r.raw) for r in out.collect()] == [("c", "a"), ("c", "b\r"), ("c", "c"), ("d", "é"), ("e", "éÿ")]


def test_framing_random_chunks(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for conn in range(6):
        data = bytes(rnd.choice(b"ab\n\xff") for _ in range(300))
        want[conn] = [line for line in data.split(b"\n") if line]
        cuts = sorted(rnd.randint(0, 300) for _ in range(40))
        for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, 300])):
            rows.append((conn, seq, data[a:b]))
    df = spark.createDataFrame(rows, "conn_id int, seq long, payload binary")
    got = messages.frame_lines(df, block_rows=4).orderBy("conn_id", "line_no").collect()
    for conn in range(6):
        assert [bytes(r.payload) for r in got if r.conn_id == conn] == want[conn]


def test_framing_flushes_on_silence(spark):
    rows = [("c", i, at(t), p) for i, (t, p) in enumerate([(0, b"a"), (29, b"b"), (59, b"c"), (60, b"d\n")])]
    df = spark.createDataFrame(rows, "conn_id string, seq long, recv_ts timestamp, payload binary")
    for block_rows in (1, 100):
        got = messages.frame_lines(df, ts="recv_ts", block_rows=block_rows).orderBy("line_no").collect()
        assert [bytes(r.payload) for r in got] == [b"ab", b"cd"]


def test_no_line_is_lost(spark):
    """Repeated times and numbers, and rows without either."""
    rows = [("s", at(0), 1, "alpha"), ("s", at(0), 1, "beta"), ("s", None, 2, "gamma"), ("s", at(5), None, "delta"), (None, at(1), 3, "x")]
    df = logs(spark, rows)
    batched = batching.assign_batches(df, 500)
    got = {r.raw: (r.session, r.chunk, r.place) for r in batched.collect()}
    assert {got["alpha"], got["beta"]} == {(0, 0, 1), (0, 0, 2)} and len(got) == 5
    assert (got["delta"], got["gamma"], got["x"]) == ((0, 0, 3), (-1, 0, 1), (0, 0, 1))
    keyed = batched.withColumn("agg_key", F.lit(None).cast("string"))
    for scope in ("batch", "minute", "all"):
        out = collapse.collapse(keyed, scope).collect()
        assert sorted(r.raw for r in out) == ["alpha", "beta", "delta", "gamma", "x"] and {r.n for r in out} == {1}


def test_lockout_matches_model(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for user in ("a", "b", "c"):
        t, attempts = 0.0, []
        for seq in range(400):
            t += rnd.choice([1, 10, 100, 299, 299.5, 300, 601, 900])
            ok = rnd.random() < (0.1 if user == "a" else 0.5)
            attempts.append((t, ok))
            rows.append((user, at(t), seq, ok))
        want[user] = model.lockout(attempts)
    df = spark.createDataFrame(rows, "user string, ts timestamp, seq long, ok boolean")
    for r in lockout.lockout(df).collect():
        assert (r.outcome, r["count"]) == want[r.user][r.seq], (r.user, r.seq)
    known = spark.createDataFrame([("a",)], "user string")
    assert lockout.lockout(df, known).where("outcome = 'unknown'").count() == 800


def small_flow(spark):
    sources = spark.createDataFrame(
        [("s0", "Zero", "10.0.0.0", 514, "UDP", "FOLDER", 3, None, None),
         ("s1", "One", "10.0.0.1", 514, "UDP", "HEC", 4, "http://one", "t1")], SOURCES)
    rules = spark.createDataFrame([("s0", "k", "0", True, 1.0)], RULES)
    policies = spark.createDataFrame([("s1", ["k"], True, 1.0)], POLICIES)
    return LogFlow(sources, rules, policies)


def small_logs(spark):
    return logs(spark, [(f"s{i % 2}", at(i), i, '{"k":%d}' % (i // 2 % 3)) for i in range(40)])


def test_folder_sink(spark, tmp_path):
    files, _ = split_targets(small_flow(spark).run(small_logs(spark), F.lit(7)))
    out, listed = str(tmp_path / "out"), str(tmp_path / "manifest")
    for _ in range(2):  # a repeated epoch replaces itself
        folder.deliver(files, out, listed, "2024-01-01-00-00-00", epoch=3)
    names = list(Path(out).rglob("*.txt.gz"))
    manifest = folder.read_manifest(spark, listed).collect()
    assert len(names) == len(manifest) == 5 and all(r.compressed and r.compression_level == 9 for r in manifest)
    events = [json.loads(r.value) for r in folder.read_lines(spark, out).collect()]
    assert len(events) == sum(r["count"] for r in manifest) == 13
    assert {e["source"] for e in events} == {"Zero"} and {e["time"] for e in events} == {7}
    assert all(e["event"]["k"] in (1, 2) for e in events)
    assert [folder.level_name(n) for n in (1, 6, 9)] == ["BEST_SPEED", "DEFAULT_COMPRESSION", "BEST_COMPRESSION"]


def record(url, token, body):
    """Test poster: one file per request in the folder named by the address."""
    import os
    import uuid

    place = url.removeprefix("file:")
    with open(os.path.join(place, uuid.uuid4().hex), "w", encoding="utf-8") as out:
        out.write(f"{token}\n{body}")
    return 200


def refuse(url, token, body):
    return 503


def test_hec_sink(spark, tmp_path):
    flow = small_flow(spark)
    _, posts = split_targets(flow.run(small_logs(spark), F.lit(7)))
    sources = flow.sources.withColumn("hec_url", F.lit(f"file:{tmp_path}"))
    hec.deliver(posts, sources, poster="tests.test_operators:record")
    bodies = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert len(bodies) == 5 and {b[0] for b in bodies} == {"t1"}
    events = [json.loads(line) for b in bodies for line in b[1:]]
    assert sum(e["event"].get("total_logs_aggregated", 1) for e in events) == 20
    with pytest.raises(Exception, match="503"):
        hec.deliver(posts, sources, poster="tests.test_operators:refuse")


@pytest.mark.parametrize("scope", ["batch", "minute"])
def test_stream_equals_batch_over_split_files(spark, tmp_path, scope):
    flow = small_flow(spark)
    flow.scope = scope
    # Twelve-row files end inside batches and minutes; the gap opens another session.
    lines = [(f"s{i % 2}", at(7 * i + (100 if i > 25 else 0)), i, '{"k":%d}' % (i // 2 % 3)) for i in range(40)]
    for k in range(4):
        logs(spark, lines[12 * k : 12 * k + 12]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(r.line for r in flow.run(logs(spark, lines), F.lit(0)).collect())
    names = ["source_id", *(["session", "chunk"] if scope == "batch" else ["minute"]), "line"]
    whole = sorted(tuple(r) for r in flow.run(logs(spark, lines), F.lit(0)).select(*names).collect())
    place = str(tmp_path / "check")

    def run():
        source = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = ingest.start(source, lambda s: flow, ingest.to_table(str(tmp_path / "out")), place, time=F.lit(0))
        query.awaitTermination()
        return query

    query = run()
    assert query.lastProgress["batchId"] >= 3
    assert spark.read.parquet(str(tmp_path / "out")).count() < len(want)
    ingest.flush(query, spark, lambda s: flow, ingest.to_table(str(tmp_path / "out")), place, time=F.lit(0))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).collect()) == whole
    # A further run finds nothing, and a later line begins a new session.
    run()
    logs(spark, [("s0", at(999), 99, '{"k":1}')]).write.mode("append").parquet(str(tmp_path / "in"))
    again = run()
    ingest.flush(again, spark, lambda s: flow, ingest.to_table(str(tmp_path / "out")), place, time=F.lit(0))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want) + 1


def test_registry_documents(spark, tmp_path):
    flow = small_flow(spark)
    registries.save_document(registries.rules_document(flow.rules), str(tmp_path / "filters"))
    back = registries.load_rules(spark, str(tmp_path / "filters")).collect()
    assert [(r.source_id, r.field, r.value, r.enabled, r.position) for r in back] == [("s0", "k", "0", True, 0)]
    registries.save_document(registries.sources_document(flow.sources), str(tmp_path / "sources"))
    held = registries.load_sources(spark, str(tmp_path / "sources")).orderBy("source_id").collect()
    assert [(r.source_id, r.source_name, r.listener_port) for r in held] == [("s0", "Zero", "514"), ("s1", "One", "514")]
    from linefold.operators import catalog

    templates = catalog.learn_templates(small_logs(spark)).withColumn("learned", F.unix_timestamp("learned").cast("double"))
    registries.save_document(registries.policies_document(flow.policies, templates), str(tmp_path / "policy"))
    assert registries.load_policies(spark, str(tmp_path / "policy")).collect()[0].fields == ["k"]
    learned = registries.load_templates(spark, str(tmp_path / "policy")).orderBy("source_id").collect()
    assert [(r.source_id, r.fields[0].field) for r in learned] == [("s0", "k"), ("s1", "k")]
    assert registries.load_rules(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "broken").write_text("{not json")
    assert registries.load_sources(spark, str(tmp_path / "broken")).count() == 0


def test_text_lines_tail(spark, tmp_path):
    (tmp_path / "service.log").write_text("".join(f"line {i}\n" for i in range(250)))
    lines = messages.text_lines(spark, str(tmp_path / "service.log"))
    last = reports.tail(lines, 3, ["file", "block", "ord"]).collect()
    assert [r.line for r in last] == ["line 247", "line 248", "line 249"]


def test_routing_last_source_wins_and_other_transport(spark):
    sources = spark.createDataFrame(
        [("a", "A", "1.1.1.1", 514, "UDP", "FOLDER", 3, None, None), ("b", "B", "1.1.1.1", 514, "TCP", "FOLDER", 3, None, None),
         ("c", "C", "2.2.2.2", 515, "UDP", "FOLDER", 3, None, None)], SOURCES)
    raw = spark.createDataFrame([("1.1.1.1", 514, "TCP"), ("1.1.1.1", 514, "UDP"), ("2.2.2.2", 515, "TCP"), ("9.9.9.9", 515, "UDP")],
                                "source_ip string, port int, transport string")
    assert [r.source_id for r in routing.attribute(raw, sources).collect()] == ["b", "b"]
    assert [(r.port, r.source_ip) for r in routing.unauthorized(raw, sources).collect()] == [(515, "9.9.9.9")]


def test_plans_stay_on_the_jvm_and_broadcast_small_tables(spark):
    from entry_queries import QUERIES

    for name in ("deliver_lines", "deny_json", "route_attributed"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan, name
        assert "Python" not in plan and "ArrowEval" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
