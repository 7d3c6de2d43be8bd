"""Framing, decoding, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.base import (
    LINES_SQL,
    MESSAGES_SQL,
    SOURCES_SQL,
    logs,
    messages,
    policies,
    query,
    rules,
    sources,
    table,
    RULES_SQL,
)
from linefold.operators import catalog, routing
from linefold.sources.messages import datagrams, decode, frame_lines


@query(
    "route_attributed",
    f"""WITH {MESSAGES_SQL}, {SOURCES_SQL}
SELECT m.seq, m.port, m.source_ip, m.transport, s.source_id FROM messages m
JOIN sources s ON s.listener_port = m.port AND s.source_ip = m.source_ip
WHERE (m.port, m.transport) IN (SELECT listener_port, protocol FROM sources)""",
)
def route_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.attribute(messages(spark, sf_dir), sources(spark, sf_dir)).select(
        "seq", F.col("port").cast("bigint").alias("port"), "source_ip", "transport", "source_id"
    )


@query(
    "route_unauthorized",
    f"""WITH {MESSAGES_SQL}, {SOURCES_SQL}
SELECT m.port, m.source_ip, count(*) AS messages FROM messages m
WHERE (m.port, m.transport) IN (SELECT listener_port, protocol FROM sources)
  AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.listener_port = m.port AND s.source_ip = m.source_ip)
GROUP BY 1, 2""",
)
def route_unauthorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = routing.unauthorized_counts(messages(spark, sf_dir), sources(spark, sf_dir))
    return counts.withColumn("port", F.col("port").cast("bigint"))


@query(
    "source_settings",
    f"""WITH {LINES_SQL}, {SOURCES_SQL}
SELECT source_name, target_type, count(*) AS lines FROM lines JOIN sources USING (source_id)
WHERE source_id <> 'src3' GROUP BY 1, 2""",
)
def source_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sources(spark, sf_dir).where("source_id <> 'src3'")
    joined = routing.with_source_settings(logs(spark, sf_dir), known, "source_name", "target_type")
    return joined.groupBy("source_name", "target_type").agg(F.count("*").alias("lines"))


@query(
    "unknown_sources",
    f"WITH {LINES_SQL} SELECT seq, source_id FROM lines WHERE source_id = 'src3'",
)
def unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sources(spark, sf_dir).where("source_id <> 'src3'")
    return routing.unknown_sources(logs(spark, sf_dir), known).select("seq", "source_id")


@query(
    "rules_with_names",
    f"""WITH {SOURCES_SQL}, {RULES_SQL}
SELECT source_id, field, value, coalesce(source_name, 'Unknown') AS source_name
FROM rules LEFT JOIN sources USING (source_id)""",
)
def rules_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.with_source_name(rules(spark), sources(spark, sf_dir)).select(
        "source_id", "field", "value", "source_name"
    )


@query(
    "sources_without_policy",
    f"WITH {SOURCES_SQL} SELECT source_id, source_name FROM sources WHERE source_id = 'src4'",
)
def sources_without_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.sources_without_policy(sources(spark, sf_dir), policies(spark)).select(
        "source_id", "source_name"
    )


@query(
    "sources_with_template",
    f"""WITH {LINES_SQL}, {SOURCES_SQL}
SELECT source_id, source_name FROM sources WHERE source_id IN (SELECT source_id FROM lines)""",
)
def sources_with_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = catalog.learn_templates(logs(spark, sf_dir))
    return routing.sources_with_template(sources(spark, sf_dir), learned).select("source_id", "source_name")


@query(
    "union_lanes",
    f"""WITH {LINES_SQL}
SELECT source_id, count(*) AS lines, count(region) AS tagged FROM (
  SELECT source_id, NULL AS region FROM lines
  UNION ALL SELECT 'doc' || source, lang FROM documents) GROUP BY 1""",
)
def union_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("source")).alias("source_id"),
        F.col("text").alias("raw"),
        F.col("lang").alias("region"),
    )
    return (
        routing.union_sources(logs(spark, sf_dir), docs)
        .groupBy("source_id")
        .agg(F.count("*").alias("lines"), F.count("region").alias("tagged"))
    )


@query(
    "datagram_lines",
    """SELECT event_id AS seq, length('{"event_id":' || event_id || ',"user":{"id":' || user_id
    || '},"type":"' || event_type || '","props":' || props || '}') AS chars
FROM events WHERE event_id % 3 <> 0""",
)
def datagram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = datagrams(messages(spark, sf_dir))
    return lines.select("seq", F.length("raw").cast("bigint").alias("chars"))


@query(
    "decode_payload",
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text
  ELSE array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 256 THEN c ELSE '?' END), '') END)
  AS digest FROM documents""",
)
def decode_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every second document arrives in Latin-1, a single-byte charset.
    docs = table(spark, sf_dir, "documents")
    payload = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", "[^\\x00-\\xff]", "?"), "ISO-8859-1")
    )
    return docs.select("doc_id", F.md5(F.encode(decode(payload), "UTF-8")).alias("digest"))


@query(
    "frame_lines",
    """SELECT doc_id, line_no, md5(line) AS digest FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents)
WHERE length(line) > 0""",
)
def framed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(0).cast("bigint").alias("seq"), F.encode("text", "UTF-8").alias("payload")
    )
    return frame_lines(docs, conn="doc_id").select("doc_id", "line_no", F.md5("payload").alias("digest"))


@query(
    "frame_chunks",
    """WITH whole AS (
  SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1)
SELECT conv_id, line_no, md5(line) AS digest FROM (
  SELECT conv_id, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM whole)
WHERE length(line) > 0""",
)
def framed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), F.encode("text", "UTF-8").alias("payload")
    )
    # Tiny blocks, so that lines cross block borders.
    return frame_lines(chunks, conn="conv_id", block_rows=2).select(
        "conv_id", "line_no", F.md5("payload").alias("digest")
    )
