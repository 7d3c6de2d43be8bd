"""Format detection, field extraction, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.base import LINES_SQL, lines_of, logs, pair_line, query, table
from linefold.functions import extract
from linefold.functions.infer import typed_field
from linefold.functions.values import bind, ellipsize, fixed2, float_text, strict_json
from linefold.operators import catalog

TEXTS_SQL = """
texts AS (
  SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id, text AS raw FROM documents
  UNION ALL SELECT 'talk', conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'json', CAST(event_id AS VARCHAR), props FROM events
  UNION ALL SELECT 'pairs', CAST(event_id AS VARCHAR), 'id=' || event_id || ' type=' || event_type || ' user=' || user_id FROM events
  UNION ALL SELECT 'value', CAST(event_id AS VARCHAR), '[' || event_id || ']' FROM events
  UNION ALL SELECT 'stamp', CAST(event_id AS VARCHAR),
    CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'x ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 2 THEN 'at ' || strftime(ts, '%m/%d/%Y %H:%M:%S')
      WHEN 3 THEN strftime(ts, '%b %d %H:%M:%S') || ' host' ELSE strftime(ts, '%d-%b-%Y %H:%M:%S') END
    || ' ' || event_type || ' from 10.0.' || (user_id % 300) || '.' || user_id FROM events)"""


def stamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line with one of five kinds of stamps: ``id, raw``."""
    events = lines_of(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    stamp = lambda pattern: F.date_format("t", pattern)
    case = F.col("event_id") % 5
    lead = (
        F.when(case == 0, F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("x "), stamp("yyyy-MM-dd HH:mm:ss")))
        .when(case == 1, stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(case == 2, F.concat(F.lit("at "), stamp("MM/dd/yyyy HH:mm:ss")))
        .when(case == 3, F.concat(stamp("MMM dd HH:mm:ss"), F.lit(" host")))
        .otherwise(stamp("dd-MMM-yyyy HH:mm:ss"))
    )
    return events.select(F.col("event_id").cast("string").alias("id"), F.concat(lead, *origin()).alias("raw"))


def origin() -> list[Column]:
    address = (F.col("user_id") % 300).cast("string"), F.lit("."), F.col("user_id").cast("string")
    return [F.lit(" "), F.col("event_type"), F.lit(" from 10.0."), *address]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of line the tables can give: ``kind, id, raw``."""
    events = lines_of(spark, sf_dir, "events")
    key = F.col("event_id").cast("string").alias("id")
    lanes = [
        lines_of(spark, sf_dir, "documents").select(
            F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw")
        ),
        table(spark, sf_dir, "conversations").select(
            F.lit("talk").alias("kind"),
            F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            F.col("text").alias("raw"),
        ),
        table(spark, sf_dir, "pages").select(
            F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("raw")
        ),
        events.select(F.lit("json").alias("kind"), key, F.col("props").alias("raw")),
        events.select(F.lit("pairs").alias("kind"), key, pair_line().alias("raw")),
        events.select(
            F.lit("value").alias("kind"), key, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")).alias("raw")
        ),
        stamped_lines(spark, sf_dir).select(F.lit("stamp").alias("kind"), "id", "raw"),
    ]
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out


@query(
    "format_detect",
    f"""WITH {TEXTS_SQL}
SELECT kind, id, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'OBJECT' THEN 'json' ELSE 'json_value' END
  WHEN contains(raw, '=') THEN 'pairs'
  WHEN contains(raw, ':') AND NOT starts_with(trim(raw), '{{') THEN 'colon'
  WHEN contains(raw, chr(9)) THEN 'tab' WHEN contains(raw, ';') THEN 'semicolon'
  WHEN contains(raw, ',') AND NOT contains(raw, '"') THEN 'comma'
  WHEN contains(raw, '|') THEN 'pipe' ELSE 'free' END AS form FROM texts""",
)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    form = bind(strict_json(raw), lambda event: extract.detect_format(raw, event))
    return texts(spark, sf_dir).select("kind", "id", form.alias("form"))


@query(
    "format_counts",
    f"""WITH {LINES_SQL}, mixed AS (
  SELECT source_id, CASE WHEN seq % 2 = 0 THEN 'json' ELSE 'pairs' END AS form FROM lines)
SELECT source_id, form, count(*) AS lines FROM mixed GROUP BY 1, 2""",
)
def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from entry_queries.base import json_line

    mixed = logs(spark, sf_dir, F.when(F.col("event_id") % 2 == 0, json_line()).otherwise(pair_line()))
    return catalog.format_counts(mixed)


@query(
    "level_detect",
    f"""WITH {TEXTS_SQL}
SELECT kind, id, upper(nullif(regexp_extract(raw,
  '(?i)\\b(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)\\b', 1), '')) AS level FROM texts WHERE kind <> 'doc' AND kind <> 'talk'
UNION ALL SELECT kind, id, upper(nullif(regexp_extract(raw,
  '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL|TRACE)(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ''))
FROM texts WHERE kind = 'doc' OR kind = 'talk'""",
)
def level_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("kind", "id", extract.detect_level(F.col("raw")).alias("level"))


@query(
    "ip_detect",
    f"""WITH {TEXTS_SQL}
SELECT kind, id, nullif(regexp_extract(raw, '(?:^|[^\\p{{L}}\\p{{N}}_])(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '')
  AS address FROM texts""",
)
def ip_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("kind", "id", extract.detect_address(F.col("raw")).alias("address"))


@query(
    "stamp_detect",
    f"""WITH {TEXTS_SQL}
SELECT id, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'datetime' WHEN 1 THEN 'datetime' WHEN 2 THEN 'MM/DD/YYYY'
    WHEN 3 THEN 'Syslog' ELSE 'DD-MMM-YYYY' END AS format,
  CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN regexp_extract(raw, 'x (.{{19}})', 1) WHEN 1 THEN left(raw, 26)
    WHEN 2 THEN substr(raw, 4, 19) WHEN 3 THEN left(raw, 15) ELSE left(raw, 20) END AS stamp
FROM texts WHERE kind = 'stamp'""",
)
def stamp_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.detect_stamp(F.col("raw"))
    return stamped_lines(spark, sf_dir).select("id", F.explode(F.array(found)).alias("s")).select("id", "s.format", "s.stamp")


# Relational reading of the compatible key=value rules for lines without " = ".
PAIR_WRITES_SQL = """
marks(mark, place) AS (VALUES (' ', 0), (',', 1), (';', 2), ('|', 3), (chr(9), 4)),
seps(sep, sord) AS (VALUES ('=', 0), (':', 1), ('->', 2), ('=>', 3), (' - ', 4)),
counted AS (
  SELECT id, raw, mark, row_number() OVER (PARTITION BY id
    ORDER BY length(raw) - length(replace(raw, mark, '')) DESC, place) AS turn FROM src, marks),
parts AS (
  SELECT id, turn, unnest(string_split(raw, mark)) AS part,
         generate_subscripts(string_split(raw, mark), 1) AS pos FROM counted),
cut AS (
  SELECT id, turn, sord, pos, trim(part[1:strpos(trim(part), sep) - 1]) AS k,
         trim(substr(trim(part), strpos(trim(part), sep) + length(sep))) AS v
  FROM (SELECT id, turn, pos, trim(part) AS part FROM parts) p, seps WHERE contains(part, sep)),
writes AS (SELECT id, k, v, row_number() OVER (PARTITION BY id ORDER BY turn, sord, pos) AS step
  FROM cut WHERE k <> '' AND v <> '')"""


@query(
    "pairs_compat",
    f"""WITH src AS (
  SELECT event_id AS id, 'id=' || event_id || ' type=' || event_type || ',v:' || floor(value) || ';user->' || user_id AS raw
  FROM events), {PAIR_WRITES_SQL}
SELECT id, k AS field, arg_max(v, step) AS value FROM writes GROUP BY 1, 2
UNION ALL SELECT id, 'log_level', 'ERROR' FROM src WHERE contains(raw, 'error')""",
)
def pairs_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(
            F.lit("id="), F.col("event_id").cast("string"), F.lit(" type="), F.col("event_type"), F.lit(",v:"),
            F.floor("value").cast("string"), F.lit(".0;user->"), F.col("user_id").cast("string"),
        ).alias("raw"),
    )
    return lines.select("id", F.explode(extract.pair_examples(F.col("raw"))).alias("field", "value"))


@query(
    "pairs_clean",
    f"""WITH {LINES_SQL}
SELECT seq, unnest(['id', 'type', 'user']) AS field, unnest([CAST(seq AS VARCHAR), event_type, CAST(user_id AS VARCHAR)]) AS value,
  unnest(['int', 'string', 'int']) AS type FROM lines
UNION ALL SELECT seq, 'log_level', 'ERROR', 'level' FROM lines WHERE event_type = 'error'""",
)
def pairs_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs(spark, sf_dir, pair_line())
    fields = lines.select("seq", F.explode(extract.pair_fields(F.col("raw"), "clean")).alias("f"))
    return fields.select(
        "seq", F.col("f.field").alias("field"), F.col("f.example").alias("value"), F.col("f.type").alias("type")
    )


@query(
    "pairs_simple",
    """WITH words AS (SELECT doc_id, unnest(string_split_regex(trim(replace(text, chr(10), ' ')), '\\s+')) AS w,
    generate_subscripts(string_split_regex(trim(replace(text, chr(10), ' ')), '\\s+'), 1) AS pos
  FROM (SELECT doc_id, replace(replace(text, ' of ', ' of='), ' de ', '=de ') AS text FROM documents)),
cut AS (SELECT doc_id, w[1:strpos(w, '=') - 1] AS k, substr(w, strpos(w, '=') + 1) AS v, pos FROM words WHERE contains(w, '='))
SELECT doc_id, k AS field, arg_max(v, pos) AS value FROM cut GROUP BY 1, 2""",
)
def pairs_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.replace("text", F.lit(" of "), F.lit(" of=")), F.lit(" de "), F.lit("=de "))
    docs = lines_of(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", F.explode(extract.simple_pairs(F.col("raw"))).alias("field", "value"))


@query(
    "delimited_placed",
    """WITH src AS (SELECT doc_id, replace(text, chr(10), ' ') AS raw FROM documents),
p AS (SELECT doc_id, trim(unnest(string_split(raw, ','))) AS v, generate_subscripts(string_split(raw, ','), 1) AS pos FROM src)
SELECT doc_id, count(*) AS fields, md5(string_agg('field_' || pos || '=' || v, '|' ORDER BY pos)) AS digest
FROM p WHERE v <> '' GROUP BY 1""",
)
def delimited_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines_of(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("raw")
    )
    fields = docs.select("doc_id", F.explode(F.array(extract.delimited_fields(F.col("raw"), ","))).alias("f"))
    shown = F.transform("f", lambda f: F.concat(f["field"], F.lit("="), f["example"]))
    return fields.where(F.size("f") > 0).select(
        "doc_id", F.size("f").cast("bigint").alias("fields"), F.md5(F.array_join(shown, "|").cast("binary")).alias("digest")
    )


@query(
    "delimited_header",
    """SELECT event_id AS seq, unnest(['id', 'level', 'time', 'odd']) AS field,
  unnest([CAST(event_id AS VARCHAR), event_type, strftime(ts, '%Y-%m-%d'), 'yes']) AS value,
  unnest(['int', 'level', 'timestamp', 'bool']) AS type FROM events""",
)
def delimited_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("id;level;;time;odd;extra\n"), F.col("event_id").cast("string"), F.lit("; "), F.col("event_type"),
        F.lit(";skipped;"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.lit(";yes"),
    )
    fields = logs(spark, sf_dir, line).select(
        "seq", F.explode(extract.delimited_fields(F.col("raw"), ";")).alias("f")
    )
    return fields.select(
        "seq", F.col("f.field").alias("field"), F.col("f.example").alias("value"), F.col("f.type").alias("type")
    )


@query(
    "colon_pairs",
    """SELECT event_id AS seq, unnest(['event', CASE WHEN event_id % 2 = 0 THEN 'second' || chr(10) ELSE '' END || 'level', 'k']) AS field,
  unnest([CAST(event_id AS VARCHAR), event_type, regexp_extract(props, '(\\d+)', 1)]) AS value,
  unnest(['int', CASE WHEN event_id % 2 = 0 THEN 'string' ELSE 'level' END, 'int']) AS type FROM events""",
)
def colon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit("event: "), F.col("event_id").cast("string"),
        F.when(F.col("event_id") % 2 == 0, F.lit("\nsecond")).otherwise(F.lit("")),
        F.lit("\nlevel:"), F.col("event_type"), F.lit("\nk:  "), F.regexp_extract("props", "(\\d+)", 1), F.lit("\n"),
    )
    fields = logs(spark, sf_dir, line).select("seq", F.explode(extract.colon_fields(F.col("raw"))).alias("f"))
    return fields.select(
        "seq", F.col("f.field").alias("field"), F.col("f.example").alias("value"), F.col("f.type").alias("type")
    )


@query(
    "free_text",
    """WITH words AS (SELECT doc_id, unnest(string_split_regex(trim(replace(text, chr(10), ' ')), '\\s+')) AS w,
    generate_subscripts(string_split_regex(trim(replace(text, chr(10), ' ')), '\\s+'), 1) AS pos,
    nullif(regexp_extract(text, '(?:^|[^\\p{L}\\p{N}_])(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})(?:$|[^\\p{L}\\p{N}_])', 1), '') AS ip
  FROM documents),
firsts AS (SELECT doc_id, w, any_value(ip) AS ip, min(pos) AS pos FROM words WHERE w <> '' GROUP BY 1, 2),
kept AS (SELECT doc_id, pos, 'field_' || pos || '=' || w AS f FROM firsts WHERE ip IS NULL OR w <> ip
  UNION ALL SELECT DISTINCT doc_id, 0, 'ip_address=' || ip FROM firsts WHERE ip IS NOT NULL)
SELECT doc_id, count(*) AS fields, md5(string_agg(f, '|' ORDER BY pos)) AS digest FROM kept GROUP BY 1""",
)
def free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines_of(spark, sf_dir, "documents")
    # Generated, so that the filter and the output share one extraction.
    fields = docs.select("doc_id", F.explode(F.array(extract.free_fields(F.col("text")))).alias("f"))
    shown = F.transform("f", lambda f: F.concat(f["field"], F.lit("="), f["example"]))
    return fields.where(F.size("f") > 0).select(
        "doc_id", F.size("f").cast("bigint").alias("fields"), F.md5(F.array_join(shown, "|").cast("binary")).alias("digest")
    )


@query(
    "free_text_lines",
    """SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%b %d %H:%M:%S') AS stamp,
  strftime(ts, '%S') || ' host ' || event_type || ' from 10.0.' || (user_id % 300) || '.' || user_id AS minutes,
  'host' AS first_word FROM events""",
)
def free_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog-like lines: leading stamp, message behind the first colon that ends the line."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "MMM dd HH:mm:ss")
    line = F.concat(stamp, F.lit(" host"), *origin()).alias("raw")
    lines = lines_of(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), line)
    got = lines.select("id", extract.free_examples(F.col("raw")).alias("f"))
    return got.select(
        "id",
        F.col("f")["timestamp"].alias("stamp"),
        # The clock's own first colon starts the message; its minutes lead it.
        F.regexp_replace(F.col("f")["message"], "^[0-9]+:", "").alias("minutes"),
        F.col("f")["field_4"].alias("first_word"),
    )


@query(
    "type_infer",
    """WITH v AS (SELECT l_orderkey || ':' || l_linenumber AS id, 'level' AS name, unnest([CAST(l_partkey AS VARCHAR), '1' || '_' || l_suppkey, 'mode' || l_suppkey,
  printf('%.4f', l_extendedprice), CASE WHEN l_suppkey % 2 = 0 THEN 'Yes' ELSE 'TRUE' END, l_partkey || 'e-2', '-' || l_partkey || '000']) AS value,
  unnest(['int', 'int', 'level', 'float', 'bool', 'float', 'int']) AS type FROM lineitem)
SELECT id, value, type FROM v""",
)
def type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.explode(
            F.array(
                F.col("l_partkey").cast("string"),
                F.concat(F.lit("1_"), F.col("l_suppkey").cast("string")),
                F.concat(F.lit("mode"), F.col("l_suppkey").cast("string")),
                F.format_string("%.4f", F.col("l_extendedprice").cast("double")),
                F.when(F.col("l_suppkey") % 2 == 0, "Yes").otherwise("TRUE"),
                F.concat(F.col("l_partkey").cast("string"), F.lit("e-2")),
                F.concat(F.lit("-"), F.col("l_partkey").cast("string"), F.lit("000")),
            )
        ).alias("value"),
    )
    return values.select(
        "id", "value", typed_field(F.lit("level"), F.col("value"), F.lit("pairs"))["type"].alias("type")
    )


@query(
    "number_display",
    """SELECT l_orderkey AS k, l_linenumber AS line, format('{:,}', l_partkey * 1000003) AS whole,
  printf('%.2f', l_extendedprice * l_tax) AS cents, printf('%.2f', l_quantity / 8) AS ties FROM lineitem""",
)
def number_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linefold.functions.values import thousands

    price = F.col("l_extendedprice").cast("double") * F.col("l_tax").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("line"),
        thousands((F.col("l_partkey") * 1000003).cast("string")).alias("whole"),
        bind(price, fixed2).alias("cents"),
        bind(F.col("l_quantity").cast("double") / 8, fixed2).alias("ties"),
    )


@query(
    "float_text",
    """SELECT l_orderkey AS k, l_linenumber AS line, CAST(CAST(l_extendedprice AS DOUBLE) AS VARCHAR) AS price,
  CAST(CAST(l_partkey AS DOUBLE) * 1e7 AS VARCHAR) AS big FROM lineitem""",
)
def float_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("line"),
        float_text(F.col("l_extendedprice").cast("double")).alias("price"),
        bind(F.col("l_partkey").cast("double") * 1e7, float_text).alias("big"),
    )


@query(
    "truncated_text",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS long_cut,
  CASE WHEN length(source || lang) > 5 THEN left(source || lang, 3) || '..' ELSE source || lang END AS short_cut FROM documents""",
)
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir, "documents").select(
        "doc_id",
        ellipsize(F.col("text"), 100, 97).alias("long_cut"),
        ellipsize(F.concat("source", "lang"), 5, 3, "..").alias("short_cut"),
    )


JSON_FIELD_ROWS = """
  SELECT source_id, us, seq, unnest(['event_id', 'user.id', 'type', 'props.k']) AS field,
    unnest(['int', 'int', 'str', 'int']) AS type,
    unnest([CAST(seq AS VARCHAR), CAST(user_id AS VARCHAR), event_type, regexp_extract(props, '(\\d+)', 1)]) AS example FROM lines"""


@query(
    "first_log_template",
    f"""WITH {LINES_SQL}, first AS (
  SELECT source_id, arg_min(raw, (us, seq)) AS raw FROM lines WHERE seq % 3 <> 0 GROUP BY 1)
SELECT source_id, raw, 'json' AS form, CAST(4 AS BIGINT) AS fields FROM first""",
)
def first_log_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that can become a template; every third line is a bare JSON list."""
    from entry_queries.base import json_line

    line = F.when(F.col("event_id") % 3 == 0, F.lit("[1]")).otherwise(json_line())
    return catalog.learn_templates(logs(spark, sf_dir, line)).select(
        "source_id", "raw", "form", F.size("fields").cast("bigint").alias("fields")
    )


@query(
    "new_templates",
    f"""WITH {LINES_SQL}
SELECT source_id, arg_min(raw, (us, seq)) AS raw FROM lines WHERE source_id NOT IN ('src1', 'src2') GROUP BY 1""",
)
def new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.sql("SELECT * FROM VALUES ('src1'), ('src2') AS t(source_id)")
    return catalog.new_templates(logs(spark, sf_dir), known).select("source_id", "raw")


@query(
    "template_catalog",
    f"""WITH {LINES_SQL}, f AS ({JSON_FIELD_ROWS}), r AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, field ORDER BY us, seq) AS rn FROM f)
SELECT source_id, field, type, example, CASE field WHEN 'event_id' THEN 0 WHEN 'user.id' THEN 1 WHEN 'type' THEN 2 ELSE 3 END AS ordinal,
  CASE WHEN type = 'int' THEN format('{{:,}}', CAST(example AS BIGINT)) END AS formatted,
  CASE WHEN type = 'str' THEN length(example) END AS length FROM r WHERE rn = 1""",
)
def template_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = catalog.template_catalog(catalog.learn_templates(logs(spark, sf_dir)))
    return held.select("source_id", "field", "type", "example", "ordinal", "formatted", "length")


@query(
    "field_catalog",
    f"""WITH {LINES_SQL}, f AS ({JSON_FIELD_ROWS})
SELECT source_id, field, count(*) AS rows, string_agg(DISTINCT type, ',') AS types, arg_min(example, (us, seq)) AS example,
  max(length(example)) AS longest FROM f GROUP BY 1, 2""",
)
def field_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.field_catalog(logs(spark, sf_dir))


@query(
    "field_coverage",
    f"""WITH {LINES_SQL}, n AS (SELECT source_id, count(*) AS lines, count(*) FILTER (WHERE seq % 2 = 0) AS even FROM lines GROUP BY 1)
SELECT source_id, unnest(['a', 'b']) AS field, unnest([lines, even]) AS rows, lines FROM n""",
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 2 == 0, F.lit('{"a":1,"b":2.5}')).otherwise(F.lit('{"a":"x"}'))
    lines = logs(spark, sf_dir, line)
    covered = catalog.with_coverage(catalog.field_catalog(lines), lines)
    return covered.select("source_id", "field", "rows", "lines")


@query(
    "field_catalog_free_text",
    """WITH plain AS (SELECT doc_id, source AS source_id, string_split_regex(trim(translate(text, chr(10) || '=,|:.', ' _____')), '\\s+') AS w
  FROM documents),
words AS (SELECT doc_id, source_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM plain),
firsts AS (SELECT doc_id, source_id, w, min(pos) AS pos FROM words WHERE w <> '' GROUP BY 1, 2, 3)
SELECT source_id, 'field_' || pos AS field, count(*) AS rows, arg_min(w, doc_id) AS example, max(length(w)) AS longest
FROM firsts GROUP BY 1, 2""",
)
def field_catalog_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Signs that split lines in other ways become letters of words.
    docs = lines_of(spark, sf_dir, "documents").withColumn("text", F.translate("text", "=,|:.", "_____"))
    lines = docs.select(
        F.col("source").alias("source_id"),
        F.timestamp_seconds("doc_id").alias("recv_ts"),
        F.col("doc_id").alias("seq"),
        F.col("text").alias("raw"),
    )
    return catalog.field_catalog(lines).drop("types")


@query(
    "source_schema",
    f"""WITH {LINES_SQL}
SELECT DISTINCT source_id, 'OBJECT<event_id: BIGINT, props: OBJECT<k: BIGINT>, type: STRING, user: OBJECT<id: BIGINT>>' AS schema FROM lines""",
)
def source_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_schema(logs(spark, sf_dir))


@query(
    "catalog_order",
    f"""WITH {LINES_SQL}, f AS (
  SELECT DISTINCT source_id, unnest(['id', 'type', 'user', 'message', 'host', 'timestamp']) AS field FROM lines)
SELECT source_id, field, row_number() OVER (PARTITION BY source_id ORDER BY
  CASE field WHEN 'timestamp' THEN 1 WHEN 'message' THEN 2 WHEN 'host' THEN 6 ELSE 99 END, field) AS place FROM f""",
)
def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"id":1,"host":"h","type":"t","timestamp":"'),
        F.col("ts").cast("string"), F.lit('","message":"m"}'),
    )
    held = catalog.template_catalog(catalog.learn_templates(logs(spark, sf_dir, line)))
    return catalog.display_order(held).select("source_id", "field", F.col("place").cast("bigint").alias("place"))


@query(
    "preview_fields",
    f"""WITH {LINES_SQL}, first AS (SELECT source_id, arg_min(seq, (us, seq)) AS seq, arg_min(user_id, (us, seq)) AS user_id FROM lines GROUP BY 1)
SELECT source_id, 'message=' || left('a message that is longer than thirty characters', 27) || '..., host=h, user=' || user_id AS preview FROM first""",
)
def preview_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(
        F.lit('{"user":'), F.col("user_id").cast("string"),
        F.lit(',"id":1,"host":"h","message":"a message that is longer than thirty characters"}'),
    )
    return catalog.preview(catalog.template_catalog(catalog.learn_templates(logs(spark, sf_dir, line))))


@query(
    "template_field_counts",
    f"""WITH {LINES_SQL}
SELECT source_id, CAST(4 AS BIGINT) AS fields, arg_min(raw, (us, seq)) AS raw FROM lines WHERE seq % 7 <> 0 GROUP BY 1""",
)
def template_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines teach nothing: every seventh line is one, the others have four fields."""
    from entry_queries.base import json_line

    line = F.when(F.col("event_id") % 7 == 0, F.lit(" \t ")).otherwise(json_line())
    learned = catalog.learn_templates(logs(spark, sf_dir, line), skip_blank=True)
    counts = catalog.template_field_counts(catalog.template_catalog(learned))
    return counts.join(learned.select("source_id", "raw"), "source_id")
