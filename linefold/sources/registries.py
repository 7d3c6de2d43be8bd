"""Registry documents: sources, deny rules, policies and templates as tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linefold.functions.infer import FIELDS_TYPE
from linefold.session import staged
from linefold.sinks import store

SOURCE_FIELDS = (
    "source_name STRING, source_ip STRING, listener_port STRING, protocol STRING, "
    "target_type STRING, folder_path STRING, batch_size BIGINT, compression_enabled STRING, "
    "compression_level STRING, hec_url STRING, hec_token STRING"
)
RULE_FIELDS = "field STRING, value VARIANT, enabled BOOLEAN, created DOUBLE"
#: Column of a document that comes in pieces, and the entries of a piece; registries up to that size are one document.
PIECE, PIECE_ENTRIES = "piece", 20_000
POLICY_FIELDS = "fields ARRAY<STRING>, created DOUBLE, enabled BOOLEAN"
TEMPLATE_FIELDS = (
    "log STRING, fields MAP<STRING, STRUCT<type: STRING, example: STRING, formatted: STRING, "
    "length: BIGINT, original: STRING, format: STRING>>, timestamp DOUBLE"
)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``doc`` of the given type, one row for each of its pieces; no rows for a missing or broken document."""
    if not store.exists(spark, path):
        return spark.createDataFrame([], f"doc {schema}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema).alias("doc")).where(F.col("doc").isNotNull())


PLACE = "_place BIGINT"


def _place(entry: str) -> Column:
    """An entry's place: its own in its document, or in a piece the one it says."""
    return F.coalesce(F.col(f"{entry}._place").cast("int"), F.col("position")).alias("position")


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """``{id: {...}}`` to one row per source; ``position`` keeps the order of the document."""
    doc = _document(spark, path, f"MAP<STRING, STRUCT<{SOURCE_FIELDS}, {PLACE}>>")
    held = doc.select(F.posexplode("doc").alias("position", "source_id", "s")).select("source_id", _place("s"), "s.*")
    return held.drop("_place")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """``{id: [{...}]}`` to one row per rule; ``position`` keeps the list order.

    A value that isn't text in the document equals no field, so it is null here.
    """
    doc = _document(spark, path, f"MAP<STRING, ARRAY<STRUCT<{RULE_FIELDS}, {PLACE}>>>")
    lists = doc.select(F.explode("doc").alias("source_id", "list"))
    return lists.select("source_id", F.posexplode("list").alias("position", "r")).select(
        "source_id",
        _place("r"),
        "r.field",
        F.when(F.schema_of_variant("r.value") == "STRING", F.variant_get("r.value", "$", "string")).alias("value"),
        F.coalesce("r.enabled", F.lit(True)).alias("enabled"),
        "r.created",
    )


def load_policies(spark: SparkSession, path: str) -> DataFrame:
    """The policy half of the policy document."""
    schema = f"STRUCT<policies: MAP<STRING, STRUCT<{POLICY_FIELDS}>>>"
    doc = _document(spark, path, schema)
    return doc.select(F.explode("doc.policies").alias("source_id", "p")).select(
        "source_id", "p.fields", "p.enabled", "p.created"
    )


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """The template half: ``source_id, raw, fields, learned``."""
    schema = f"STRUCT<templates: MAP<STRING, STRUCT<{TEMPLATE_FIELDS}>>>"
    doc = _document(spark, path, schema)
    entries = F.transform(
        F.map_entries("t.fields"),
        lambda e: F.struct(
            e["key"].alias("field"),
            e["value"]["type"].alias("type"),
            e["value"]["example"].alias("example"),
            e["value"]["formatted"].alias("formatted"),
            e["value"]["length"].alias("length"),
            e["value"]["original"].alias("original"),
            e["value"]["format"].alias("format"),
        ),
    ).cast(FIELDS_TYPE)
    return doc.select(F.explode("doc.templates").alias("source_id", "t")).select(
        "source_id", F.col("t.log").alias("raw"), entries.alias("fields"), F.col("t.timestamp").alias("learned")
    )


def _by_source(entries: Column, key: str = "source_id") -> Column:
    """Map entries in source order, or by another key; only the keys are compared."""
    return F.array_sort(
        entries,
        lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0),
    )


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_place`` (from 0) in their group, or among all, and ``_part``, the range of places they lie in.

    Rows are dealt into ranges of the order and numbered inside them; ranges are summed up before. So neither a large
    group nor a large table meets in one task. Ranges are staged, as they must not change between the two looks.
    """
    ranged = staged(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    bases = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), base)
    inner = ranged.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1)
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return inner.join(bases, same).select(*rows.columns, "_part", (F.col("_base") + F.col("_row")).alias("_place"))


def _is_small(rows: DataFrame) -> bool:
    return rows.limit(PIECE_ENTRIES + 1).count() <= PIECE_ENTRIES


def _pieces(rows: DataFrame, keys: list[str], entry: Column, value: Column) -> DataFrame:
    """``piece, value``: documents of up to ``PIECE_ENTRIES`` neighbouring entries, which carry their places."""
    piece = [*keys, "_part", F.floor(F.col("_place") / PIECE_ENTRIES).alias("_piece")]
    lists = rows.groupBy(*piece).agg(F.array_sort(F.collect_list(F.struct("_place", entry.alias("_entry")))).alias("_list"))
    named = F.concat_ws("-", F.lit("p"), *[F.sha2(F.col(k), 256) for k in keys], "_part", "_piece")
    return lists.select(named.alias(PIECE), F.to_json(value).alias("value"))


def _single_document(rows: DataFrame, body: list[str]) -> DataFrame:
    """Registry rows as one JSON map, by position where they have one.

    A registry is configuration, one entry per source; one with very many comes in pieces.
    """
    order = "position" if "position" in rows.columns else "source_id"
    if not _is_small(rows):
        placed = _numbered(rows, [], [order])
        entry = F.struct("source_id", F.struct(*body, F.col("_place")).alias("_value"))
        pairs = F.transform("_list", lambda e: F.struct(e["_entry"]["source_id"], e["_entry"]["_value"]))
        return _pieces(placed, [], entry, F.map_from_entries(pairs))
    entries = rows.select(F.col(order).alias("_order"), "source_id", F.struct(*body).alias("_value")).agg(
        F.collect_list(F.struct("_order", "source_id", "_value")).alias("entries")
    )
    pairs = F.transform(_by_source(F.col("entries"), "_order"), lambda e: F.struct(e["source_id"], e["_value"]))
    return entries.select(F.to_json(F.map_from_entries(pairs)).alias("value"))


def sources_document(sources: DataFrame) -> DataFrame:
    return _single_document(sources, [c for c in sources.columns if c not in ("source_id", "position")])


RULE_COLUMNS = ["field", "value", "enabled", "created"]


def rules_document(rules: DataFrame) -> DataFrame:
    order = F.col("position" if "position" in rules.columns else "created").alias("_order")
    if not _is_small(rules):
        placed = _numbered(rules.select("source_id", order, *RULE_COLUMNS), ["source_id"], ["_order", *RULE_COLUMNS])
        listed = F.transform("_list", lambda r: r["_entry"])
        return _pieces(placed, ["source_id"], F.struct(*RULE_COLUMNS, "_place"), F.create_map("source_id", listed))
    lists = rules.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct(order, *RULE_COLUMNS))).alias("_rules")
    )
    body = F.transform("_rules", lambda r: F.struct(*[r[c].alias(c) for c in RULE_COLUMNS]))
    entries = lists.agg(F.collect_list(F.struct("source_id", body.alias("_value"))).alias("entries"))
    return entries.select(F.to_json(F.map_from_entries(_by_source(F.col("entries")))).alias("value"))


def policies_document(policies: DataFrame, templates: DataFrame) -> DataFrame:
    """Policies and templates in one document."""
    fields = F.map_from_entries(
        F.transform("fields", lambda f: F.struct(f["field"], f.dropFields("field")))
    )
    half_policies = policies.select(
        "source_id", F.struct("fields", "created", "enabled").alias("policy")
    )
    half_templates = templates.select(
        "source_id",
        F.struct(
            F.col("raw").alias("log"), fields.alias("fields"), F.col("learned").alias("timestamp")
        ).alias("template"),
    )
    both = half_policies.unionByName(half_templates, allowMissingColumns=True)
    held = lambda name: F.map_from_entries(
        _by_source(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("source_id", name))))
    )
    halves = [held("policy").alias("policies"), held("template").alias("templates")]
    value = F.to_json(F.struct("policies", "templates")).alias("value")
    if _is_small(both):
        return both.agg(*halves).select(value)
    # Both halves are without order, so a range of sources can be any part of the document.
    placed = _numbered(both, [], ["source_id"])
    return placed.groupBy("_part", F.floor(F.col("_place") / PIECE_ENTRIES).alias("_piece")).agg(*halves).select(
        F.concat_ws("-", F.lit("p"), "_part", "_piece").alias(PIECE), value
    )


def save_document(document: DataFrame, path: str) -> None:
    """Write a document, replacing what was there: one file, or one for each of its pieces."""
    if PIECE in document.columns:
        document.write.mode("overwrite").partitionBy(PIECE).text(path)
    else:
        document.coalesce(1).write.mode("overwrite").text(path)


class Registry:
    """A registry as numbered versions: each save is a new one, and a pointer names the one that holds.

    The pointer is replaced in one step once a version is whole, so a reader sees the old or the new registry, never
    parts of both. Asked at each micro-batch, ``load`` brings changes into a running stream. Rows keep their order in
    ``position``, which is made where the rows have none.
    """

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder.rstrip("/"), schema

    def _path(self, version: int) -> str:
        return f"{self.folder}/versions/version={version}"

    def version(self, spark: SparkSession) -> int:
        """The number of the version that holds, 0 if there is none."""
        pointer = f"{self.folder}/current"
        return int(spark.read.text(pointer).first()[0]) if store.exists(spark, pointer) else 0

    def save(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows as the next version; the number it got. ``order`` names the column that orders new rows."""
        spark = rows.sparkSession
        if "position" not in rows.columns:
            if _is_small(rows):
                placed = rows.withColumn("_place", F.row_number().over(Window.orderBy(order or "source_id")) - 1)
            else:
                placed = _numbered(rows, [], [order or "source_id"])
            rows = placed.withColumn("position", F.col("_place").cast("bigint"))
        number = self.version(spark) + 1
        names = [f.name for f in self._fields(spark)]
        rows.select(*names).write.mode("overwrite").parquet(self._path(number))
        store.put(f"{self.folder}/current", str(number).encode())
        return number

    def _fields(self, spark: SparkSession):
        return spark.createDataFrame([], f"{self.schema}, position BIGINT").schema.fields

    def load(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The version that holds, or an earlier one; no rows before the first save."""
        number = self.version(spark) if version is None else version
        schema = f"{self.schema}, position BIGINT"
        if not number:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._path(number))

    def history(self, spark: SparkSession) -> DataFrame:
        """All versions up to the one that holds, with their number."""
        every = spark.read.schema(f"{self.schema}, position BIGINT, version BIGINT").parquet(f"{self.folder}/versions")
        return every.where(F.col("version") <= self.version(spark))
