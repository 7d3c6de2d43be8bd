"""The whole path of a log line as one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.functions.values import bind, strict_json
from linefold.operators import batching, collapse, deny, envelope, routing
from linefold.session import staged


def source_settings(
    sources: DataFrame, rules: DataFrame | None = None, policies: DataFrame | None = None
) -> DataFrame:
    """One row per source: delivery settings, enabled rules, active policy fields."""
    settings = sources.select(
        "source_id",
        "source_name",
        "target_type",
        F.coalesce(
            F.col("batch_size").cast("bigint"),
            batching.default_batch_size(F.col("target_type")).cast("bigint"),
        ).alias("batch_size"),
    )
    if rules is None:
        no_rules = "array<struct<created:double,field:string,value:string>>"
        settings = settings.withColumn("rules", F.lit(None).cast(no_rules))
    else:
        settings = settings.join(deny.rules_by_source(rules), "source_id", "left")
    if policies is None:
        return settings.withColumn("policy_fields", F.lit(None).cast("array<string>"))
    return settings.join(collapse.active_policies(policies), "source_id", "left")


@dataclass
class LogFlow:
    """Sources, deny rules and policies applied to log lines.

    ``scope`` is ``batch`` for size-or-gap batches per source, or ``minute`` / ``all``,
    which need no numbering at all. ``kv_mode`` picks the key=value reading.
    """

    sources: DataFrame
    rules: DataFrame | None = None
    policies: DataFrame | None = None
    scope: str = "batch"
    kv_mode: str = "compat"
    idle_seconds: int = batching.IDLE_SECONDS

    def attribute(self, raw: DataFrame) -> DataFrame:
        """Raw decoded messages (``port, transport, source_ip, recv_ts, seq, raw``) to lines."""
        return routing.attribute(raw, self.sources).select("source_id", "recv_ts", "seq", "raw")

    def kept(self, logs: DataFrame) -> DataFrame:
        """Lines of known sources that no rule denies, with settings and ``agg_key``.

        A line is parsed once, for the rules and for the key.
        """
        settings = source_settings(self.sources, self.rules, self.policies)
        joined = logs.join(settings, "source_id")
        raw, rules, fields = F.col("raw"), F.col("rules"), F.col("policy_fields")

        def read(event: Column) -> Column:
            denied = F.lit(False) if self.rules is None else F.coalesce(deny.is_denied(raw, event, rules), F.lit(False))
            key = F.lit(None).cast("string")
            if self.policies is not None:
                key = F.when(~denied & fields.isNotNull(), collapse.key_of("raw", event, fields, self.kv_mode))
            return F.struct((denied & rules.isNotNull()).alias("denied"), key.alias("agg_key"))

        if self.rules is None and self.policies is None:
            return joined.withColumn("agg_key", F.lit(None).cast("string")).drop("rules", "policy_fields")
        # A generated column is computed once for both the filter and the output.
        seen = joined.select("*", F.inline(F.array(bind(strict_json(raw), read))))
        return seen.where(~F.col("denied")).drop("denied", "rules", "policy_fields")

    def batched(self, logs: DataFrame) -> DataFrame:
        """Kept lines with their batch. Numbering looks at the lines more than once, and reading a line costs many
        times what writing it does, so kept lines are staged."""
        return batching.assign_batches(staged(self.kept(logs), "kept"), F.col("batch_size"), self.idle_seconds)

    def lines(self, logs: DataFrame) -> DataFrame:
        """Kept lines with what their scope groups them by."""
        return self.batched(logs) if self.scope == "batch" else self.kept(logs)

    def collapsed(self, lines: DataFrame) -> DataFrame:
        return collapse.collapse(
            lines, self.scope, key="agg_key", mode=self.kv_mode, carry=["source_name", "target_type"]
        )

    def delivered(self, lines: DataFrame, time: Column | None = None) -> DataFrame:
        return envelope.envelope(self.collapsed(lines), time)

    def run(self, logs: DataFrame, time: Column | None = None) -> DataFrame:
        """Delivery lines with their batch, target and source."""
        return self.delivered(self.lines(logs), time)


def split_targets(delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery lines for the folder and for the HEC targets."""
    return (
        delivered.where(F.col("target_type") == "FOLDER"),
        delivered.where(F.col("target_type") == "HEC"),
    )
