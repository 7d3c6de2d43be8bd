"""Deny rules: drop a line if any enabled rule of its source equals a value in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.functions.extract import simple_pairs
from linefold.functions.values import bind, object_fields, path_in, strict_json, value_text


def enabled_rules(rules: DataFrame) -> DataFrame:
    """Rules that count: a missing flag means enabled."""
    return rules.where(F.coalesce(F.col("enabled"), F.lit(True)))


def rules_by_source(rules: DataFrame) -> DataFrame:
    """One row per source with its enabled rules, ordered as created.

    A source's rules are one configuration list, small by nature; the result joins to the
    lines by Spark's own size check.
    """
    return (
        enabled_rules(rules)
        .groupBy("source_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("created"), F.col("field"), F.col("value")))
            ).alias("rules")
        )
    )


def _matches(raw: Column, event: Column, rules: Column, pick: Callable) -> Column:
    """``pick`` (``F.exists`` or ``F.filter``) of the rules that equal a value of the line."""

    def by_text(pairs: Column) -> Column:
        # Text values have no inner fields, so dotted names cannot match.
        return pick(
            rules,
            lambda r: ~F.contains(r["field"], F.lit("."))
            & F.coalesce(F.try_element_at(pairs, r["field"]) == r["value"], F.lit(False)),
        )

    def by_json(fields: Column) -> Column:
        hits = pick(
            rules,
            lambda r: F.coalesce(value_text(path_in(fields, r["field"])) == r["value"], F.lit(False)),
        )
        # JSON that is not an object holds no fields.
        return F.when(fields.isNotNull(), hits)

    return F.when(event.isNotNull(), bind(object_fields(event), by_json)).when(
        F.contains(raw, F.lit("=")), bind(simple_pairs(raw), by_text)
    )


def is_denied(raw: Column, event: Column, rules: Column) -> Column:
    """Whether a rule denies the line; stops at the first that does."""
    return rules.isNotNull() & F.coalesce(_matches(raw, event, rules, F.exists), F.lit(False))


def matched_rule(raw: Column, rules: Column) -> Column:
    """First rule that denies the line, or null. The line is parsed at most once."""
    found = bind(strict_json(raw), lambda event: _matches(raw, event, rules, F.filter))
    return F.when(rules.isNotNull(), F.get(found, F.lit(0)))


def apply_deny_rules(df: DataFrame, rules: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines that no enabled rule of their source denies."""
    joined = df.join(rules_by_source(rules), "source_id", "left")
    text, listed = F.col(raw), F.col("rules")
    denied = bind(strict_json(text), lambda event: is_denied(text, event, listed))
    return joined.where(listed.isNull() | ~denied).drop("rules")


def denied_lines(df: DataFrame, rules: DataFrame, raw: str = "raw") -> DataFrame:
    """Dropped lines with the rule that dropped them."""
    joined = df.join(rules_by_source(rules), "source_id", "inner")
    matched = joined.select(
        *[F.col(c) for c in df.columns],
        # A generated column is computed once for both the filter and the output.
        F.explode(F.array(matched_rule(F.col(raw), F.col("rules")))).alias("rule"),
    )
    return matched.where(F.col("rule").isNotNull()).select(
        *df.columns,
        F.col("rule.field").alias("rule_field"),
        F.col("rule.value").alias("rule_value"),
    )


def rule_counts(rules: DataFrame) -> DataFrame:
    """Total and enabled rules per source."""
    return rules.groupBy("source_id").agg(
        F.count("*").alias("total_rules"),
        F.count_if(F.coalesce(F.col("enabled"), F.lit(True))).alias("enabled_rules"),
    )
