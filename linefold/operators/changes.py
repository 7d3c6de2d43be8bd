"""Current registries from their change logs.

Each fold is a set of keyed aggregations (latest, first, count), so a long change log of
one source combines before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.operators.batching import default_batch_size
from linefold.operators.validation import validate_sources


def _latest(value: str, when: Column, order: str = "ord") -> Column:
    """Value of the latest row that meets the condition."""
    return F.max_by(F.col(value), F.when(when, F.col(order)))


def rule_state(changes: DataFrame) -> DataFrame:
    """Deny rules after ``add / remove / toggle / clear`` in ``ord`` order.

    An add to an existing (source, field) changes only its value. A toggle flips the flag
    of an existing rule. Order of rules: as first added.
    """
    op = F.col("op")
    keys = ["source_id", "field"]
    cleared = changes.where(op == "clear").groupBy("source_id").agg(F.max("ord").alias("cleared"))
    removed = changes.where(op == "remove").groupBy(*keys).agg(F.max("ord").alias("removed"))
    cut = F.greatest(F.coalesce("cleared", F.lit(-1)), F.coalesce("removed", F.lit(-1)))
    live = (
        changes.where(op.isin("add", "toggle"))
        .join(cleared, "source_id", "left")
        .join(removed, keys, "left")
        .where(F.col("ord") > cut)
        .drop("cleared", "removed")
    )
    added = live.where(op == "add").groupBy(*keys).agg(
        F.min("ord").alias("first_ord"),
        F.max_by("value", "ord").alias("value"),
        F.min_by("ts", "ord").alias("created"),
    )
    flips = (
        live.where(op == "toggle")
        .join(added.select(*keys, "first_ord"), keys)
        .where(F.col("ord") > F.col("first_ord"))
        .groupBy(*keys)
        .agg(F.count("*").alias("flips"))
    )
    return added.join(flips, keys, "left").select(
        "source_id",
        "field",
        "value",
        (F.coalesce("flips", F.lit(0)) % 2 == 0).alias("enabled"),
        "created",
        F.col("first_ord").alias("position"),
    )


def template_state(changes: DataFrame) -> DataFrame:
    """Sources with a live template: ``source_id, since, learned_ord``."""
    op = F.col("op")
    dropped = F.max(F.when(op == "delete_template", F.col("ord")))
    cuts = changes.groupBy("source_id").agg(F.coalesce(dropped, F.lit(-1)).alias("cut"))
    return (
        changes.where(op == "template")
        .join(cuts, "source_id")
        .where(F.col("ord") > F.col("cut"))
        .groupBy("source_id")
        .agg(F.min("ord").alias("since"), F.max("ord").alias("learned_ord"))
    )


def policy_state(changes: DataFrame) -> DataFrame:
    """Policies after ``template / create / update / delete / delete_template``.

    A create needs a live template and starts afresh; an update needs a policy and changes
    the parts it names; losing the template loses the policy.
    """
    op = F.col("op")
    deleted = F.max(F.when(op.isin("delete", "delete_template"), F.col("ord")))
    cuts = changes.groupBy("source_id").agg(F.coalesce(deleted, F.lit(-1)).alias("cut"))
    live = changes.join(cuts, "source_id").where(F.col("ord") > F.col("cut"))
    created = (
        live.where(op == "create")
        .join(template_state(changes), "source_id")
        .where(F.col("ord") > F.col("since"))
        .groupBy("source_id")
        .agg(F.max("ord").alias("created_ord"), F.max_by("fields", "ord").alias("base_fields"))
    )
    later = (op == "update") & (F.col("ord") > F.col("created_ord"))
    updated = (
        live.join(created.select("source_id", "created_ord"), "source_id")
        .where(later)
        .groupBy("source_id")
        .agg(
            _latest("fields", F.col("fields").isNotNull()).alias("new_fields"),
            _latest("enabled", F.col("enabled").isNotNull()).alias("new_enabled"),
        )
    )
    return created.join(updated, "source_id", "left").select(
        "source_id",
        F.coalesce("new_fields", "base_fields").alias("fields"),
        F.coalesce("new_enabled", F.lit(True)).alias("enabled"),
        "created_ord",
    )


SOURCE_COLUMNS = [
    "source_name", "source_ip", "listener_port", "protocol", "target_type", "folder_path",
    "batch_size", "compression_enabled", "compression_level", "hec_url", "hec_token",
]


def source_state(changes: DataFrame) -> DataFrame:
    """Sources after ``add / update / delete``: the latest content of each set column."""
    op = F.col("op")
    gone = F.max(F.when(op == "delete", F.col("ord")))
    cuts = changes.groupBy("source_id").agg(F.coalesce(gone, F.lit(-1)).alias("cut"))
    added = changes.where(op == "add").groupBy("source_id").agg(F.max("ord").alias("added"))
    live = (
        changes.where(op.isin("add", "update"))
        .join(cuts, "source_id")
        .join(added, "source_id")
        .where((F.col("ord") > F.col("cut")) & (F.col("added") > F.col("cut")))
        .where(F.col("ord") >= F.col("added"))
    )
    merged = live.groupBy("source_id").agg(
        F.min("ord").alias("position"),
        *[_latest(c, F.col(c).isNotNull()).alias(c) for c in SOURCE_COLUMNS],
    )
    return fill_defaults(merged)


def fill_defaults(sources: DataFrame) -> DataFrame:
    """Protocol UDP and the batch size of the target where not given."""
    return sources.withColumn("protocol", F.coalesce("protocol", F.lit("UDP"))).withColumn(
        "batch_size",
        F.coalesce(
            F.col("batch_size").cast("bigint"),
            F.when(F.col("target_type").isin("HEC", "FOLDER"), default_batch_size(F.col("target_type"))),
        ).cast("bigint"),
    )


def add_sources(current: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """Outcome of adding sources one by one: ``source_id, accepted, error``.

    An address in use is refused before the settings are checked; an address counts as in
    use once a valid earlier row took it.
    """
    checked = validate_sources(fill_defaults(incoming))
    holders = current.groupBy("source_ip").agg(F.min_by("source_name", "source_id").alias("holder"))
    # The first valid newcomer of a free address takes it.
    takers = (
        incoming.join(checked.select("source_id", "valid"), "source_id")
        .where("valid")
        .groupBy("source_ip")
        .agg(
            F.min(order).alias("taken_at"),
            F.min_by("source_name", order).alias("taker"),
        )
    )
    judged = (
        incoming.join(checked, "source_id")
        .join(holders, "source_ip", "left")
        .join(takers, "source_ip", "left")
    )
    user = F.when(F.col("holder").isNotNull(), F.col("holder")).when(
        F.col(order) > F.col("taken_at"), F.col("taker")
    )
    clash = F.concat(
        F.lit("IP address "), F.col("source_ip"), F.lit(" is already used by source '"), user, F.lit("'")
    )
    return judged.select(
        "source_id",
        (user.isNull() & F.col("valid")).alias("accepted"),
        F.when(user.isNotNull(), clash).otherwise(F.col("error")).alias("error"),
    )


def rule_preview(rules: DataFrame, count: int = 2) -> DataFrame:
    """The first rules of each source, then only the enabled ones among them."""
    ordered = Window.partitionBy("source_id").orderBy("position")
    return (
        rules.withColumn("place", F.row_number().over(ordered))
        .where(F.col("place") <= count)
        .where(F.coalesce(F.col("enabled"), F.lit(True)))
        .select("source_id", "place", "field", "value")
    )
