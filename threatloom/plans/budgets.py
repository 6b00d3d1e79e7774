"""Budgets over a batch of decisions, replay comparison and re-authorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatloom.functions.digest import sha_hex
from threatloom.plans.decide import allowlisted, in_scope, with_target
from threatloom.plans.policy import Policy, policy_columns

ACTION_BEARING = ("AUTO_ENFORCE", "SHADOW_ACTION")


def _demoted(decisions: DataFrame, over: Column, suffix: str, reasons: list[str], keep_nominal: bool) -> DataFrame:
    """Rows flagged ``over`` become OBSERVE at L0 with a fresh content hash."""
    c = F.col
    observed = F.concat(F.lit("hash--"), sha_hex(
        F.concat_ws("\x1f", F.lit("OBSERVE"), F.lit("observe"), F.lit("L0"), F.lit("0"), F.lit("null"), F.lit("[]"), c("policy_version")), 24))
    new = {
        "decision_id": F.concat(c("decision_id"), F.lit(suffix)), "disposition": F.lit("OBSERVE"), "action": F.lit("observe"),
        "rung": F.lit("L0"), "ttl_seconds": F.lit(0).cast("long"), "selector": F.lit(None).cast(decisions.schema["selector"].dataType),
        "randomization": F.array().cast(decisions.schema["randomization"].dataType), "content_hash": observed,
        "reason_codes": F.array_sort(F.array_union(c("reason_codes"), F.array(*[F.lit(r) for r in reasons]))),
    }
    if not keep_nominal:
        new["nominal_ttl_seconds"] = F.lit(0).cast("long")
    return decisions.select(*[F.when(over, new[n]).otherwise(c(n)).alias(n) if n in new else c(n) for n in decisions.columns])


def apply_action_budget(decisions: DataFrame, limit: int) -> DataFrame:
    """Keep each batch's first ``limit`` action-bearing decisions by position, demote the rest.

    Only the position of the ``limit``-th action is needed: a ranked prefix
    (pushed to the map side) gives one cutoff row per batch.
    """
    acting = F.col("disposition").isin(*ACTION_BEARING)
    by_batch = W.partitionBy("batch_id").orderBy("pos")
    cutoff = (
        decisions.where(acting).select("batch_id", "pos").withColumn("_rn", F.row_number().over(by_batch)).where(F.col("_rn") <= limit)
        .groupBy("batch_id").agg(F.max("pos").alias("_last")) if limit > 0
        else decisions.select("batch_id").distinct().withColumn("_last", F.lit(-1).cast("long")))
    joined = decisions.join(cutoff, "batch_id", "left")
    over = acting & (F.col("pos") > F.col("_last"))
    return _demoted(joined.select(*decisions.columns, "_last"), over, "-demoted", ["blast_radius_budget_exceeded"], True).drop("_last")


def challenge_allowance(policy: Policy) -> int | None:
    """Challenges allowed per hour; None when no fraction is set, 0 when nothing was measured."""
    if policy.max_challenged_fraction is None:
        return None
    if policy.measured_transactions is None:
        return 0
    return policy.measured_transactions * round(policy.max_challenged_fraction * 1_000_000) // 1_000_000


def apply_client_impact_budget(decisions: DataFrame, policy: Policy) -> DataFrame:
    """Revert challenges beyond the allowance, keeping the lowest (policy version, decision id).

    Ranks come from counts per hash prefix of the ids plus a row number inside
    one prefix, so no task sees all challenges.
    """
    allowance = challenge_allowance(policy)
    if allowance is None:
        return decisions
    challenged = F.col("action") == "proxy_challenge"
    keys = ["policy_version", "_prefix"]
    rows = decisions.where(challenged).select("policy_version", "decision_id", F.substring("decision_id", 11, 3).alias("_prefix"))
    before = rows.groupBy(*keys).agg(F.count("*").alias("_n")) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("decision_id"))).join(before, keys) \
        .where(F.col("_before") + F.col("_rn") > allowance).select("decision_id", F.lit(True).alias("_over")).distinct()
    joined = decisions.join(ranked, "decision_id", "left").select(*decisions.columns, F.coalesce("_over", F.lit(False)).alias("_over"))
    return _demoted(joined, F.col("_over"), "-challenge-budget-reverted",
                    ["client_impact_budget_exceeded", "challenge_auto_reverted_to_L0"], False).drop("_over")


BLOCKING = ("dns_nxdomain", "firewall_deny", "rate_limit", "proxy_challenge")


def replay_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per indicator: how its verdict differs between two decision sets."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        acting = F.col("action").isin(*BLOCKING) & F.col("disposition").isin(*ACTION_BEARING, "PROPOSE_OPERATOR_APPROVAL")
        tenant = F.col("tenant_id") if "tenant_id" in df.columns else F.lit(None).cast("string")
        return df.select("indicator_id", F.col("disposition").alias(f"{tag}_disposition"), F.col("rung").alias(f"{tag}_rung"),
                         acting.alias(f"{tag}_blocks"), tenant.alias(f"{tag}_tenant"))

    both = side(before, "old").join(side(after, "new"), "indicator_id", "full")
    old, new = F.coalesce("old_blocks", F.lit(False)), F.coalesce("new_blocks", F.lit(False))
    same = F.col("old_disposition").eqNullSafe(F.col("new_disposition")) & F.col("old_rung").eqNullSafe(F.col("new_rung"))
    return both.select(
        "indicator_id", F.coalesce("new_tenant", "old_tenant").alias("tenant_id"), "old_disposition", "new_disposition", "old_rung", "new_rung",
        F.when(new & ~old, "newly_blocked").when(old & ~new, "block_removed").when(same, "unchanged").otherwise("changed").alias("change_kind"))


def replay_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_kind").agg(F.count("*").alias("indicators"), F.count_distinct("tenant_id").alias("tenants"))


# The reasons below are part of the output contract.
def presence_reason(mode: Column, p: dict[str, Column]) -> Column:
    """Why the current policy no longer justifies an installed control; null when it does. Needs ``with_target``."""
    value = F.col("value")
    return (
        F.when(p["mode"] == "OFF", F.lit("posture_not_permitted: current policy mode is OFF"))
        .when((mode == "ENFORCE") & (p["mode"] != "ENFORCE"),
              F.concat(F.lit("posture_not_permitted: persisted ENFORCE under current policy mode "), p["mode"]))
        .when(allowlisted(p) & p["allowlist_precedence"],
              F.concat(F.lit("allowlisted_under_current_policy: allowlist_hit:"), value))
        .when(~in_scope(p), F.concat(F.lit("target_out_of_scope_under_current_policy: "), value)))


def stale_authorizations(actions: DataFrame, indicators: DataFrame, decisions: DataFrame, policy: Policy,
                         require_current_revision: bool = True) -> DataFrame:
    """Actions the current policy would no longer issue, with the first reason."""
    p = policy_columns(policy)
    joined = with_target(actions.join(indicators.select("indicator_id", "itype", "value"), "indicator_id", "left"))
    reason = F.when(F.col("value").isNull(), F.lit("indicator_missing"))
    if require_current_revision:
        bound = decisions.select("decision_id", F.col("policy_content_sha256").alias("_bound"), F.lit(True).alias("_decided"))
        joined = joined.join(bound, "decision_id", "left")
        reason = reason.when(F.col("_decided").isNull(), F.lit("authorizing_decision_missing")).when(
            (F.col("_bound") != "") & (F.lit(policy.content_sha256) != "") & (F.col("_bound") != policy.content_sha256),
            F.lit("policy_revision_changed"))
    reason = F.coalesce(reason, presence_reason(F.col("mode"), p))
    return joined.withColumn("stale_reason", reason).where("stale_reason is not null").select("action_id", "indicator_id", "mode", "stale_reason")
