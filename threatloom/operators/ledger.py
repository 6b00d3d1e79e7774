"""Reports and maintenance over the decision ledger tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatloom.functions.digest import sha_hex
from threatloom.operators import scan

# Action states by role.
STATES = ("pending", "dispatching", "applied", "verified", "drifted", "failed", "expired", "revoked")
OWNING = ("pending", "dispatching", "applied", "verified", "drifted")
INSTALLED = ("applied", "verified", "drifted")
LIVE = ("pending", "applied", "verified", "drifted")
RULE_BASE = 9_100_000
RULE_SPAN = 900_000


# --- lists -------------------------------------------------------------------

def newest_first(rows: DataFrame, order: Sequence[str], limit: int, where: Column | None = None) -> DataFrame:
    """Top rows by descending order; the limit is the report's page size."""
    kept = rows if where is None else rows.where(where)
    return kept.orderBy(*[F.desc(c) for c in order]).limit(limit)


def oldest_first(rows: DataFrame, order: Sequence[str], where: Column, limit: int | None = None) -> DataFrame:
    kept = rows.where(where)
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def due_for_expiry(now: Column) -> Column:
    return F.col("state").isin(*INSTALLED) & (F.col("expires_at") <= now)


def needs_verification(older_than: Column) -> Column:
    return F.col("state").isin(*INSTALLED) & (F.col("verified_at").isNull() | (F.col("verified_at") <= older_than))


def stuck(state: str, older_than: Column, include_unreconciled: bool = False) -> Column:
    """Actions left in a transitional state past a reconcile window."""
    late = F.coalesce(F.col("last_reconciled_at") < older_than, F.lit(include_unreconciled))
    wanted = F.col("desired_state") == "ABSENT" if state == "removing" else F.lit(True)
    return (F.col("state") == state) & wanted & late


def desired_absent() -> Column:
    return (F.col("desired_state") == "ABSENT") & F.col("state").isin(*INSTALLED, "removing")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by a map-side combined maximum, not by ranking all versions."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*keys, "_last.*").select(*rows.columns)


# --- joins -------------------------------------------------------------------

def co_owned(actions: DataFrame, by_mode: bool = True) -> DataFrame:
    """Live actions whose physical rule another live action also needs."""
    keys = ["adapter", "rule_id", *(["mode"] if by_mode else [])]
    owning = actions.where(F.col("state").isin(*OWNING))
    shared = owning.groupBy(*keys).agg(F.count_distinct("action_id").alias("owners")).where("owners > 1")
    return owning.join(shared, keys)


def current_policy(versions: DataFrame, current: DataFrame) -> DataFrame:
    return versions.join(current, ["policy_version", "revision"]).where("status = 'active'")


def explain_decisions(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows behind each decision, one row per record."""
    behind = evidence.select("indicator_id", "evidence_id", "kind", "source_id", "observed_at")
    return decisions.select("decision_id", "indicator_id", "disposition", "action", "rung", "reason_codes").join(behind, "indicator_id", "left")


def explain_block(queries: DataFrame, actions: DataFrame, decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """For a reported (value, time): the action in force, its decision and its receipt.

    Actions meet their decision and receipt first: a busy target has a row for each report and action, and these are many more.
    """
    live = (F.col("reported_at") >= F.col("created_at")) & (F.col("expires_at").isNull() | (F.col("reported_at") < F.col("expires_at")))
    told = actions.join(decisions.select("decision_id", "disposition", "rung", "reason_codes"), "decision_id", "left") \
        .join(receipts.select("action_id", "receipt_id"), "action_id", "left")
    return queries.join(told, "target").where(live)


# --- counts ------------------------------------------------------------------

def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def ledger_totals(actions: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: live actions, registered and enabled sources."""
    live = actions.agg(F.count_if(F.col("state").isin(*LIVE)).alias("live_actions"))
    known = sources.agg(F.count("*").alias("sources_registered"), F.count_if("enabled").alias("sources_enabled"))
    # Both sides are one-row aggregates.
    return live.withColumn("_one", F.lit(1)).join(known.withColumn("_one", F.lit(1)), "_one").drop("_one")


# --- idempotent writes ---------------------------------------------------------

def new_rows(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the ledger does not hold, one per key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert_indicators(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing and incoming observables merged by id.

    First sighting is kept, last sighting advances, tags come from the newest
    row, a known tenant is never lost. Columns: indicator_id, itype, value,
    tags, tenant_id, first_seen, last_seen, seq (arrival order).
    """
    both = existing.unionByName(incoming)
    return both.groupBy("indicator_id").agg(
        F.min(F.struct("seq", "itype", "value")).alias("_first"), F.max(F.struct("seq", "tags")).alias("_last"),
        F.max(F.when(F.col("tenant_id").isNotNull(), F.struct("seq", "tenant_id"))).alias("_tenant"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("seq").alias("seq"),
    ).select("indicator_id", "_first.itype", "_first.value", "_last.tags", "_tenant.tenant_id", "first_seen", "last_seen", "seq")


def merge_duplicates(indicators: DataFrame, children: DataFrame, child_key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(surviving observables, children re-pointed to them).

    Names are normalised, the oldest row per (type, value) survives, and
    children that become equal on ``child_key`` collapse.
    """
    value = F.when(F.col("itype") == "fqdn", F.lower(F.regexp_replace("value", r"\.+\z", ""))).otherwise(F.col("value"))
    normal = indicators.withColumn("value", value)
    survivors = normal.groupBy("itype", "value").agg(F.min(F.struct("first_seen", "indicator_id")).alias("_keep")) \
        .select("itype", "value", F.col("_keep.indicator_id").alias("keep_id"), F.col("_keep.first_seen").alias("first_seen"))
    mapping = normal.join(survivors.drop("first_seen"), ["itype", "value"]).select("indicator_id", "keep_id")
    moved = children.join(mapping, "indicator_id").withColumn("indicator_id", F.col("keep_id")).drop("keep_id")
    return survivors.withColumnRenamed("keep_id", "indicator_id"), moved.dropDuplicates(list(child_key))


def batch_outcome(batches: DataFrame, batch_id: str) -> DataFrame:
    return batches.where(F.col("batch_id") == batch_id)


# --- audit chain ---------------------------------------------------------------

def audit_row_hash(prev: Column) -> Column:
    """Chain hash of an audit event's fields and its predecessor's hash."""
    fields = [F.col(c).cast("string") for c in ("event_id", "at", "actor", "event_type", "subject", "detail")]
    return sha_hex(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in fields], F.coalesce(prev, F.lit(""))))


def audit_breaks(events: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Events whose stored hash or link to the previous event does not verify.

    The previous hash comes from a chunked lag: only one row per chunk crosses
    a border, so no task orders the whole history.
    """
    linked = scan.lag_by_chunk(events, "event_id", ["row_hash"], chunk)
    bad_hash = audit_row_hash(F.col("prev_hash")) != F.col("row_hash")
    bad_link = ~F.col("prev_hash").eqNullSafe(F.col("prev_row_hash"))
    return linked.select("event_id", bad_hash.alias("hash_broken"), bad_link.alias("link_broken")).where("hash_broken or link_broken")


# --- rule numbers -------------------------------------------------------------

def rule_base(decision_id: Column) -> Column:
    """Preferred rule number: first four digest bytes, modulo the number range."""
    word = F.conv(F.substring(F.sha2(F.encode(decision_id, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.lit(RULE_BASE) + word % F.lit(RULE_SPAN)


def rule_numbers(decisions: DataFrame, taken: DataFrame, chunk: int = 4096) -> DataFrame:
    """Unique rule number per decision: its published one, else the preferred one or the next free above it.

    ``taken`` holds the numbers in use (column ``rule_no``), with ``decision_id`` where a decision owns its number: that decision
    keeps it (the smallest, if several). Forward probing in preferred order equals a running maximum of
    (preferred - row number). Taken numbers stay
    put: probing runs over ranks of free numbers and is mapped back. All
    running values are taken per chunk of the number range and carried over
    one-row-per-chunk totals. ``exhausted`` marks a number beyond the range, as probing never wraps around.
    """
    wanted = decisions.select("decision_id", rule_base(F.col("decision_id")).alias("base"))
    kept = None
    if "decision_id" in taken.columns:
        owned = taken.where(F.col("decision_id").isNotNull()).groupBy("decision_id").agg(F.min("rule_no").alias("rule_no"))
        kept = wanted.join(owned, "decision_id").select("decision_id", "base", F.col("rule_no").cast("long").alias("rule_no"))
        wanted = wanted.join(owned, "decision_id", "left_anti")
    taken = taken.select("rule_no").distinct()

    # Rank of each preferred number among free ones: minus the taken numbers below it.
    marks = wanted.select(F.col("base").alias("at"), "decision_id", F.lit(0).alias("is_taken")).unionByName(
        taken.select(F.col("rule_no").alias("at"), F.lit(None).cast("string").alias("decision_id"), F.lit(1).alias("is_taken")))
    below = scan.running_sums(marks, [], "at", ["at", "is_taken", "decision_id"], {"taken_below": "is_taken"}, chunk)
    free = below.where("is_taken = 0").select("decision_id", "at", (F.col("at") - F.col("taken_below")).alias("rank"), F.lit(1).alias("one"))

    numbered = scan.running_sums(free, [], "rank", ["rank", "decision_id"], {"row_no": "one"}, chunk) \
        .withColumn("lead", F.col("rank") - F.col("row_no")).withColumn("_chunk", scan.chunk_of("rank", chunk))
    inside = W.partitionBy("_chunk").orderBy("rank", "decision_id").rowsBetween(*scan.UP_TO)
    tops = numbered.groupBy("_chunk").agg(F.max("lead").alias("top")) \
        .select("_chunk", F.max("top").over(W.orderBy("_chunk").rowsBetween(*scan.BEFORE)).alias("carried"))
    placed = numbered.withColumn("_in", F.max("lead").over(inside)).join(tops, "_chunk") \
        .select("decision_id", "at", (F.greatest(F.col("_in"), F.coalesce("carried", F.col("_in"))) + F.col("row_no")).alias("slot"))

    # Back from free ranks to numbers: add the taken numbers that precede the slot.
    holes = scan.running_sums(taken.withColumn("one", F.lit(1)), [], "rule_no", ["rule_no"], {"nth": "one"}, chunk) \
        .select((F.col("rule_no") - F.col("nth") + 1).alias("slot"), F.lit(None).cast("string").alias("decision_id"), F.lit(None).cast("long").alias("at"), F.lit(1).alias("hole"))
    both = placed.withColumn("hole", F.lit(0)).unionByName(holes)
    # Holes sort first among equal slots: a free rank equal to a hole's adjusted position lies above the hole.
    both = both.withColumn("_order", 1 - F.col("hole"))
    back = scan.running_sums(both, [], "slot", ["slot", "_order", "decision_id"], {"skipped": "hole"}, chunk)
    probed = back.where("hole = 0").select("decision_id", F.col("at").alias("base"), (F.col("slot") + F.col("skipped")).alias("rule_no"))
    return (probed if kept is None else probed.unionByName(kept)).withColumn("exhausted", F.col("rule_no") >= RULE_BASE + RULE_SPAN)
