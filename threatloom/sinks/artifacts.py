"""Decisions to control artifacts: zone lines, rule lines, receipts, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.digest import sha_hex
from threatloom.functions.net import is_ip
from threatloom.functions.text import artifact_safe, domain_under, valid_fqdn
from threatloom.operators import ledger

# Dispositions that stand for a bounded action, and pair-scoped selectors.
EXPORTABLE = ("SHADOW_ACTION", "AUTO_ENFORCE", "PROPOSE_OPERATOR_APPROVAL")
PAIR_SCOPES = ("client_destination_pair", "client_session")


def zone_header(zone: str, serial: int, live: bool) -> list[str]:
    """Fixed first lines of a policy zone file."""
    note = "; resolver-consumed policy zone" if live else "; shadow policy zone, NOT resolver-consumed"
    return [note, f"$ORIGIN {zone}.", "$TTL 30", f"@ IN SOA localhost. hostmaster.localhost. ( {serial} 5 5 30 60 )", "@ IN NS  localhost."]


def _hashed(df: DataFrame, adapter: str, bundle_id: str) -> DataFrame:
    return df.withColumns({
        "adapter": F.lit(adapter), "fragment_hash": F.concat(F.lit("frag--"), sha_hex(F.col("fragment"), 24)), "bundle_id": F.lit(bundle_id)})


def zone_fragments(decisions: DataFrame, domains: tuple[str, ...], zone: str = "policy.invalid") -> DataFrame:
    """Exact-name NXDOMAIN lines for actionable name decisions inside the adapter's own scope."""
    owner = F.regexp_replace("value", r"\.+\z", "")
    scope = F.array(*[F.lit(d.lower().rstrip(".")) for d in domains]).cast("array<string>")
    comment = artifact_safe(F.concat_ws(" ", "decision_id", "disposition", F.concat(F.lit("policy="), F.col("policy_version"))))
    rows = decisions.where(
        (F.col("itype") == "fqdn") & (F.col("action") == "dns_nxdomain") & F.col("disposition").isin(*EXPORTABLE)
        & ~F.col("value").contains("*") & valid_fqdn(F.col("value")))
    rows = rows.withColumn("owner", owner).where(F.exists(scope, lambda d: domain_under(F.col("owner"), d)))
    return _hashed(rows.select("decision_id", F.concat(F.lit("owner:"), F.col("owner")).alias("rule_id"),
                               F.concat(F.col("owner"), F.lit(" IN CNAME . ; "), comment).alias("fragment")),
                   "zone", f"zone-{zone}")


def rule_fragments(decisions: DataFrame, taken: DataFrame, tag: str = "response", rules_file: str = "response.rules") -> DataFrame:
    """IDS alert lines for address denies, address rate limits and name-pair rate limits.

    ``tag`` prefixes messages and metadata keys. Rate limits need a ceiling;
    address limits scoped to a pair need a client. ``taken`` holds rule numbers
    already in use.
    """
    c = F.col
    ceiling, scope_type, client = c("selector.rate_ceiling_per_min"), c("selector.scope_type"), c("selector.client")
    address = c("itype").isin("ipv4", "ipv6") & ~c("value").contains("/") & is_ip(c("value"))
    pair = F.coalesce(scope_type.isin(*PAIR_SCOPES), F.lit(False))
    bounded = ~pair | (F.coalesce(client, F.lit("")) != "")
    deny = address & (c("action") == "firewall_deny") & bounded
    limit = address & (c("action") == "rate_limit") & bounded & ceiling.isNotNull()
    host = (c("itype") == "fqdn") & (c("action") == "rate_limit") & pair & ceiling.isNotNull() & valid_fqdn(c("value"))
    rows = decisions.where(c("disposition").isin(*EXPORTABLE)) \
        .withColumn("_form", F.when(deny, "deny").when(limit, "limit").when(host, "host")).where("_form is not null")
    rows = rows.join(ledger.rule_numbers(rows, taken), "decision_id")
    ttl = F.greatest(F.lit(1), c("ttl_seconds"))
    safe = {n: artifact_safe(c(n)) for n in ("disposition", "rung", "decision_id", "value")}
    msg = F.concat(F.lit(f'(msg:"{tag} '), safe["disposition"], F.lit(" "), safe["value"], F.lit(" rung="), safe["rung"], F.lit('"; '))
    meta = F.concat(F.lit(f"metadata:{tag}_decision "), safe["decision_id"])
    per_min = F.when(c("_form") != "deny", F.concat(F.lit(f", {tag}_ceiling_per_min "), ceiling)).otherwise("")
    who = F.when(c("_form") == "host", F.concat(F.lit(f", {tag}_client "), artifact_safe(F.coalesce(client, F.lit("unknown"))))).otherwise("")
    rate = F.when(c("_form") != "deny", F.concat(F.lit("detection_filter:track by_src, count "), ceiling, F.lit(", seconds 60; "))).otherwise("")
    head = F.when(c("_form") == "host", F.lit("alert http any any -> any any ")).otherwise(
        F.concat(F.lit("alert ip $HOME_NET any -> "), c("value"), F.lit(" any ")))
    match = F.when(c("_form") == "host", F.concat(F.lit('http.host; content:"'), c("value"), F.lit('"; nocase; '))).otherwise("")
    fragment = F.concat(head, msg, match, meta, per_min, who, F.lit(f", {tag}_ttl_seconds "), ttl, F.lit("; "), rate,
                        F.lit("sid:"), c("rule_no"), F.lit("; rev:1;)"))
    return _hashed(rows.select("decision_id", F.concat(F.lit("sid:"), c("rule_no")).alias("rule_id"), fragment.alias("fragment")), "ids", f"ids-{rules_file}")


def bundle_digest(fragments: DataFrame) -> DataFrame:
    """One digest per bundle over all fragment hashes, in two bounded levels.

    Fragments are grouped by three hex digits of their hash (4096 groups); the
    bundle digest is taken over the group digests.
    """
    level = fragments.groupBy("bundle_id", F.substring("fragment_hash", 7, 3).alias("slot")).agg(
        F.count("*").alias("n"), sha_hex(F.array_join(F.array_sort(F.collect_list("fragment_hash")), "\n")).alias("digest"))
    return level.groupBy("bundle_id").agg(
        F.sum("n").alias("fragments"),
        F.concat(F.lit("bundle--"), sha_hex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "digest"))), lambda s: s["digest"]), "\n"), 24))
        .alias("bundle_hash"))


def receipts(fragments: DataFrame, created_at: str) -> DataFrame:
    """One receipt per compiled fragment; a decision without a fragment has none."""
    return fragments.select(
        F.concat(F.lit("receipt--"), F.substring_index("decision_id", "--", -1), F.lit("-"), F.col("adapter")).alias("receipt_id"),
        "decision_id", "adapter", "rule_id", F.lit("dry_run").alias("status"), F.lit(created_at).alias("created_at"), "bundle_id", "fragment_hash",
        (F.col("adapter") == "ids").alias("monitoring_only"))


def materialization_gaps(decisions: DataFrame, fragments: DataFrame) -> DataFrame:
    """Decisions no exporter expressed, with the capabilities that are missing."""
    c = F.col
    known = fragments.select("decision_id").distinct()
    scope = c("selector.scope_type")
    gaps = F.array_compact(F.array(
        F.when(c("action") == "proxy_challenge", "no proxy actuator").when(c("action") == "rate_limit", "no enforcing rate-limit actuator")
        .when(c("action") == "firewall_deny", "no firewall actuator"),
        F.when(c("itype") == "cidr", "no supported adapter for cidr"),
        F.when(scope != "destination_global", F.concat(F.lit("selector shape not materializable: "), scope))))
    none = F.array(F.lit("no configured adapter accepts this action and type"))
    return decisions.join(known, "decision_id", "left_anti").select(
        "decision_id", "action", "itype", F.when(F.size(gaps) > 0, gaps).otherwise(none).alias("gaps"))


def _published_rules(lines: DataFrame, kind: str) -> DataFrame:
    """Rule id and text of artifact lines."""
    line = F.col("line")
    if kind == "ids":
        rule = F.when(line.rlike(r"sid:\d+;"), F.concat(F.lit("sid:"), F.regexp_extract(line, r"sid:(\d+);", 1)))
    else:
        rule = F.when(line.rlike(r"\A\S+ IN CNAME "), F.concat(F.lit("owner:"), F.substring_index(line, " ", 1)))
    return lines.select(rule.alias("rule_id"), F.concat(F.lit("frag--"), sha_hex(line, 24)).alias("published_hash")).where("rule_id is not null")


def artifact_drift(desired: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """Desired rules against the lines of a published artifact: missing, unexpected, changed."""
    both = desired.select("rule_id", "fragment_hash").join(_published_rules(lines, kind), "rule_id", "full")
    drift = F.when(F.col("published_hash").isNull(), "missing").when(F.col("fragment_hash").isNull(), "unexpected") \
        .when(F.col("fragment_hash") != F.col("published_hash"), "changed")
    return both.withColumn("drift", drift).where("drift is not null").select("rule_id", "drift")


def write_lines(fragments: DataFrame, path: str) -> None:
    """Publish fragment lines as text part files; headers are the publisher's."""
    fragments.select("fragment").write.mode("overwrite").text(path)
