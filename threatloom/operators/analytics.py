"""Population, coverage and outcome analytics over telemetry and ledger frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threatloom.functions.net import ipv4_cidr_bounds, ipv4_number
from threatloom.functions.text import name_suffixes, strip_dots
from threatloom.operators import scan
from threatloom.session import cut_lineage


def _ratio_micros(part: str, whole: str) -> Column:
    return F.expr(f"{part} * 1000000 div {whole}")


# --- scope and class lookups by key, for lists of any length -------------------

def scoped_names(names: DataFrame, domains: DataFrame) -> DataFrame:
    """Add ``in_scope``: some suffix of ``value`` is an authorised domain.

    Every name meets the list by equality on its suffixes, so a long list costs
    one join instead of a comparison per entry.
    """
    suffixes = names.select("value", F.explode(name_suffixes(F.lower(strip_dots(F.col("value"))))).alias("domain")).distinct()
    hits = suffixes.join(domains.select(F.lower(strip_dots(F.col("domain"))).alias("domain")).distinct(), "domain", "left_semi").select("value").distinct()
    return names.join(hits.withColumn("in_scope", F.lit(True)), "value", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def prefix_matches(addresses: DataFrame, prefixes: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Join IPv4 ``address`` to every prefix of ``prefixes`` (column ``prefix``) that holds it.

    ``lengths`` lists the prefix lengths in use; each address is masked to each
    of them and met by equality.
    """
    low, _, length = ipv4_cidr_bounds(F.col("prefix"))
    listed = prefixes.withColumn("_low", low).withColumn("_len", length)
    masks = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(1 << (32 - n)).cast("long").alias("size")) for n in sorted(set(lengths))])
    masked = addresses.withColumn("_n", ipv4_number(F.col("address"))).where("_n is not null").withColumn("_m", F.explode(masks)) \
        .withColumn("_low", F.col("_n") - F.col("_n") % F.col("_m.size")).withColumn("_len", F.col("_m.len"))
    return masked.join(listed, ["_low", "_len"]).drop("_low", "_len", "_n", "_m")


def allowlist_matches(values: DataFrame, allowlist: DataFrame, scope: str, now: str) -> DataFrame:
    """First unexpired entry per value for allowlists kept as a table.

    ``allowlist``: pos, canonical, scope, expires_at text. Adds ``allowlisted``
    and ``allow_reason``; an unreadable expiry protects nothing but is named.
    """
    from threatloom.functions.instants import parse_instant, utc_literal

    expiry = parse_instant(F.col("expires_at"))
    alive = allowlist.where(F.col("scope").isin(scope, "*")).withColumn("_expiry", expiry) \
        .where(F.coalesce(F.col("_expiry") >= utc_literal(now), F.lit(True)))
    first = alive.groupBy("canonical").agg(F.min(F.struct("pos", (F.col("expires_at").isNull() | F.col("_expiry").isNotNull()).alias("readable"))).alias("_entry"))
    joined = values.join(first, values["allow_key"] == first["canonical"], "left").drop("canonical")
    readable = F.col("_entry.readable")
    return joined.withColumns({
        "allowlisted": F.coalesce(readable, F.lit(False)),
        "allow_reason": F.when(readable, F.concat(F.lit("allowlist_hit:"), F.col("value")))
        .when(~readable, F.concat(F.lit("allowlist_unparsable_expiry:"), F.col("value")))}).drop("_entry")


def infrastructure_evidence(addresses: DataFrame, classes: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Shared or dedicated evidence from a versioned class registry; the longest prefix speaks."""
    kinds = F.create_map(*[F.lit(x) for pair in {
        "cdn": "shared_cdn", "hyperscaler": "shared_cloud", "hosting": "shared_hosting", "vpn": "anonymizer", "dedicated": "dedicated_use_provenance",
    }.items() for x in pair])
    # A prefix may be listed many times: only its greatest entry can speak, so an address meets one row a length.
    low, _, length = ipv4_cidr_bounds(F.col("prefix"))
    entries = classes.groupBy(low.alias("_low"), length.alias("_bits")).agg(F.max(F.struct("infra_class", "prefix", "version")).alias("_entry")) \
        .where("_low is not null").select("_bits", "_entry.*")
    hits = prefix_matches(addresses, entries, lengths)
    keys = [c for c in addresses.columns]
    best = hits.groupBy(*keys).agg(F.max(F.struct("_bits", "infra_class", "prefix", "version")).alias("b"))
    return best.select(*keys, "b.infra_class", "b.prefix", "b.version", F.try_element_at(kinds, F.col("b.infra_class")).alias("kind"))


# --- coverage, allow-first ---------------------------------------------------------

def coverage_ledger(flows: DataFrame, queries: DataFrame, window_s: int, floor_micros: int) -> DataFrame:
    """Per segment: share of egress flows preceded by a DNS query of the same host within ``window_s``.

    A flow looks at two time cells of its host, each reduced to its first and
    last query; no flow meets individual queries.
    """
    cells = queries.groupBy("host", scan.chunk_of("epoch_s", window_s).alias("cell")).agg(F.min("epoch_s").alias("lo"), F.max("epoch_s").alias("hi"))
    own = cells.select("host", "cell", F.col("lo").alias("own_lo"))
    before = cells.select("host", (F.col("cell") + 1).alias("cell"), F.col("hi").alias("before_hi"))
    seen = flows.withColumn("cell", scan.chunk_of("epoch_s", window_s)).join(own, ["host", "cell"], "left").join(before, ["host", "cell"], "left")
    covered = F.coalesce(F.col("own_lo") <= F.col("epoch_s"), F.lit(False)) | F.coalesce(F.col("before_hi") >= F.col("epoch_s") - window_s, F.lit(False))
    return seen.groupBy("segment").agg(F.count("*").alias("sessions"), F.count_if(covered).alias("dns_bearing")) \
        .withColumn("coverage_micros", _ratio_micros("dns_bearing", "sessions")).withColumn("below_floor", F.col("coverage_micros") < floor_micros)


def allowlist_simulation(flows: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Destinations a candidate allowlist would have denied, with flows, hosts and bytes."""
    return flows.join(allowed.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(
        F.count("*").alias("flows"), F.count_distinct("host").alias("hosts"), F.sum("out_bytes").alias("denied_bytes"))


def traffic_profiles(flows: DataFrame, period_s: int = 3600) -> DataFrame:
    """Per destination: volume band per period, active periods and peers. A destination has at most one row per period to rank."""
    per = flows.groupBy("dst", scan.chunk_of("epoch_s", period_s).alias("period")).agg(F.sum("out_bytes").alias("bytes"))
    band = per.groupBy("dst").agg(
        F.count("*").alias("periods"), F.expr("percentile_disc(0.05) within group (order by bytes)").cast("long").alias("low_bytes"),
        F.expr("percentile_disc(0.95) within group (order by bytes)").cast("long").alias("high_bytes"))
    return band.join(flows.groupBy("dst").agg(F.count_distinct("host").alias("peers")), "dst")


def profile_drift(flows: DataFrame, profiles: DataFrame, period_s: int = 3600) -> DataFrame:
    """Periods of a destination outside its profile's band."""
    per = flows.groupBy("dst", scan.chunk_of("epoch_s", period_s).alias("period")).agg(F.sum("out_bytes").alias("bytes"))
    drift = F.when(F.col("bytes") > F.col("high_bytes"), "above").when(F.col("bytes") < F.col("low_bytes"), "below")
    return per.join(profiles.select("dst", "low_bytes", "high_bytes"), "dst").withColumn("drift", drift).where("drift is not null") \
        .select("dst", "period", "bytes", "drift")


# --- behaviour across the population ------------------------------------------------

def host_clusters(detections: DataFrame, min_families: int = 2) -> DataFrame:
    """Hosts with detections of at least ``min_families`` distinct families."""
    return detections.groupBy("src").agg(
        F.count_distinct("kind").alias("families"), F.count("*").alias("detections"), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds")) \
        .where(F.col("families") >= min_families)


def temporal_concurrence(sightings: DataFrame, window_s: int, min_sources: int = 2) -> DataFrame:
    """Per indicator: the most distinct sources seen within any ``window_s``, and when first reached."""
    points = sightings.select("indicator_id", "identity", "epoch_s").distinct()
    edges = scan.presence_edges(points, ["indicator_id"], "identity", "epoch_s", window_s)
    so_far = W.partitionBy("indicator_id").orderBy("epoch_s").rowsBetween(*scan.UP_TO)
    present = edges.withColumn("sources", F.sum("step").over(so_far))
    return present.groupBy("indicator_id").agg(F.max(F.struct("sources", (-F.col("epoch_s")).alias("at"))).alias("m")) \
        .select("indicator_id", F.col("m.sources").alias("sources"), (-F.col("m.at")).alias("reached_s")).where(F.col("sources") >= min_sources)


def local_prevalence(contacts: DataFrame) -> DataFrame:
    """Per (tenant, destination): distinct clients, contacts, first and last sighting."""
    return contacts.groupBy("tenant_id", "dst").agg(
        F.count_distinct("src").alias("clients"), F.count("*").alias("contacts"), F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s"))


def certificate_clusters(certificates: DataFrame, min_names: int = 2) -> DataFrame:
    """Exact certificate fingerprints served for several names or addresses."""
    return certificates.groupBy("fingerprint").agg(
        F.count_distinct("name").alias("names"), F.count_distinct("address").alias("addresses"), F.min("not_before").alias("not_before")) \
        .where(F.col("names") >= min_names)


def nxdomain_bursts(queries: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", min_queries: int = 20, min_share_micros: int = 500_000) -> DataFrame:
    """Client windows rich in names that do not resolve."""
    counted = queries.groupBy("src", F.window(F.timestamp_seconds("epoch_s"), window, slide).alias("w")).agg(
        F.count("*").alias("queries"), F.count_if("nxdomain").alias("nx"))
    return counted.withColumn("nx_micros", _ratio_micros("nx", "queries")) \
        .where((F.col("queries") >= min_queries) & (F.col("nx_micros") >= min_share_micros)) \
        .select("src", F.unix_seconds("w.start").alias("start_s"), "queries", "nx", "nx_micros")


def young_domains(contacts: DataFrame, registrations: DataFrame, max_age_days: int) -> DataFrame:
    """Contacts of names registered at most ``max_age_days`` before: friction candidates, never denied on age."""
    age = F.when(F.col("epoch_s") >= F.col("registered_s"), F.expr("(epoch_s - registered_s) div 86400"))
    return contacts.join(registrations, "dst").withColumn("age_days", age).where(F.col("age_days").between(0, max_age_days)) \
        .groupBy("dst", "age_days").agg(F.count("*").alias("contacts"), F.count_distinct("src").alias("clients"))


def blast_radius(indicators: DataFrame, contacts: DataFrame, flows: DataFrame) -> DataFrame:
    """Expected reach of acting on an indicator: clients, tenants, contacts and bytes on its target."""
    who = contacts.groupBy(F.col("dst").alias("value")).agg(
        F.count_distinct("src").alias("clients"), F.count_distinct("tenant_id").alias("tenants"), F.count("*").alias("contacts"))
    volume = flows.groupBy(F.col("dst").alias("value")).agg(F.sum("out_bytes").alias("bytes"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return indicators.select("indicator_id", "value").join(who, "value", "left").join(volume, "value", "left") \
        .select("indicator_id", "value", *[zero(n) for n in ("clients", "tenants", "contacts", "bytes")])


# --- outcomes ---------------------------------------------------------------------------

def outcome_feedback(actions: DataFrame, contacts: DataFrame, reports: DataFrame, now_s: int, chunk: int = 3600) -> DataFrame:
    """Per action: contacts of its target while it was live, whether it expired, false-positive reports.

    ``actions``: action_id, target, start_s, end_s.
    """
    events = contacts.select(F.col("dst").alias("target"), "epoch_s", F.lit(1).alias("one"))
    intervals = actions.withColumn("interval_id", F.col("action_id"))
    counted = scan.counts_within(events, intervals, "target", "epoch_s", "start_s", "end_s", {"matches": "one"}, chunk)
    told = reports.groupBy("action_id").agg(F.count("*").alias("false_positive_reports"))
    return counted.join(told, "action_id", "left").select(
        "action_id", "target", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce(F.col("end_s") <= now_s, F.lit(False)).alias("expired"),
        F.coalesce("false_positive_reports", F.lit(0)).alias("false_positive_reports"))


def shadow_matches(decisions: DataFrame, queries: DataFrame, legitimate: DataFrame, chunk: int = 3600) -> DataFrame:
    """Per shadow decision: queries it would have matched, and whether the name is known as legitimate.

    ``decisions``: decision_id, target, start_s, end_s.
    """
    events = queries.select(F.col("dst").alias("target"), "epoch_s", F.lit(1).alias("one"))
    counted = scan.counts_within(events, decisions.withColumn("interval_id", F.col("decision_id")), "target", "epoch_s", "start_s", "end_s", {"would_match": "one"}, chunk)
    known = legitimate.select("target").distinct().withColumn("legitimate", F.lit(True))
    return counted.join(known, "target", "left").select(
        "decision_id", "target", F.coalesce("would_match", F.lit(0)).alias("would_match"), F.coalesce("legitimate", F.lit(False)).alias("legitimate"))


def exposure_drift(listeners: DataFrame, inventory: DataFrame) -> DataFrame:
    """Observed (host, port) listeners the inventory does not know."""
    return listeners.join(inventory.select("host", "port").distinct(), ["host", "port"], "left_anti").groupBy("host", "port") \
        .agg(F.count("*").alias("sightings"), F.min("epoch_s").alias("first_s"))


def virtual_patch_coverage(assets: DataFrame, advisories: DataFrame, patches: DataFrame, tile: int = 4096) -> DataFrame:
    """Exposed (asset, advisory) pairs and whether a patch rule covers them, plus rules without an exposure.

    ``assets``: asset_id, product. ``advisories``: advisory_id, product.
    ``patches``: asset_id, advisory_id. Pairs are many more than assets, advisories and rules, so no pair is shuffled: rules
    look their products up, and a product's assets meet its advisories in tiles, each asset with the advisories of the tile that
    its rules cover. A pair with several common products is made at the least one.
    """
    owned = assets.where("product is not null").groupBy("asset_id").agg(F.array_sort(F.collect_set("product")).alias("_has"))
    named = advisories.where("product is not null").groupBy("advisory_id").agg(F.array_sort(F.collect_set("product")).alias("_of"))
    least = F.array_min(F.array_intersect("_has", "_of"))
    ruled = patches.select("asset_id", "advisory_id").distinct().join(owned, "asset_id", "left").join(named, "advisory_id", "left") \
        .select("asset_id", "advisory_id", least.alias("product"))
    rules = ruled.select("asset_id", "advisory_id", F.when(F.col("product").isNull(), "orphaned").otherwise("covered").alias("status"))

    listed = named.select("advisory_id", "_of", F.explode("_of").alias("product"))
    tiles = listed.groupBy("product").agg(F.ceil(F.count("*") / tile).alias("_tiles"))
    tile_of = F.pmod(F.xxhash64("advisory_id"), F.col("_tiles")).alias("_tile")
    covered = ruled.where("product is not null").join(tiles, "product").groupBy("asset_id", "product", tile_of).agg(F.collect_list("advisory_id").alias("_covered"))
    holders = owned.select("asset_id", "_has", F.explode("_has").alias("product")).join(tiles, "product") \
        .select("asset_id", "_has", "product", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_tile")) \
        .join(covered, ["asset_id", "product", "_tile"], "left")
    pairs = holders.join(listed.join(tiles, "product").select("advisory_id", "_of", "product", tile_of), ["product", "_tile"]) \
        .where((F.size("_has") == 1) | (F.size("_of") == 1) | (least == F.col("product"))) \
        .where(~F.coalesce(F.array_contains("_covered", F.col("advisory_id")), F.lit(False)))
    return pairs.select("asset_id", "advisory_id", F.lit("uncovered").alias("status")).union(rules)


def source_health(records: DataFrame, now_s: int, period_s: int = 86_400, factor: int = 3) -> DataFrame:
    """Per (source, period): volume, failures, change against the previous period. ``sudden`` marks a jump or drop by ``factor``."""
    per = records.groupBy("source_id", scan.chunk_of("epoch_s", period_s).alias("period")).agg(
        F.count("*").alias("volume"), F.count_if("failed").alias("failures"), F.max("epoch_s").alias("last_s"))
    before = F.lag("volume").over(W.partitionBy("source_id").orderBy("period"))
    return per.withColumn("previous", before).withColumn("age_s", F.lit(now_s) - F.col("last_s")).withColumn(
        "sudden", F.coalesce((F.col("volume") >= F.col("previous") * factor) | (F.col("volume") * factor <= F.col("previous")), F.lit(False))) \
        .select("source_id", "period", "volume", "failures", "age_s", "previous", "sudden")


def service_measures(actions: DataFrame, now: Column) -> DataFrame:
    """Ledger measures: actions, unverified and stale rates, dispatch latency.

    ``actions``: state, created_at, verified_at, expires_at, decided_at.
    """
    live = F.col("state").isin("applied", "verified", "drifted")
    unverified = live & F.col("verified_at").isNull()
    stale = live & (F.col("expires_at") < now)
    latency = F.unix_seconds("created_at") - F.unix_seconds("decided_at")
    return actions.agg(
        F.count("*").alias("actions"), F.count_if(live).alias("live"), F.count_if(unverified).alias("unverified"), F.count_if(stale).alias("stale"),
        F.sum(latency).alias("latency_sum_s"), F.max(latency).alias("latency_max_s")) \
        .withColumn("unverified_micros", _ratio_micros("unverified", "live")).withColumn("stale_micros", _ratio_micros("stale", "live"))


def resting_on(indicators: DataFrame, evidence: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Indicators with any evidence of the source, and all evidence about those. An indicator is decided from its own evidence alone, so
    what a source changes is decided on these. The evidence is written once, since several decisions read it."""
    touched = cut_lineage(evidence.where(F.col("source_id") == source_id).select("indicator_id").distinct())
    own, about = (df.join(touched, "indicator_id", "left_semi").select(*df.columns) for df in (indicators, evidence))
    return own, cut_lineage(about)


def decisions_resting_on(decisions: DataFrame, evidence: DataFrame, source_id: str) -> DataFrame:
    """Decisions whose indicator holds evidence of ``source_id``."""
    touched = evidence.where(F.col("source_id") == source_id).select("indicator_id").distinct()
    return decisions.join(touched, "indicator_id", "left_semi")
