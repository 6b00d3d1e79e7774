"""Indicator payloads: one JSON document per row to indicators and evidence.

A payload with any violation fails as a whole; violations are data, so one bad
payload never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.digest import sha_hex
from threatloom.functions.instants import is_iso_utc
from threatloom.functions.net import canonical_cidr, canonical_ip, is_ipv4, is_ipv6
from threatloom.functions.text import canonical_fqdn, canonical_url, valid_id, valid_label
from threatloom.operators.evidence import UNREGISTERED, batch_id, resolve_source, strip_claims
from threatloom.session import cut_lineage

# Structural limits of one payload.
MAX_INDICATORS = 100_000
MAX_EVIDENCE = 1_024
MAX_SOURCES = 64
MAX_TAGS = 64
MAX_BYTES = 512 * 1024 * 1024
TYPES = ("fqdn", "ipv4", "ipv6", "cidr", "url")

ITEM_SCHEMA = """struct<id:string, type:string, value:string, last_seen:string, sources:array<string>, tags:array<string>,
                         evidence:array<map<string,string>>>"""
PAYLOAD_SCHEMA = f"struct<indicators:array<{ITEM_SCHEMA}>>"


def canonical_value(itype: Column, value: Column) -> Column:
    """Canonical value for a type, null when it cannot be represented."""
    address = canonical_ip(F.when(itype.isin("ipv4", "ipv6"), value))
    return (
        F.when(itype == "fqdn", canonical_fqdn(value, idna=True))
        .when((itype == "ipv4") & is_ipv4(F.trim(value)), F.trim(value))
        .when((itype == "ipv6") & is_ipv6(F.trim(value)), address)
        .when(itype == "cidr", canonical_cidr(F.when(itype == "cidr", value)))
        .when(itype == "url", canonical_url(value)))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """One row per payload item with canonical fields and ``violations``.

    ``payloads``: body, channel, allowed_sources array, allowed_kinds array. A
    structurally unreadable payload yields one row with a null position.
    """
    rows = payloads.withColumn("raw_sha256", sha_hex(F.col("body"))) \
        .withColumn("batch_id", batch_id(F.col("channel"), F.col("raw_sha256"))) \
        .withColumn("_items", F.from_json("body", PAYLOAD_SCHEMA)["indicators"])
    whole = F.array_compact(F.array(
        F.when(F.octet_length("body") > MAX_BYTES, F.lit("payload too large")),
        F.when(F.col("_items").isNull(), F.lit("payload must be an object with an 'indicators' array")),
        F.when(F.size("_items") > MAX_INDICATORS, F.lit(f"payload exceeds {MAX_INDICATORS} indicators"))))
    rows = rows.withColumn("_whole", whole).select(
        "batch_id", "channel", "raw_sha256", "allowed_sources", "allowed_kinds", "_whole", F.posexplode_outer("_items").alias("pos", "item"))
    item = F.col("item")
    tags = F.array_sort(F.array_distinct(F.coalesce(item["tags"], F.array().cast("array<string>"))))
    rows = rows.withColumns({"value": canonical_value(item["type"], item["value"]), "tags": tags, "pos": F.col("pos").cast("long")})
    evidence = F.coalesce(item["evidence"], F.array().cast("array<map<string,string>>"))
    last_seen = F.coalesce(item["last_seen"], F.lit(""))
    observed = lambda e: F.coalesce(e["observed_at"], last_seen)
    checks = F.array_compact(F.array(
        F.when(~valid_id(item["id"]), F.lit("unsafe indicator id")),
        F.when(~F.coalesce(item["type"].isin(*TYPES), F.lit(False)), F.lit("unsupported type")),
        F.when(F.col("value").isNull(), F.lit("invalid value")),
        F.when(F.size(item["sources"]) > MAX_SOURCES, F.lit("too many sources")),
        F.when(F.exists(item["sources"], lambda s: ~valid_id(s)), F.lit("unsafe source id")),
        F.when(F.size("tags") > MAX_TAGS, F.lit("too many tags")),
        F.when(F.exists("tags", lambda t: ~valid_label(t)), F.lit("unsafe tag")),
        F.when(F.size(evidence) > MAX_EVIDENCE, F.lit("too many evidence records")),
        F.when(F.exists(evidence, lambda e: ~valid_label(F.coalesce(e["kind"], F.lit("evidence")))), F.lit("unsafe evidence kind")),
        F.when(F.exists(evidence, lambda e: ~valid_id(F.coalesce(e["source_id"], F.lit("x")))), F.lit("unsafe evidence source_id")),
        F.when(F.exists(evidence, lambda e: (observed(e) != "") & ~is_iso_utc(observed(e))), F.lit("evidence observed_at must be ISO-8601 UTC"))))
    return rows.withColumn("violations", F.when(F.col("pos").isNull(), F.col("_whole")).otherwise(F.concat(F.col("_whole"), checks))) \
        .withColumn("_evidence", evidence).withColumn("_last_seen", last_seen).drop("_whole")


def payload_batches(parsed: DataFrame) -> DataFrame:
    """One row per payload: size, violations found, and whether it is accepted."""
    return parsed.groupBy("batch_id", "channel", "raw_sha256").agg(
        F.count("pos").alias("indicators"), F.sum(F.size("violations")).alias("violations")) \
        .withColumn("accepted", F.col("violations") == 0)


def accepted_items(parsed: DataFrame) -> DataFrame:
    """Items of payloads without any violation.

    The parsed rows are written once: both the failures and the items are read from them, and no filter repeats the checks.
    """
    parsed = cut_lineage(parsed)
    failed = parsed.where(F.size("violations") > 0).select("batch_id").distinct()
    return parsed.where("pos is not null").join(failed, "batch_id", "left_anti")


def payload_indicators(items: DataFrame) -> DataFrame:
    return items.select("batch_id", "channel", "pos", F.col("item.id").alias("source_object_id"), F.col("item.type").alias("itype"), "value", "tags")


def payload_evidence(items: DataFrame) -> DataFrame:
    """Evidence bound to its channel; ``demoted`` marks records that lost their asserted source."""
    rows = items.select("batch_id", "channel", "allowed_sources", "allowed_kinds", "pos", "_last_seen",
                        F.col("item.id").alias("source_object_id"), F.posexplode("_evidence").alias("evidence_pos", "e"))
    asserted = F.coalesce(F.col("e")["source_id"], F.col("channel"))
    kind = F.coalesce(F.col("e")["kind"], F.lit("evidence"))
    source = resolve_source(asserted, kind, F.col("channel"), F.col("allowed_sources"), F.col("allowed_kinds"))
    return rows.select(
        "batch_id", "pos", F.col("evidence_pos").cast("long").alias("evidence_pos"), "source_object_id", kind.alias("kind"), source.alias("source_id"), asserted.alias("asserted_source"),
        F.col("channel").alias("channel_source"), F.coalesce(F.col("e")["observed_at"], F.col("_last_seen")).alias("observed_at"),
        strip_claims(F.col("e")).alias("detail"), ((source == UNREGISTERED) & ~asserted.isin("", UNREGISTERED)).alias("demoted"))
