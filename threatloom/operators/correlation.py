"""Requester correlation: features, latest state, fingerprints, links.

Observation only: nothing here feeds a decision.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.digest import handle_for, sha_hex
from threatloom.functions.instants import parse_instant
from threatloom.sources.transactions import ENUM_FIELDS

# Feature names, in fingerprint order.
FEATURES = ("P1:header_order", "P1:header_set", "P2:coherence", "P3:ja4", "P4:cache_behavior", "P5:key_order", "P6:range_fallback")
FINGERPRINT_VERSION = "fp1"


def _listed(items: Column) -> Column:
    """Bracketed, quoted list text, the form the coherence digest is taken over."""
    quoted = F.transform(items, lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"')))
                         .otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def features() -> Column:
    """Feature map of a transaction's contract columns; absent features are left out."""
    c = F.col
    headers, body = c("header_order"), c("challenge_body_key_order")
    langs = F.array_sort(F.transform(_parts(c("accept_language")), lambda x: F.substring_index(x, ";", 1)))
    codings = F.array_sort(_parts(c("accept_encoding")))
    coherent = (c("accept_language") != "") & (c("accept_encoding") != "")
    values = (
        F.when(F.size(headers) > 0, F.array_join(headers, ",")),
        F.when(F.size(headers) > 0, sha_hex(F.array_join(F.array_sort(headers), ","), 12)),
        F.when(coherent, sha_hex(F.concat(_listed(langs), F.lit("|"), _listed(codings)), 12)),
        F.when(c("tls_ja4") != "", c("tls_ja4")),
        F.when(c("cache_behavior").isin(*ENUM_FIELDS["cache_behavior"]), c("cache_behavior")),
        F.when(F.size(body) > 0, F.array_join(body, ",")),
        F.when(c("range_fallback").isin(*ENUM_FIELDS["range_fallback"]), c("range_fallback")),
    )
    return F.map_filter(F.create_map(*[x for f, v in zip(FEATURES, values) for x in (F.lit(f), v)]), lambda k, v: v.isNotNull())


def fingerprint(feature_map: Column) -> Column:
    entries = F.array_sort(F.map_entries(feature_map))
    canonical = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return F.concat(F.lit(f"fp--{FINGERPRINT_VERSION}--"), sha_hex(canonical, 16))


def similarity(a: Column, b: Column) -> Column:
    """Features both maps have, equal or not."""
    return F.size(F.array_intersect(F.map_keys(a), F.map_keys(b)))


def requester_states(transactions: DataFrame, key: bytes | None) -> DataFrame:
    """Newest value per (handle, feature), transaction count and last sighting.

    ``key`` pseudonymises ``client_ref``; None means it already is a handle.
    Equal instants are settled by the greater value, so input order never matters.
    """
    handle = handle_for(F.col("client_ref"), key) if key is not None else F.col("client_ref")
    seen = transactions.select(
        handle.alias("handle"), "observed_at", F.unix_micros(parse_instant(F.col("observed_at"))).alias("at"), features().alias("features")) \
        .where(F.size("features") > 0)
    newest = (
        seen.select("handle", "at", F.explode("features").alias("feature", "value"))
        .groupBy("handle", "feature").agg(F.max(F.struct("at", "value")).alias("best"))
        .groupBy("handle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.col("best.value"))))).alias("features")))
    totals = seen.groupBy("handle").agg(F.count("*").alias("transactions"), F.max(F.struct("at", "observed_at")).alias("last"))
    return newest.join(totals, "handle").select(
        "handle", "features", "transactions", F.col("last.observed_at").alias("last_seen"), fingerprint(F.col("features")).alias("fingerprint"))


def pruned_states(states: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """States seen within ``ttl_s`` of ``now`` on either side; unreadable sightings expire."""
    away = F.abs(F.unix_micros(parse_instant(F.col("last_seen"))) - F.unix_micros(now))
    return states.where(away <= ttl_s * 1_000_000)


def fingerprint_groups(states: DataFrame) -> DataFrame:
    """Requesters and features per fingerprint. Members stay rows of ``states``: a group may be any size."""
    return states.groupBy("fingerprint").agg(
        F.count("*").alias("requesters"), F.max(F.size("features")).alias("probe_count"))


def fingerprint_links(states: DataFrame, min_similarity: int = 3, tile: int = 2000) -> DataFrame:
    """Pairs of fingerprints with ``min_similarity`` equal features, or one contained in the other.

    Fingerprints meet on a whole subset of equal features, so every pair that
    meets is a link and nothing else is ever emitted. A pair sharing more is
    reported only by its first shared subset. Subsets held by many fingerprints
    are cut into tiles of at most ``tile`` members a side.
    """
    prints = states.groupBy("fingerprint").agg(F.any_value("features").alias("features"))
    prints = prints.withColumn("size", F.size("features")).withColumn("keys", F.array_sort(F.map_keys("features")))

    def members(size: int) -> DataFrame:
        """(subset of ``size`` features with values, fingerprint) rows."""
        choices = [F.array(*[F.lit(f) for f in combo]) for combo in combinations(sorted(FEATURES), size)]
        held = F.filter(F.array(*choices), lambda combo: F.forall(combo, lambda f: F.array_contains(F.col("keys"), f)))
        return prints.where(F.col("size") >= size).withColumn("subset_keys", F.explode(held)) \
            .withColumn("subset", sha_hex(F.to_json(F.transform("subset_keys", lambda f: F.struct(f, F.col("features")[f])))))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left and right rows of one subset, tiled."""
        tiles = right.groupBy("subset").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
        slot = lambda n: F.pmod(F.xxhash64("fingerprint"), F.col(n)).cast("int")
        wide = left.groupBy("subset").agg(F.ceil(F.count("*") / tile).cast("int").alias("_lt")).join(tiles.withColumnRenamed("tiles", "_rt"), "subset")
        l = left.join(wide, "subset").withColumn("_i", slot("_lt")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_rt") - 1))) \
            .select("subset", "subset_keys", "_i", "_j", F.col("fingerprint").alias("a"), F.col("features").alias("fa"), F.col("size").alias("na"))
        r = right.join(wide, "subset").withColumn("_j", slot("_rt")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_lt") - 1))) \
            .select("subset", "_i", "_j", F.col("fingerprint").alias("b"), F.col("features").alias("fb"), F.col("size").alias("nb"))
        return l.join(r, ["subset", "_i", "_j"])

    equal = F.array_sort(F.filter(F.map_keys("fa"), lambda k: F.col("fa")[k] == F.col("fb")[k]))
    similar = members(min_similarity)
    links = pairs(similar, similar).where("a < b").withColumn("equal", equal) \
        .where(F.slice("equal", 1, min_similarity) == F.col("subset_keys")).select("a", "b", F.size("equal").cast("long").alias("shared_probes"))
    for size in range(2, min_similarity):
        subsets = members(size)
        small = subsets.where(F.col("size") == size)
        # The smaller side is whole; its partner is larger, or as large (then the sets are equal and the prints are one).
        found = pairs(small, subsets.where(F.col("size") > size)).withColumn("equal", equal).where(F.size("equal") == size)
        links = links.unionByName(found.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(size).cast("long").alias("shared_probes")))
    return links


def correlation_report(states: DataFrame, min_similarity: int = 3) -> DataFrame:
    """The analyst's worklist as rows, ready for ``write.json``: totals, groups, members and links.

    Long rows instead of one document: a group or the link list may be any size.
    """
    text, number = lambda c: c.cast("string"), lambda c: c.cast("long")

    def rows(df: DataFrame, section: str, a: Column, b: Column, n: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), text(a).alias("a"), text(b).alias("b"), number(n).alias("n"))

    none = F.lit(None)
    total = states.agg(F.count("*").alias("n"))
    links = fingerprint_links(states, min_similarity)
    return rows(total, "tracked_requesters", none, none, F.col("n")) \
        .unionByName(rows(fingerprint_groups(states), "fingerprint_group", F.col("fingerprint"), none, F.col("probe_count"))) \
        .unionByName(rows(states, "member", F.col("fingerprint"), F.col("handle"), F.col("transactions"))) \
        .unionByName(rows(links, "link", F.col("a"), F.col("b"), F.col("shared_probes")))
