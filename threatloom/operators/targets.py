"""Targets of indicators in the forms that lists are compared in, and index joins against lists of any size.

Forms are worked out once per distinct value, column by column, so that no expression is repeated inside another and the rows of a large
table meet them in one equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.instants import parse_instant
from threatloom.functions.net import ipv4_text, ipv6_text, with_address_range
from threatloom.functions.text import idna_name, name_suffixes, strip_dots
from threatloom.session import cut_lineage

_ASCII = r"\A[\x00-\x7f]*\z"


def prefix_bits(text: Column, span: Column) -> Column:
    """Prefix length of an address (its full length) or prefix whose range is ``span``."""
    return F.when(span.isNotNull() & text.contains("/"), F.substring_index(text, "/", -1).try_cast("int")).when(span["family"] == 4, 32).when(span["family"] == 6, 128)


def _address_text(span: Column) -> Column:
    return F.when(span["family"] == 4, ipv4_text(F.conv(span["lo"], 16, 10).cast("long"))).when(span["family"] == 6, ipv6_text(span["lo"]))


def targets(values: DataFrame) -> DataFrame:
    """(value, _span, _bits, _name, _key) of each distinct ``value``.

    ``_span``: address range and ``_bits``: its prefix length; null for others. ``_name``: name in lower case without final dots.
    ``_key``: addresses and prefixes in canonical form (a prefix of one address as that address, an IPv6 zone kept), names in IDNA
    form in lower case, or as they are where IDNA refuses them. Only names beyond ASCII go through Python.
    """
    found = values.select("value").where("value is not null").distinct() \
        .withColumns({"_text": strip_dots(F.trim("value")), "_name": F.lower(strip_dots(F.col("value")))})
    zone = F.when(F.col("_text").contains(":"), F.regexp_extract("_text", r"%[^%/]+\z", 0)).otherwise("")
    found = found.withColumn("_zone", zone).withColumn("_bare", F.when(F.col("_zone") != "", F.substring_index("_text", "%", 1)).otherwise(F.col("_text")))
    found = with_address_range(found, "_bare", "_range").withColumn("_bits", prefix_bits(F.col("_bare"), F.col("_range"))) \
        .withColumn("_first", _address_text(F.col("_range")))
    whole = F.when(F.col("_range.family") == 4, 32).otherwise(128)
    address = F.when(F.col("_bits") == whole, F.concat("_first", "_zone")).otherwise(F.concat("_first", F.lit("/"), "_bits"))
    found = found.withColumns({"_address": address, "_span": F.when(F.col("value") == F.col("_bare"), F.col("_range"))})
    plain = found.where(F.col("_text").rlike(_ASCII)).withColumn("_encoded", F.lower("_text"))
    other = found.where(~F.col("_text").rlike(_ASCII)).withColumn("_encoded", F.coalesce(F.lower(idna_name(F.lower("_text"))), F.lower("_text")))
    return plain.unionByName(other).select("value", "_span", "_bits", "_name", F.coalesce("_address", "_encoded").alias("_key"))


def _network_key(digits: Column, bits: Column) -> Column:
    """The leading ``bits`` of hex digits, as text."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.element_at(F.array(*map(F.lit, (1, 8, 4, 2))), rest + 1)
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(nibble - nibble % step))).otherwise(""))


def covering_prefixes(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``found`` (with _span and _bits) and ``prefixes`` (with ``prefix`` and further columns, at any lengths of both families), one
    row for every prefix that holds the whole range; ``bits`` is the prefix's length.

    A target asks once for each length that occurs in the list (162 at most), so the join is on equal keys. ``found`` should be
    a written table, as ``_span`` is filtered on.
    """
    nets = with_address_range(prefixes, "prefix", "_net").withColumn("bits", prefix_bits(F.col("prefix"), F.col("_net"))) \
        .withColumns({"_family": F.col("_net.family"), "_network": _network_key(F.col("_net.lo"), F.col("bits"))}).drop("_net")
    # The index is written once, its lengths and keys are read from there, and no filter repeats the address expressions.
    nets = cut_lineage(nets).where("_family is not null")
    # At most 162 numbers in two rows.
    lengths = nets.groupBy("_family").agg(F.collect_set("bits").alias("_lengths"))
    asked = found.where("_span is not null").withColumn("_family", F.col("_span.family")).join(F.broadcast(lengths), "_family") \
        .withColumn("bits", F.explode(F.filter("_lengths", lambda n: n <= F.col("_bits")))).drop("_lengths") \
        .withColumn("_network", _network_key(F.col("_span.lo"), F.col("bits")))
    return asked.join(nets, ["_family", "bits", "_network"]).drop("_family", "_network")


def covering_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """``found`` (with _name) and ``names`` (with ``domain`` and further columns): a row for every listed name at or above the target."""
    listed = names.withColumn("_suffix", F.lower(strip_dots(F.col("domain")))).where("_suffix <> ''")
    return found.withColumn("_suffix", F.explode(name_suffixes(F.col("_name")))).join(listed, "_suffix").drop("_suffix")


@dataclass(frozen=True)
class GovernedLists:
    """Lists of a policy as tables, of any size; one that is absent authorises, protects or vouches for nothing.

    ``domains`` (owner, domain) and ``prefixes`` (owner, prefix): authorised scope, owner '*' for all tenants. An owner that is a
    tenant narrows its scope: entries inside the global list count, and if there are any they replace the global ones of that kind.
    ``allowlist`` (pos, canonical, scope, expires_at), ``dedicated_use`` (value), ``verified_rollback`` (value).
    """

    domains: DataFrame | None = None
    prefixes: DataFrame | None = None
    allowlist: DataFrame | None = None
    dedicated_use: DataFrame | None = None
    verified_rollback: DataFrame | None = None


def narrowed(entries: DataFrame, by: str) -> DataFrame:
    """Scope entries that count: the global ones, and those of a tenant that lie inside a global one (all, if no global one exists)."""
    every = entries.select(F.coalesce("owner", F.lit("*")).alias("owner"), by).distinct()
    world, own = every.where("owner = '*'"), every.where("owner <> '*'")
    if by == "domain":
        found = own.select("owner", F.col(by).alias("_own"), F.lower(strip_dots(F.col(by))).alias("_name"))
        inside = covering_names(found, world.select("domain")).select("owner", F.col("_own").alias(by))
    else:
        found = cut_lineage(with_address_range(own.select("owner", F.col(by).alias("_own")), "_own", "_span").withColumn("_bits", prefix_bits(F.col("_own"), F.col("_span"))))
        inside = covering_prefixes(found, world.select("prefix")).select("owner", F.col("_own").alias(by))
    anything = world.limit(1).select(F.lit(True).alias("_any"), F.lit(1).alias("_one"))
    alone = own.withColumn("_one", F.lit(1)).join(anything, "_one", "left_anti").select("owner", by)
    return world.unionByName(inside.distinct()).unionByName(alone).distinct()


def _in_scope(rows: DataFrame, matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys (indicator_id) whose owner's entries cover them. ``matches``: (value, owner)."""
    owners = entries.select(F.col("owner").alias("_owner")).where("_owner <> '*'").distinct()
    owned = rows.join(owners, F.col("tenant_id") == F.col("_owner"), "left").select("indicator_id", "value", F.coalesce("_owner", F.lit("*")).alias("owner"))
    return owned.join(matches.distinct(), ["value", "owner"], "left_semi").select("indicator_id")


def governed_marks(indicators: DataFrame, found: DataFrame, lists: GovernedLists, scope: str, now: Column) -> DataFrame:
    """(indicator_id, _by_address, _by_name, _listed, _dedicated, _rollback) for each indicator, from its targets and the lists."""
    rows = indicators.select("indicator_id", "value", (F.col("tenant_id") if "tenant_id" in indicators.columns else F.lit(None).cast("string")).alias("tenant_id"))
    keyed = rows.join(found.select("value", "_key"), "value", "left").select("indicator_id", "value", "_key")
    marks: list[tuple[str, DataFrame | None]] = []
    for name, entries, by in (("_by_address", lists.prefixes, "prefix"), ("_by_name", lists.domains, "domain")):
        if entries is None:
            marks.append((name, None))
            continue
        counted = cut_lineage(narrowed(entries, by))
        cover = covering_prefixes if by == "prefix" else covering_names
        marks.append((name, _in_scope(rows, cover(found, counted).select("value", "owner"), counted)))
    marks.append(("_listed", None if lists.allowlist is None else allowlisted_keys(keyed, lists.allowlist, scope, now)))
    for name, table in (("_dedicated", lists.dedicated_use), ("_rollback", lists.verified_rollback)):
        marks.append((name, None if table is None else rows.join(table.select("value").distinct(), "value", "left_semi").select("indicator_id")))
    hits = [ids.select("indicator_id", F.lit(name).alias("mark")) for name, ids in marks if ids is not None]
    out = rows.select("indicator_id")
    if hits:
        both = hits[0]
        for more in hits[1:]:
            both = both.unionByName(more)
        # Few rows behind long plans: written, so that the score's plan starts from them.
        both = cut_lineage(both)
        flags = both.groupBy("indicator_id").agg(*[F.max(F.col("mark") == name).alias(name) for name, ids in marks if ids is not None])
        out = out.join(flags, "indicator_id", "left")
    return out.select("indicator_id", *[(F.coalesce(name, F.lit(False)) if ids is not None else F.lit(False)).alias(name) for name, ids in marks])


def allowlisted_keys(keyed: DataFrame, entries: DataFrame, scope: str, now: Column) -> DataFrame:
    """(indicator_id) protected by the first unexpired entry, by ``pos``, of its key in this scope or all; not if its expiry is unreadable."""
    wanted = entries.where(F.col("scope").isin("*", scope)).select("pos", F.col("canonical").alias("value"), "expires_at")
    forms = cut_lineage(targets(wanted.select("value")))
    expiry = parse_instant(F.col("expires_at"))
    live = wanted.join(forms.select("value", "_key"), "value").where("_key <> ''").withColumn("_at", expiry).where(F.col("_at").isNull() | (F.col("_at") >= now))
    first = live.groupBy("_key").agg(F.min(F.struct("pos", (F.col("expires_at").isNull() | F.col("_at").isNotNull()).alias("readable"))).alias("f")).where("f.readable").select("_key")
    return keyed.join(first, "_key", "left_semi").select("indicator_id")
