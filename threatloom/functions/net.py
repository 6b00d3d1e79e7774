"""Addresses and prefixes of both families, as JVM expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = r"\A" + _OCTET + r"(\." + _OCTET + r"){3}\z"
IPV4_CIDR_PATTERN = r"\A" + _OCTET + r"(\." + _OCTET + r"){3}/(3[0-2]|[12]?[0-9])\z"



RANGE_TYPE = "struct<family:int,lo:string,hi:string>"


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4_PATTERN), F.lit(False))


def ipv4_number(text: Column) -> Column:
    """Dotted quad to BIGINT; null when not a canonical dotted quad."""
    octets = F.split(F.when(is_ipv4(text), text), r"\.")
    return F.aggregate(octets, F.lit(0).cast("long"), lambda acc, part: acc * 256 + part.cast("long"))


def ipv4_text(number: Column) -> Column:
    quads = [F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *quads)


def ipv4_cidr_bounds(text: Column) -> tuple[Column, Column, Column]:
    """(low, high, prefix length) of an IPv4 prefix, host bits cleared."""
    length = F.when(text.rlike(IPV4_CIDR_PATTERN), F.substring_index(text, "/", -1).cast("int"))
    size = F.pow(F.lit(2.0), F.lit(32) - length).cast("long")
    address = ipv4_number(F.substring_index(text, "/", 1))
    low = address - address % size
    return low, low + size - 1, length


def canonical_ipv4_cidr(text: Column) -> Column:
    """Prefix with host bits cleared, or null."""
    low, _, length = ipv4_cidr_bounds(text)
    quads = F.transform(F.array(low), ipv4_text)
    return F.when(low.isNotNull(), F.concat(F.element_at(quads, 1), F.lit("/"), length.cast("string")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _quad_groups(text: Column) -> Column:
    """A dotted quad at the end of an IPv6 text written as its last two groups."""
    quad = F.regexp_extract(text, r"(?<=:)(" + _OCTET + r"(\." + _OCTET + r"){3})\z", 1)
    digits = F.lpad(F.lower(F.hex(ipv4_number(quad))), 8, "0")
    return F.when(quad == "", text).otherwise(F.concat(
        F.regexp_replace(text, r"(?<=:)" + _OCTET + r"(\." + _OCTET + r"){3}\z", ""), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)))


def ipv6_digits(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address without a zone, or null."""
    def filled(flat: Column) -> Column:
        def groups(side: Column) -> Column:
            return F.filter(F.split(side, ":"), lambda g: g != "")

        head, tail = groups(F.substring_index(flat, "::", 1)), groups(F.when(flat.contains("::"), F.substring_index(flat, "::", -1)).otherwise(""))
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(tail))
        return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), "")

    known = F.when(is_ipv6(text) & ~text.contains("%"), F.lower(text))
    return F.when(known.isNotNull(), _bound(_quad_groups(known), filled))


def ipv6_text(digits: Column) -> Column:
    """Shortest text of 32 hex digits: no leading zeros, the first of the longest runs of zero groups as '::', IPv4-mapped ones with a quad."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substr(digits, k * 4 + 1, F.lit(4)), r"\A0{1,3}", ""))

    def shortened(long: Column) -> Column:
        edged = F.concat(F.lit(":"), long, F.lit(":"))
        runs = F.array(*[F.lit(":" + "0:" * n) for n in range(8, 1, -1)])
        return _bound(F.try_element_at(F.filter(runs, lambda r: edged.contains(r)), F.lit(1)), lambda run: F.when(run.isNull(), long).otherwise(F.concat(
            F.substr(long, F.lit(1), F.greatest(F.instr(edged, run) - 2, F.lit(0))), F.lit("::"), F.substr(long, F.instr(edged, run) + F.length(run) - 1))))

    mapped = F.concat(F.lit("::ffff:"), ipv4_text(F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")))
    return F.when(digits.startswith("0" * 20 + "ffff"), mapped).when(digits.isNotNull(), _bound(F.array_join(groups, ":"), shortened))


def ipv6_bounds(digits: Column, length: Column) -> tuple[Column, Column]:
    """First and last address of a prefix, as hex digits, host bits cleared and set."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    free = F.element_at(F.array(*map(F.lit, (15, 7, 3, 1))), rest + 1)
    kept, last = F.substr(digits, F.lit(1), whole), F.lit(32) - whole - 1
    full = whole == 32
    low = F.when(full, digits).otherwise(F.concat(kept, F.lower(F.hex(nibble - nibble % (free + 1))), F.repeat(F.lit("0"), last)))
    high = F.when(full, digits).otherwise(F.concat(kept, F.lower(F.hex(nibble - nibble % (free + 1) + free)), F.repeat(F.lit("f"), last)))
    return low, high


_LENGTH6 = r"/0*(12[0-8]|1[01][0-9]|[1-9]?[0-9])\z"


def _ipv6_parts(text: Column) -> tuple[Column, Column]:
    """(digits, prefix length) of an IPv6 address or prefix; a bare address has length 128."""
    sized = F.coalesce(text.rlike(_LENGTH6), F.lit(False))
    digits = ipv6_digits(F.when(sized, F.substring_index(text, "/", 1)).otherwise(text))
    return digits, F.when(sized, F.substring_index(text, "/", -1).cast("int")).otherwise(F.lit(128))


def canonical_ip(text: Column) -> Column:
    """Canonical address or null; an IPv6 zone is kept as written."""
    trimmed = F.trim(text)
    zone = F.regexp_extract(trimmed, r"%[^%/]+\z", 0)
    bare = F.when(zone != "", F.substring_index(trimmed, "%", 1)).otherwise(trimmed)
    v6 = F.concat(_bound(ipv6_digits(F.when(trimmed.contains(":"), bare)), ipv6_text), zone)
    return F.when(is_ipv4(trimmed), trimmed).otherwise(v6)


def canonical_cidr(text: Column) -> Column:
    """Canonical prefix with host bits cleared, or null; a bare address is a prefix of its full length."""
    trimmed = F.trim(text)
    v4 = F.coalesce(canonical_ipv4_cidr(trimmed), F.when(is_ipv4(trimmed), F.concat(trimmed, F.lit("/32"))))
    digits, length = _ipv6_parts(F.when(trimmed.contains(":"), trimmed))
    low = ipv6_bounds(digits, length)[0]
    return F.coalesce(v4, F.when(low.isNotNull(), F.concat(_bound(low, ipv6_text), F.lit("/"), length)))


def _hex8(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def with_address_range(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add struct ``out`` (family, lo, hi) with fixed-width hex bounds; null for non-addresses.

    Hex text of one family compares like the number it writes, so one string
    comparison serves IPv4 and IPv6. Built in steps so that no expression is
    repeated inside another.
    """
    text = F.col(value)
    bare = is_ipv4(text)
    cidr = F.coalesce(text.rlike(IPV4_CIDR_PATTERN), F.lit(False))
    digits, length = _ipv6_parts(F.when(text.contains(":"), text))
    df = df.withColumns({
        "_number": ipv4_number(F.when(bare | cidr, F.substring_index(text, "/", 1))),
        "_size": F.pow(F.lit(2.0), F.lit(32) - F.when(cidr, F.substring_index(text, "/", -1)).otherwise("32").cast("int")).cast("long"),
        "_digits": digits, "_length": length,
    }).withColumn("_low", F.expr("_number - _number % _size"))
    low6, high6 = ipv6_bounds(F.col("_digits"), F.col("_length"))
    span = F.when(F.col("_low").isNotNull(), F.struct(
        F.lit(4).alias("family"), _hex8(F.col("_low")).alias("lo"), _hex8(F.col("_low") + F.col("_size") - 1).alias("hi"))).when(
        F.col("_digits").isNotNull(), F.struct(F.lit(6).alias("family"), low6.alias("lo"), high6.alias("hi")))
    return df.withColumn(out, span).drop("_number", "_size", "_low", "_digits", "_length")


def range_literal(prefix: str) -> Column:
    """Policy prefix (driver-side text) as a literal range struct."""
    net = ipaddress.ip_network(prefix, strict=False)
    width = net.max_prefixlen // 4
    return F.struct(
        F.lit(net.version).alias("family"),
        F.lit(f"{int(net[0]):0{width}x}").alias("lo"),
        F.lit(f"{int(net[-1]):0{width}x}").alias("hi"),
    )


def subnet_of(inner: Column, outer: Column) -> Column:
    return (inner["family"] == outer["family"]) & (inner["lo"] >= outer["lo"]) & (inner["hi"] <= outer["hi"])


def with_client_address(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add ``out``: one canonical address for the spellings terminators log, else null.

    v4:port and [v6]:port lose the port; zone ids are refused. Built in steps,
    each a column of its own.
    """
    text = F.col("_text")
    bracketed = text.startswith("[") & text.contains("]")
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    address = (
        F.when(bracketed, F.nullif(F.regexp_extract(text, r"\A\[([^\]]*)\]:[^\]]*\z", 1), F.lit("")))
        .when(colons == 1, F.substring_index(text, ":", 1))
        .otherwise(text)
    )
    df = df.withColumn("_text", F.trim(F.col(raw))).withColumn("_address", address)
    known = F.when(~F.col("_address").contains("%"), F.trim("_address"))
    df = df.withColumn("_address", known).withColumn("_v4", is_ipv4(F.col("_address")))
    other = canonical_ip(F.when(~F.col("_v4") & F.col("_address").contains(":"), F.col("_address")))
    return df.withColumn(out, F.when(F.col("_v4"), F.col("_address")).otherwise(other)).drop("_text", "_address", "_v4")


def is_ipv6(text: Column) -> Column:
    """Textual IPv6 test without Python: full form, or one '::' standing for at least one group."""
    bare = F.regexp_replace(F.lower(text), r"%[^%]+\z", "")
    flat = F.regexp_replace(bare, r"(?<=:)" + _OCTET + r"(\." + _OCTET + r"){3}\z", "0:0")
    groups = F.size(F.filter(F.split(flat, ":"), lambda g: g != ""))
    full = flat.rlike(r"\A([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\z")
    short = flat.rlike(r"\A(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?\z") & (groups <= 7)
    return F.coalesce(full | short, F.lit(False))


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)
