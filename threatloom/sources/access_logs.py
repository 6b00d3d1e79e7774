"""Terminator access logs to observed transactions.

Formats are tried in a fixed order and the first that yields a usable client
wins. A line no format recognises is unparsed; a recognised record that breaks
the contract is rejected. Neither stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.instants import iso_of, parse_instant
from threatloom.functions.net import with_client_address
from threatloom.sources.transactions import json_text, validated

# Line shapes of the three supported log formats.
ENVOY = r'\A\[([^\]]+)\]\s+"([^"]*)"\s+(.*)\z'
HAPROXY = r"\A\S+\s+\d+\s+\S+\s+\S+\s+haproxy\[\d+\]:\s+(\S+)\s+\[([^\]]+)\]"
ENVOY_TOKEN = r'(\w[\w.-]*)=([^\s"]+)'
HAPROXY_TOKEN = r"h=([\w-]+):([^\s]+)"
CLF = r"\A(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?\z"


def normal_timestamp(ts: Column) -> Column:
    """ISO or common-log time to ISO UTC seconds; anything else passes through and fails the contract."""
    text = F.trim(ts)
    iso_like = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & text.contains("T")
    iso = F.when(iso_like, parse_instant(text))
    clf = F.when(text.rlike(CLF), F.try_to_timestamp(
        F.concat(F.substring(text, 1, 3), F.initcap(F.substring(text, 4, 3)), F.substring(text, 7, 14), F.lit(" +0000")),
        F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    return F.coalesce(iso_of(iso), iso_of(clf), text)


def _last_token(text: Column, pattern: str, *names: str) -> Column:
    """Value of the last name/value token whose lowered name is in ``names``."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    hits = F.filter(pairs, lambda p: F.lower(p["n"]).isin(*names))
    return F.try_element_at(hits, F.lit(-1))["v"]


def _group(line: Column, pattern: str, index: int) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, index))


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Parse a ``line`` column. Adds contract columns, ``violations``, ``log_format`` and ``outcome``."""
    line = F.col("line")
    rows = lines.where(F.trim("line") != "").withColumns({
        "_e_ts": _group(line, ENVOY, 1), "_e_req": _group(line, ENVOY, 2), "_e_rest": F.trim(_group(line, ENVOY, 3)),
        "_h_client": _group(line, HAPROXY, 1), "_h_ts": _group(line, HAPROXY, 2),
        "_json": F.when(F.ltrim("line").startswith("{"), F.try_parse_json("line"))})
    first_word = F.regexp_extract(F.substring_index("_e_rest", '"', 1), r"\A\s*(\S+)", 1)
    envoy = F.col("_e_ts").isNotNull() & F.trim("_e_req").rlike(r"\S\s+\S") & (first_word != "")
    haproxy = F.col("_h_client").isNotNull()
    json = F.col("_json")
    time = F.coalesce(*[F.when(json_text(json, n) != "", json_text(json, n)) for n in ("time", "time_iso8601")])
    nginx = json.isNotNull() & time.isNotNull()
    rows = rows.withColumn("_format", F.when(envoy, "envoy").when(haproxy, "haproxy").when(nginx, "nginx"))
    fmt = F.col("_format")
    # One address column for all formats: the IPv6 helper runs once per line at most.
    raw = F.when(fmt == "envoy", first_word).when(fmt == "haproxy", F.col("_h_client")) \
        .when(fmt == "nginx", F.try_variant_get(json, "$.remote_addr", "string"))
    rows = with_client_address(rows.withColumn("_raw", raw), "_raw", "client_ref") \
        .withColumn("log_format", F.when(F.col("client_ref").isNotNull(), fmt))
    fmt = F.col("log_format")
    stamp = F.when(fmt == "envoy", F.col("_e_ts")).when(fmt == "haproxy", F.col("_h_ts")).when(fmt == "nginx", time)
    names = F.slice(F.filter(F.split(json_text(json, "header_order"), r"\|"), lambda h: h != ""), 1, 64)
    ja4 = F.coalesce(F.when(json_text(json, "ja4") != "", json_text(json, "ja4")), json_text(json, "ssl_ja4"))

    def pick(envoy_names: tuple, haproxy_name: str | None, nginx_value: Column, limit: int) -> Column:
        value = F.when(fmt == "envoy", _last_token(F.col("_e_rest"), ENVOY_TOKEN, *envoy_names))
        if haproxy_name:
            value = value.when(fmt == "haproxy", _last_token(line, HAPROXY_TOKEN, haproxy_name))
        return F.substring(value.when(fmt == "nginx", nginx_value), 1, limit)

    rows = rows.withColumns({
        "observed_at": normal_timestamp(stamp),
        "accept_language": pick(("accept-language",), "accept-language", json_text(json, "http_accept_language"), 256),
        "accept_encoding": pick(("accept-encoding",), "accept-encoding", json_text(json, "http_accept_encoding"), 256),
        "tls_ja4": pick(("x-envoy-external-ja4", "ja4"), None, ja4, 128),
        "_names": F.when(fmt == "nginx", names)})
    rows = rows.withColumn("header_order", F.when((F.size("_names") > 0) & (F.size(F.array_distinct("_names")) == F.size("_names")), F.col("_names")))
    outcome = F.when(F.col("log_format").isNull(), "unparsed").when(F.size("violations") > 0, "rejected").otherwise("parsed")
    return validated(rows.drop(*[c for c in rows.columns if c.startswith("_")])).withColumn("outcome", outcome)


def log_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("parsed", "rejected", "unparsed")])
