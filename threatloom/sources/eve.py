"""IDS event JSON lines to DNS, TLS and flow frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatloom.functions.instants import iso_of, parse_instant
from threatloom.functions.net import is_ip

# Counters and TTLs are read as text and cast afterwards: a quoted number is a
# number, anything else counts as zero instead of spoiling the record.
EVE_SCHEMA = """
    timestamp string, event_type string, src_ip string, dest_ip string, rrname string, rrtype string,
    dns struct<type:string, rrname:string, rrtype:string,
               answers:array<struct<rrname:string, rrtype:string, rdata:string, ttl:string>>>,
    tls struct<sni:string, subject:string>,
    flow struct<bytes_toserver:string, bytes_toclient:string>,
    _corrupt string
"""


def eve_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_eve(lines: DataFrame) -> DataFrame:
    """Parse a ``line`` column. ``status`` is dns, tls, flow, unsupported or malformed.

    Other columns pass through; ``event_id`` is added when absent.
    """
    record = F.from_json("line", EVE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    if "event_id" not in lines.columns:
        lines = lines.withColumn("event_id", F.monotonically_increasing_id())
    parsed = lines.withColumn("eve", record).withColumn("at", parse_instant(F.col("eve.timestamp")))
    broken = F.col("eve").isNull() | F.col("eve._corrupt").isNotNull() | F.col("at").isNull() | ~F.ltrim("line").startswith("{")
    status = F.when(F.coalesce(broken, F.lit(True)), "malformed") \
        .when(F.col("eve.event_type").isin("dns", "tls", "flow"), F.col("eve.event_type")).otherwise("unsupported")
    return parsed.select("event_id", status.alias("status"), "eve", iso_of(F.col("at")).alias("ts_iso"),
                         F.unix_seconds("at").alias("epoch_s"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def dns_queries(parsed: DataFrame) -> DataFrame:
    name = F.coalesce(_filled(F.col("eve.dns.rrname")), _filled(F.col("eve.rrname")))
    qtype = F.coalesce(_filled(F.col("eve.dns.rrtype")), _filled(F.col("eve.rrtype")))
    return parsed.where("status = 'dns'").select(
        "event_id", _text(F.col("eve.src_ip")).alias("src"), name.alias("dst"), qtype.alias("qtype"), "ts_iso", "epoch_s") \
        .where("dst is not null")


def dns_answers(parsed: DataFrame) -> DataFrame:
    name = F.coalesce(_filled(F.col("eve.dns.rrname")), _filled(F.col("eve.rrname")), F.lit(""))
    rows = parsed.where("status = 'dns'").select("event_id", name.alias("domain"), F.explode("eve.dns.answers").alias("a"), "ts_iso", "epoch_s")
    return rows.where(F.upper("a.rrtype").isin("A", "AAAA") & (F.col("a.rdata") != "")).select(
        "event_id", "domain", F.col("a.rdata").alias("answer"),
        F.coalesce(F.col("a.ttl").try_cast("bigint"), F.lit(0)).alias("ttl"), "ts_iso", "epoch_s")


def tls(parsed: DataFrame) -> DataFrame:
    sni, subject, dest = _filled(F.col("eve.tls.sni")), F.col("eve.tls.subject"), _text(F.col("eve.dest_ip"))
    return parsed.where("status = 'tls'").select(
        "event_id", _text(F.col("eve.src_ip")).alias("client"), F.coalesce(sni, dest).alias("dst"), sni.alias("sni"),
        F.coalesce(F.contains(subject, sni), F.lit(False)).alias("cert_covers_sni"), is_ip(dest).alias("is_ip_https"),
        sni.isNotNull().alias("has_sni"), "ts_iso", "epoch_s")


def flows(parsed: DataFrame) -> DataFrame:
    def octets(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))

    return parsed.where("status = 'flow'").select(
        "event_id", _text(F.col("eve.src_ip")).alias("host"), _text(F.col("eve.dest_ip")).alias("dst"),
        octets("eve.flow.bytes_toserver").alias("out_bytes"), octets("eve.flow.bytes_toclient").alias("in_bytes"), "ts_iso", "epoch_s")


def line_counts(parsed: DataFrame) -> DataFrame:
    """Lines read, malformed and unsupported."""
    return parsed.agg(F.count("*").alias("lines_read"), F.count_if(F.col("status") == "malformed").alias("malformed_lines"),
                      F.count_if(F.col("status") == "unsupported").alias("unsupported_events"))
