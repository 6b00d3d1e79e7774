"""Requester correlation queries: orders stand for observed transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatloom.functions.digest import handle_for
from threatloom.functions.instants import iso_of, utc_literal
from threatloom.operators import correlation
from threatloom.queries.frames import table
from threatloom.queries.registry import Registry
from threatloom.session import cut_lineage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

KEY = b"deployment-key-for-table-queries-0001"


def transactions(spark, sf_dir):
    """Contract columns from orders and their customers; about a third of the fields is absent."""
    orders = table(spark, sf_dir, "orders").withColumn("observed_at", iso_of(F.col("o_orderdate").cast("timestamp")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
        "concat('c', o_custkey) as client_ref", "observed_at",
        "case when o_orderkey % 3 = 0 then concat('en-', c_nationkey % 4, ';q=0.9, fr') end as accept_language",
        "case when o_orderkey % 3 = 0 then concat('gzip, ', lower(c_mktsegment)) end as accept_encoding",
        "case when o_orderkey % 4 > 0 then concat('j', c_nationkey % 5) end as tls_ja4",
        "case when o_orderstatus = 'F' then 'validators_absent' when o_orderstatus = 'O' then 'revalidation_ignored' end as cache_behavior",
        "case when o_orderkey % 5 = 0 then 'range_honored' end as range_fallback",
        "case when o_orderkey % 2 = 0 then array('host', lower(o_orderpriority), 'accept') end as header_order",
        "case when o_orderkey % 7 = 0 then array('ts', o_orderstatus) end as challenge_body_key_order")


_TX = """tx AS (SELECT 'c' || o_custkey AS client_ref, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS observed_at, o_orderdate AS seen,
  CASE WHEN o_orderkey % 3 = 0 THEN sha256('[''en-' || (c_nationkey % 4) || ''', ''fr'']|[' || CASE WHEN 'gzip' < lower(c_mktsegment) THEN '''gzip'', ''' || lower(c_mktsegment) || '''' ELSE '''' || lower(c_mktsegment) || ''', ''gzip''' END || ']')[1:12] END AS p2,
  CASE WHEN o_orderkey % 4 > 0 THEN 'j' || (c_nationkey % 5) END AS p3, CASE o_orderstatus WHEN 'F' THEN 'validators_absent' WHEN 'O' THEN 'revalidation_ignored' END AS p4,
  CASE WHEN o_orderkey % 5 = 0 THEN 'range_honored' END AS p6, CASE WHEN o_orderkey % 2 = 0 THEN ['host', lower(o_orderpriority), 'accept'] END AS ho,
  CASE WHEN o_orderkey % 7 = 0 THEN 'ts,' || o_orderstatus END AS p5 FROM orders JOIN customer ON o_custkey = c_custkey)"""
_HEX_KEY = KEY.ljust(64, b"\0")
_IPAD, _OPAD = bytes(b ^ 0x36 for b in _HEX_KEY).hex(), bytes(b ^ 0x5C for b in _HEX_KEY).hex()
_HANDLE = f"'rh--' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(client_ref))))[1:16]"
#: For other queries over the same transactions.
HANDLES_SQL, HANDLE_SQL = _TX, _HANDLE
_STATES = f"""{_TX}, lf AS (
  SELECT client_ref, observed_at, seen, unnest(['P1:header_order', 'P1:header_set', 'P2:coherence', 'P3:ja4', 'P4:cache_behavior', 'P5:key_order', 'P6:range_fallback']) AS feature,
    unnest([array_to_string(ho, ','), sha256(array_to_string(list_sort(ho), ','))[1:12], p2, p3, p4, p5, p6]) AS value FROM tx),
bf AS (SELECT client_ref, feature, (max(struct_pack(seen := seen, value := value))).value AS value FROM lf WHERE value IS NOT NULL GROUP BY 1, 2),
tc AS (SELECT client_ref, count(*) AS transactions, max(observed_at) AS last_seen FROM tx WHERE ho IS NOT NULL OR coalesce(p2, p3, p4, p5, p6) IS NOT NULL GROUP BY 1),
fp AS (SELECT client_ref, string_agg(feature || '=' || value, '|' ORDER BY feature) AS canon, count(*) AS probes FROM bf GROUP BY 1),
states AS (SELECT {_HANDLE} AS handle, client_ref, 'fp--fp1--' || sha256(canon)[1:16] AS fingerprint, probes, transactions, last_seen FROM fp JOIN tc USING (client_ref))"""


def states(spark, sf_dir):
    return correlation.requester_states(transactions(spark, sf_dir), KEY)


@query("requester_handles", f"SELECT c_custkey, {_HANDLE.replace('client_ref', 'c_name')} AS handle FROM customer")
def requester_handles(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", handle_for(F.col("c_name"), KEY).alias("handle"))


@query("requester_states", f"WITH {_STATES} SELECT handle, fingerprint, probes AS probe_count, transactions, last_seen FROM states")
def requester_states(spark, sf_dir):
    return states(spark, sf_dir).select("handle", "fingerprint", F.size("features").cast("long").alias("probe_count"), "transactions", "last_seen")


@query("requester_features", f"WITH {_STATES} SELECT {_HANDLE} AS handle, feature, value FROM bf")
def requester_features(spark, sf_dir):
    return states(spark, sf_dir).select("handle", F.explode("features").alias("feature", "value"))


@query("requester_prune", f"WITH {_STATES} SELECT handle, last_seen FROM states WHERE abs(epoch(strptime(last_seen, '%Y-%m-%dT%H:%M:%SZ')) - epoch(TIMESTAMP '2000-06-01')) <= 15552000")
def requester_prune(spark, sf_dir):
    return correlation.pruned_states(states(spark, sf_dir), utc_literal("2000-06-01T00:00:00Z"), 15_552_000).select("handle", "last_seen")


@query("fingerprint_groups", f"WITH {_STATES} SELECT fingerprint, count(*) AS requesters, max(probes) AS probe_count FROM states GROUP BY 1")
def fingerprint_groups(spark, sf_dir):
    return correlation.fingerprint_groups(states(spark, sf_dir)).withColumn("probe_count", F.col("probe_count").cast("long"))


@query("fingerprint_links", f"""WITH {_STATES}, d AS (SELECT fingerprint, min(client_ref) AS client_ref, max(probes) AS n FROM states GROUP BY 1),
x AS (SELECT fingerprint, n, feature, value FROM d JOIN bf USING (client_ref)),
p AS (SELECT a.fingerprint AS a, b.fingerprint AS b, count(*) AS keys, count(*) FILTER (a.value = b.value) AS same, least(any_value(a.n), any_value(b.n)) AS least_n
  FROM x a JOIN x b ON a.feature = b.feature AND a.fingerprint < b.fingerprint GROUP BY 1, 2)
SELECT a, b, same AS shared_probes FROM p WHERE same >= 3 OR (same = least_n AND same >= 2 AND same = keys)""")
def fingerprint_links(spark, sf_dir):
    # The link search reads the states several times.
    return correlation.fingerprint_links(cut_lineage(states(spark, sf_dir)), tile=200)


@query("fingerprint_similarity", f"""WITH {_STATES}, n AS (SELECT client_ref, list(feature ORDER BY feature) AS keys FROM bf GROUP BY 1),
 o AS (SELECT handle, keys, lead(keys) OVER (ORDER BY handle) AS next_keys FROM states JOIN n USING (client_ref))
SELECT handle, len(list_intersect(keys, next_keys)) AS shared FROM o WHERE next_keys IS NOT NULL""")
def fingerprint_similarity(spark, sf_dir):
    """Shared features of each requester and the next one in handle order."""
    from threatloom.operators import scan
    numbered = states(spark, sf_dir).select("handle", "features") \
        .withColumn("at", F.conv(F.substring("handle", 5, 12), 16, 10).cast("long"))
    linked = scan.lag_by_chunk(numbered.withColumn("at", -F.col("at")), "at", ["features"], 1 << 40)
    return linked.where("prev_features is not null").select("handle", correlation.similarity(F.col("features"), F.col("prev_features")).cast("long").alias("shared"))


@query("correlation_report", f"""WITH {_STATES}, d AS (SELECT fingerprint, min(client_ref) AS client_ref, max(probes) AS n FROM states GROUP BY 1),
x AS (SELECT fingerprint, n, feature, value FROM d JOIN bf USING (client_ref)),
p AS (SELECT a.fingerprint AS a, b.fingerprint AS b, count(*) AS keys, count(*) FILTER (a.value = b.value) AS same, least(any_value(a.n), any_value(b.n)) AS least_n
  FROM x a JOIN x b ON a.feature = b.feature AND a.fingerprint < b.fingerprint GROUP BY 1, 2)
SELECT 'tracked_requesters' AS section, NULL::VARCHAR AS a, NULL::VARCHAR AS b, count(*) AS n FROM states
UNION ALL SELECT 'fingerprint_group', fingerprint, NULL, max(probes) FROM states GROUP BY fingerprint
UNION ALL SELECT 'member', fingerprint, handle, transactions FROM states
UNION ALL SELECT 'link', a, b, same FROM p WHERE same >= 5 OR (same = least_n AND same >= 2 AND same = keys)""")
def correlation_report(spark, sf_dir):
    return correlation.correlation_report(cut_lineage(states(spark, sf_dir)), min_similarity=5)
