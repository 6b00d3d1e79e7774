"""Parsers on literal inputs, correlation, rule numbers, artifacts."""

import hashlib
import hmac
import json
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from threatloom.functions import digest, net, text
from threatloom.operators import correlation, evidence, ledger
from threatloom.session import ship_package
from threatloom.sinks import artifacts
from threatloom.sources import access_logs, eve, payloads, transactions


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_eve_shapes(spark):
    lines = [
        '{"timestamp":"2026-09-01T19:00:00.5+0000","event_type":"dns","src_ip":"10.0.0.1","dns":{"rrname":"a.example","rrtype":"A","answers":[{"rrtype":"A","rdata":"192.0.2.1","ttl":60},{"rrtype":"TXT","rdata":"x"}]}}',
        '{"timestamp":"2026-09-01T19:00:01Z","event_type":"dns","src_ip":"10.0.0.1","rrname":"flat.example"}',
        '{"timestamp":"2026-09-01T19:00:02Z","event_type":"tls","src_ip":"10.0.0.1","dest_ip":"192.0.2.9","tls":{"sni":"a.example","subject":"CN=b.example"}}',
        '{"timestamp":"2026-09-01T19:00:03Z","event_type":"tls","src_ip":"10.0.0.1","dest_ip":"2001:db8::1","tls":{}}',
        '{"timestamp":"2026-09-01T19:00:04Z","event_type":"flow","src_ip":"10.0.0.1","dest_ip":"192.0.2.9","flow":{"bytes_toserver":999999999,"bytes_toclient":10}}',
        '{"timestamp":"2026-09-01T19:00:05Z","event_type":"alert"}', "not json", '["list"]', '{"event_type":"dns","rrname":"undated.example"}',
    ]
    parsed = eve.parse_eve(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "event_id long, line string")).cache()
    assert {r.event_id: r.status for r in parsed.collect()} == {0: "dns", 1: "dns", 2: "tls", 3: "tls", 4: "flow", 5: "unsupported", 6: "malformed", 7: "malformed", 8: "malformed"}
    assert [(r.dst, r.qtype) for r in eve.dns_queries(parsed).orderBy("event_id").collect()] == [("a.example", "A"), ("flat.example", None)]
    assert [(r.domain, r.answer, r.ttl) for r in eve.dns_answers(parsed).collect()] == [("a.example", "192.0.2.1", 60)]
    tls = {r.event_id: r for r in eve.tls(parsed).collect()}
    assert (tls[2].dst, tls[2].cert_covers_sni, tls[2].has_sni) == ("a.example", False, True) and (tls[3].dst, tls[3].is_ip_https, tls[3].has_sni) == ("2001:db8::1", True, False)
    assert [(r.out_bytes, r.in_bytes) for r in eve.flows(parsed).collect()] == [(999999999, 10)]
    assert tuple(eve.line_counts(parsed).first()) == (9, 3, 1)


def test_access_log_formats(spark):
    lines = [
        '[2026-09-01T19:41:10Z] "GET /asset HTTP/1.1" 203.0.113.9 accept-language=en-US,en;q=0.9 accept-encoding=gzip,deflate,br ja4=t13d',
        '{"time":"2026-09-01T21:47:03+02:00","remote_addr":"[2001:0db8::1]:443","http_accept_language":"en","header_order":"host|accept"}',
        "Jan  1 19:49:27 edge haproxy[312]: 198.51.100.4:33890 [03/Jan/2026:19:49:27.001] h=accept-language:* h=accept-encoding:identity",
        "this line is not a recognized access log format at all", '{"time":"later","remote_addr":"192.0.2.1"}', '[2026-09-01T19:41:10Z] "GET / HTTP/1.1" fe80::1%eth0', "",
    ]
    parsed = access_logs.parse_access_log(spark.createDataFrame([(x,) for x in lines], "line string")).cache()
    got = {lines.index(r.line): r for r in parsed.collect()}
    assert tuple(access_logs.log_counts(parsed).first()) == (3, 1, 2) and 6 not in got
    assert (got[0].client_ref, got[0].accept_language, got[0].tls_ja4) == ("203.0.113.9", "en-US,en;q=0.9", "t13d")
    assert (got[1].client_ref, got[1].observed_at, got[1].header_order) == ("2001:db8::1", "2026-09-01T19:47:03Z", ["host", "accept"])
    assert (got[2].client_ref, got[2].observed_at, got[2].accept_encoding) == ("198.51.100.4", "2026-01-03T19:49:27Z", "identity")
    assert [got[i].outcome for i in (3, 4, 5)] == ["unparsed", "rejected", "unparsed"]


def test_transaction_contract_refuses(spark):
    good = {"client_ref": "192.0.2.1", "observed_at": "2026-09-01T19:41:10.25Z", "header_order": ["host", "accept"], "cache_behavior": "validators_absent"}
    cases = [good, {**good, "observed_at": "yesterday"}, {**good, "extra": 1}, {**good, "tls_ja4": 5}, {**good, "tls_ja4": "a\u0001"}, {**good, "header_order": ["a", "a"]},
             {**good, "client_ref": ""}, {k: v for k, v in good.items() if k != "client_ref"}, {**good, "range_fallback": "odd"}, {**good, "header_order": []}, {"rejected": True}]
    lines = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(99, "[]")], "n int, line string")
    verdicts = {r.n: len(r.violations) for r in transactions.parse_transactions(lines).collect()}
    assert verdicts[0] == 0 and verdicts[9] == 0 and 10 not in verdicts
    assert all(verdicts[i] > 0 for i in (1, 2, 3, 4, 5, 6, 7, 8, 99))


def test_payload_fails_whole_and_binds_sources(spark):
    item = lambda **kw: {"id": "i-1", "type": "fqdn", "value": "Evil.Example.", "evidence": [{"kind": "curated_source", "points_m": 100, "source_id": "stranger"}, {"kind": "curated_source"}], **kw}
    bodies = [("a", json.dumps({"indicators": [item(), item(id="i-2", type="cidr", value="10.1.2.3/8", tags=["b", "a", "a"])]})),
              ("b", json.dumps({"indicators": [item(), item(value="evil.com;")]})), ("c", "[]"), ("d", json.dumps({"indicators": [item(type="ipv6", value="2001:DB8:0::1"), item(value="bücher.example")]}))]
    frame = spark.createDataFrame(bodies, "channel string, body string").selectExpr("*", "array('up') as allowed_sources", "cast(array() as array<string>) as allowed_kinds")
    parsed = payloads.parse_payloads(frame).cache()
    assert {r.channel: r.accepted for r in payloads.payload_batches(parsed).collect()} == {"a": True, "b": False, "c": False, "d": True}
    items = payloads.accepted_items(parsed)
    assert sorted(r.value for r in payloads.payload_indicators(items).collect()) == ["10.0.0.0/8", "2001:db8::1", "evil.example", "xn--bcher-kva.example"]
    rows = payloads.payload_evidence(items).where("channel_source = 'a' and pos = 0").orderBy("evidence_pos").collect()
    assert [(r.source_id, r.demoted, "points_m" in r.detail) for r in rows] == [("unregistered", True, False), ("a", False, False)]


def test_keyed_handles_and_draws(spark):
    key = b"k" * 40
    assert one(spark, digest.handle_for(F.col("x"), key), x="192.0.2.1é") == "rh--" + hmac.new(key, "192.0.2.1é".encode(), hashlib.sha256).hexdigest()[:16]
    long_key = b"z" * 90
    assert one(spark, digest.keyed_hex(F.col("x"), long_key), x="a") == hmac.new(long_key, b"a", hashlib.sha256).hexdigest()
    for seed in ("s1", "s2", "s3"):
        inner = hashlib.sha256(b"dom|" + seed.encode()).digest()
        word = int.from_bytes(hashlib.sha256(inner + bytes(8)).digest()[:8], "big")
        assert one(spark, digest.first_draw(F.col("x"), 500_000, 1_000_000, "dom"), x=seed) == 500_000 + word % 500_001


@pytest.mark.parametrize("address,ok", [("::", True), ("::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7::", True), ("1:2:3:4:5:6:7:8::", False),
                                        ("1::2::3", False), ("12345::", False), ("::ffff:192.0.2.1", True), ("192.0.2.1", True), ("192.0.2.256", False), ("01.2.3.4", False), ("a.example", False), ("", False), (":", False)])
def test_ip_predicate(spark, address, ok):
    import ipaddress
    try:
        ipaddress.ip_address(address)
        truth = True
    except ValueError:
        truth = False
    assert truth == ok and one(spark, net.is_ip(F.col("x")), x=address) == ok


def test_names(spark):
    for raw, want in [(" Evil.COM.. ", "evil.com"), ("a..b", None), ("x" * 64 + ".com", None), ("ok_name-1.example", "ok_name-1.example"), ("evil.com;", None), ("", None)]:
        assert one(spark, text.canonical_fqdn(F.col("x")), x=raw) == want
    assert one(spark, text.entropy_microbits(F.col("x")), x="abcd") == 2_000_000 and one(spark, text.entropy_microbits(F.col("x")), x="aaaa") == 0


def test_fingerprint_links_equal_brute_force(spark):
    import random
    rng = random.Random(4)
    keys = [f for f in correlation.FEATURES]
    maps = [{k: rng.choice("ab") for k in rng.sample(keys, rng.choice([2, 2, 3, 4, 7]))} for _ in range(60)]
    frame = spark.createDataFrame([(f"h{i}", m) for i, m in enumerate(maps)], "handle string, features map<string,string>") \
        .withColumn("fingerprint", correlation.fingerprint(F.col("features")))
    prints = {r.fingerprint: r.features for r in frame.collect()}
    for least in (2, 3, 4):
        expected = set()
        for (a, fa), (b, fb) in combinations(sorted(prints.items()), 2):
            shared = set(fa) & set(fb)
            same = sum(fa[k] == fb[k] for k in shared)
            if same >= least or (same == min(len(fa), len(fb)) == len(shared) and same >= 2):
                expected.add((a, b, same))
        links = [tuple(r) for r in correlation.fingerprint_links(frame, least, tile=5).collect()]
        assert len(links) == len(set(links)) and set(links) == expected


def test_states_do_not_depend_on_input_order(spark):
    rows = [("c", f"2026-09-01T19:00:0{i}Z", f"j{i}") for i in range(5)] + [("c", "2026-09-01T19:00:04Z", "a")]
    for ordered in (rows, rows[::-1]):
        frame = transactions.validated(spark.createDataFrame(ordered, "client_ref string, observed_at string, tls_ja4 string"))
        state = correlation.requester_states(frame, b"k" * 32).first()
        assert state.features == {"P3:ja4": "j4"} and state.transactions == 6 and state.last_seen == "2026-09-01T19:00:04Z"


def test_rule_numbers_probe_forward(spark):
    ids = [f"decision--{i}" for i in range(400)]
    base = {i: ledger.RULE_BASE + int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % ledger.RULE_SPAN for i in ids}
    taken = sorted(set(list(base.values())[:150] + [v + 1 for v in list(base.values())[:80]]))
    got = {r.decision_id: r.rule_no for r in ledger.rule_numbers(spark.createDataFrame([(i,) for i in ids], "decision_id string"),
                                                                  spark.createDataFrame([(t,) for t in taken], "rule_no long"), chunk=5000).collect()}
    used, expected = set(taken), {}
    for i in sorted(ids, key=lambda x: (base[x], x)):
        n = base[i]
        while n in used:
            n += 1
        used.add(n)
        expected[i] = n
    assert got == expected


def test_ledger_merges_and_audit(spark):
    inds = spark.createDataFrame([("i1", "fqdn", "A.example.", 2), ("i2", "fqdn", "a.example", 1), ("i3", "fqdn", "b.example", 1)], "indicator_id string, itype string, value string, first_seen int")
    refs = spark.createDataFrame([("i1", "s1"), ("i2", "s1"), ("i1", "s2"), ("i3", "s1")], "indicator_id string, source_id string")
    survivors, moved = ledger.merge_duplicates(inds, refs, ["indicator_id", "source_id"])
    assert sorted(r.indicator_id for r in survivors.collect()) == ["i2", "i3"]
    assert sorted((r.indicator_id, r.source_id) for r in moved.collect()) == [("i2", "s1"), ("i2", "s2"), ("i3", "s1")]

    rows, prev = [], None
    for n in range(1, 40):
        body = "|".join([str(n), "t", "me", "e", "s", "{}", prev or ""])
        digest_ = hashlib.sha256(body.encode()).hexdigest()
        rows.append((n, "t", "me", "e", "s", "{}", prev, digest_))
        prev = digest_
    schema = "event_id long, at string, actor string, event_type string, subject string, detail string, prev_hash string, row_hash string"
    assert ledger.audit_breaks(spark.createDataFrame(rows, schema), chunk=7).count() == 0
    edited = [r if r[0] != 20 else (*r[:2], "you", *r[3:]) for r in rows if r[0] != 30]
    breaks = {r.event_id: (r.hash_broken, r.link_broken) for r in ledger.audit_breaks(spark.createDataFrame(edited, schema), chunk=7).collect()}
    assert breaks == {20: (True, False), 31: (False, True)}


def test_one_value_in_two_tenants_attaches_to_both(spark):
    inds = spark.createDataFrame([("i1", "fqdn", "a.example"), ("i2", "fqdn", "a.example")], "indicator_id string, itype string, value string")
    dets = spark.createDataFrame([("a.example", "k"), ("z.example", "k")], "target string, kind string")
    attached, waiting = evidence.attach_detections(dets, inds)
    assert sorted(r.indicator_id for r in attached.collect()) == ["i1", "i2"] and [r.target for r in waiting.collect()] == ["z.example"]


def test_drift_of_rules(spark):
    desired = spark.createDataFrame([("sid:1", "x sid:1; y"), ("sid:12", "x sid:12; y"), ("sid:3", "x sid:3; y")], "rule_id string, fragment string") \
        .withColumn("fragment_hash", F.concat(F.lit("frag--"), digest.sha_hex(F.col("fragment"), 24)))
    lines = spark.createDataFrame([("x sid:12; y",), ("x sid:3; z",), ("x sid:9; y",), ("# comment",)], "line string")
    assert {r.rule_id: r.drift for r in artifacts.artifact_drift(desired, lines, "ids").collect()} == {"sid:1": "missing", "sid:3": "changed", "sid:9": "unexpected"}
