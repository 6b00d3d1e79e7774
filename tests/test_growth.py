"""Work that grows with the input where a key has many rows on both sides."""

import json

import pytest
from threatloom.operators import analytics, ledger
from threatloom.session import ship_package
from threatloom.streaming import families, ordered
from threatloom.streaming.replay import replayed


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_meet_explained_actions(spark):
    """The join that multiplies rows comes last, so that its rows are never shuffled."""
    reports = spark.range(3).selectExpr("id as report_id", "'t' as target", "timestamp'2020-01-02' as reported_at")
    actions = spark.range(4).selectExpr("concat('a', id) as action_id", "concat('d', id % 2) as decision_id", "'t' as target",
                                        "timestamp'2020-01-01' as created_at", "if(id = 3, timestamp'2020-01-02', null) as expires_at")
    decisions = spark.range(2).selectExpr("concat('d', id) as decision_id", "'x' as disposition", "'L0' as rung", "array('r') as reason_codes")
    receipts = spark.range(1, 4).selectExpr("concat('a', id) as action_id", "concat('r', id) as receipt_id")
    found = ledger.explain_block(reports, actions, decisions, receipts)
    assert sorted((r.report_id, r.action_id, r.receipt_id) for r in found.collect()) == [(k, a, r) for k in range(3) for a, r in (("a0", None), ("a1", "r1"), ("a2", "r2"))]
    joins = [line for line in plan_of(found).splitlines() if "Join" in line]
    assert "Inner" in joins[0], joins


def test_registry_entry_listed_often_meets_an_address_once(spark):
    addresses = spark.range(20).selectExpr("concat('i', id) as indicator_id", "concat('198.51.100.', id * 10) as address")
    classes = spark.range(400).selectExpr("concat('198.51.100.', (id % 4) * 64 + id % 3, '/26') as prefix", "'vpn' as infra_class", "id as version") \
        .union(spark.sql("select '198.51.100.0/24', 'cdn', 7"))
    found = {r.indicator_id: (r.infra_class, r.prefix, r.version) for r in analytics.infrastructure_evidence(addresses, classes, [24, 26]).collect()}
    for k in range(20):
        block = k * 10 // 64
        best = max((f"198.51.100.{block * 64 + n % 3}/26", n) for n in range(400) if n % 4 == block)
        assert found[f"i{k}"] == ("vpn", *best)
    plan = plan_of(analytics.infrastructure_evidence(addresses, classes, [24, 26]))
    assert plan.index("Join") < plan.rindex("Aggregate")


@pytest.mark.parametrize("tile", [2, 4096])
def test_patch_coverage_without_shuffled_pairs(spark, tile):
    assets = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (3, None), (None, "a"), (4, "z")]
    advisories = [(n, "ab"[n % 2]) for n in range(10, 21)] + [(12, "b"), (12, "c"), (None, "b")]
    patches = [(1, 12), (1, 12), (1, 13), (2, 10), (2, 11), (9, 11), (None, 12), (3, None)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    found = analytics.virtual_patch_coverage(frame(assets, "asset_id long, product string"), frame(advisories, "advisory_id long, product string"),
                                             frame(patches, "asset_id long, advisory_id long"), tile)
    exposed = {(a, v) for a, p in assets for v, q in advisories if p is not None and p == q}
    known = {p for p in set(patches) if None not in p}
    expected = [(*p, "covered" if p in known else "uncovered") for p in exposed] + [(*p, "orphaned") for p in set(patches) if p not in exposed or p not in known]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert "FullOuter" not in plan_of(found)


def test_waiting_rows_have_no_limit_of_their_own_and_lie_in_pieces(spark, monkeypatch):
    """Nothing is shed unless a capacity is asked for, and no piece holds a whole key."""
    assert families.Volume().capacity is None

    class Store(dict):
        def getValue(self, k):
            return self.get(k)

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    class Counter:
        n = None

        def exists(self):
            return self.n is not None

        def get(self):
            return self.n

        def update(self, n):
            self.n = n

    monkeypatch.setattr(ordered, "PIECE", 7)
    fold = families.Volume()
    fold.pieces, fold.counter = Store(), Counter()
    rows = [(at * 37 % 101, at, "d", 1, 1, "x", "h") for at in range(100)]
    for start in (0, 40):
        fold._keep(sorted(rows[start: start + 60][: 40 if not start else 60]))
    assert max(len(json.loads(v[0])) for v in fold.pieces.values()) == 7
    assert list(fold._due(50)) == sorted(r for r in rows if r[0] < 50)
    assert list(fold._due(50)) == [] and list(fold._due(1000)) == sorted(r for r in rows if r[0] >= 50)


def test_more_members_than_the_entry_of_a_key_holds(spark, monkeypatch):
    monkeypatch.setattr(ordered.Members, "LIMIT", 3)
    schema = "epoch_s long, event_id long, domain string, answer string, ttl long, ts_iso string"
    rows = [(1_700_000_000 + k * 60, k, "ab"[k % 2], f"10.0.0.{k % 22}", 60, "t") for k in range(80)]
    found = replayed(spark.createDataFrame(rows, schema), lambda s: families.fastflux_stream(s, "20 minutes"))
    got = {(r.dst, r.event_id): r.distinct_answers for r in found.where("shed is null").collect()}
    seen, expected = {"a": [], "b": []}, {}
    for _, k, domain, answer, *_ in rows:
        seen[domain].append(answer)
        if len(set(seen[domain])) >= 5 and len(seen[domain]) >= 8:
            expected[domain, k] = len(set(seen[domain]))
    assert got == expected
