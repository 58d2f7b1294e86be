"""Small literal frames with known answers, and brute-force checks of the sequential and chunked operators."""
from __future__ import annotations

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.config import GateRules, RiskRules
from riskloom.functions.geo import haversine_km
from riskloom.functions.numeric import strength
from riskloom.operators import detectors as det
from riskloom.operators import documents as doc
from riskloom.operators import evaluation as ev
from riskloom.operators import fifo
from riskloom.operators import graph as g
from riskloom.operators import quality as dq
from riskloom.operators import retrieval as ret
from riskloom.operators.alerts import FACTORS, triage
from riskloom.operators.cycles import verified_cycles
from riskloom.operators.mule import onward_chains
from riskloom.operators.orient import orient
from riskloom.operators.profile import mix_divergence
from riskloom.operators.quantiles import exact_quantiles, value_counts
from riskloom.operators.windows import rolling_band, rolling_max, running_max, with_previous

T0 = datetime(2026, 1, 1)


def sec(hour: int, minute: int = 0) -> int:
    return hour * 3600 + minute * 60


def txns(spark, rows):
    """rows: (id, hours after T0, sender, receiver, usd)"""
    return spark.createDataFrame([(i, T0 + timedelta(hours=h), s, r, None, None, float(u), "transfer", "web", "NG", None, None, "completed", None) for i, h, s, r, u in rows],
                                 "transaction_id string, ts timestamp, sender_account_id string, receiver_account_id string, merchant_id string, device_id string, amount_usd double, "
                                 "transaction_type string, channel string, country string, latitude double, longitude double, status string, external_counterparty string")


# ------------------------------------------------------------------------------------------------ windows and quantiles
def test_rolling_count_known_case(spark):
    df = spark.createDataFrame([("a", sec(10)), ("a", sec(10, 20)), ("a", sec(10, 50)), ("a", sec(12))], "k string, sec long")
    assert [tuple(r) for r in rolling_max(df, ["k"], 3600).collect()] == [("a", 3, sec(10))]


def test_rolling_edge_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3600), ("a", 7201)], "k string, sec long")
    assert rolling_max(df, ["k"], 3600).first().max_count == 2


def test_rolling_matches_brute_force_on_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randrange(0, 90000), rnd.randrange(1, 999) / 100) for _ in range(3000)] + [(f"k{i % 7}", rnd.randrange(0, 90000), 1.0) for i in range(200)]
    got = {r.k: (r.max_count, round(r.total_usd, 2), r.start_sec) for r in rolling_band(spark.createDataFrame(rows, "k string, sec long, usd double"), ["k"], 5000, "usd").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((s, u) for kk, s, u in rows if kk == k)
        best = max((sum(1 for t, _ in mine if s <= t <= s + 5000), round(sum(u for t, u in mine if s <= t <= s + 5000), 2), s) for s, _ in mine)
        assert got[k] == best


def test_previous_row_and_running_max_cross_chunks(spark):
    rnd = random.Random(2)
    rows = sorted({("a" if rnd.random() < 0.7 else "b", rnd.randrange(0, 5000)) for _ in range(400)})
    df = spark.createDataFrame(rows, "k string, s long")
    prev = {(r.k, r.s): r.prev_s for r in with_previous(df, ["k"], ["s"], ["s"], F.floor(F.col("s") / 37)).collect()}
    top = {(r.k, r.s): r.m for r in running_max(df, ["k"], ["s"], F.when(F.col("s") % 11 == 0, F.col("s")), F.floor(F.col("s") / 37), "m").collect()}
    for k in "ab":
        last, best = None, None
        for s in [s for kk, s in rows if kk == k]:
            assert prev[(k, s)] == last
            last, best = s, (s if s % 11 == 0 else best)
            assert top[(k, s)] == best


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    data = {"hot": [round(rnd.lognormvariate(3, 2), 2) for _ in range(5000)], "one": [5.0], "neg": [-3.0, -1.5, 0.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, x double")
    for r in exact_quantiles(value_counts(df, ["k"], "x"), ["k"], {"p50": 0.5, "p99": 0.99}).collect():
        assert r.total == len(data[r.k])
        assert r.p50 == pytest.approx(np.percentile(data[r.k], 50)) and r.p99 == pytest.approx(np.percentile(data[r.k], 99))


def test_strength_ramp(spark):
    rows = spark.createDataFrame([(6.0, 6.0), (12.0, 6.0), (9.0, 6.0), (1.0, 0.0)], "o double, t double").select(strength(F.col("o"), F.col("t"), 1.0).alias("s")).collect()
    assert [r.s for r in rows] == [0.5, 1.0, 0.75, 1.0]


def test_haversine_and_divergence(spark):
    km = spark.range(1).select(haversine_km(F.lit(6.52), F.lit(3.38), F.lit(51.5), F.lit(-0.13)).alias("k"), haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("n")).first()
    assert 4950 < km.k < 5050 and km.n is None
    mixes = [("same", p, k, 5) for p in ("base", "win") for k in "xy"] + [("apart", "base", "x", 3), ("apart", "win", "y", 3)] + [("some", p, k, n) for p, k, n in (("base", "x", 5), ("base", "y", 5), ("win", "x", 9), ("win", "y", 1))]
    d = {r.entity_id: r.jsd for r in mix_divergence(spark.createDataFrame(mixes, "entity_id string, period string, key string, n long")).collect()}
    assert d["same"] == pytest.approx(0, abs=1e-9) and d["apart"] == pytest.approx(1, abs=1e-9) and 0 < d["some"] < 1


# ------------------------------------------------------------------------------------------------------------ direction, flow
def test_orient(spark):
    acc = spark.createDataFrame([("X", "c"), ("X2", "c"), ("o", "d")], "account_id string, customer_id string")
    legs = orient(txns(spark, [("A", 1, "X", "o", 1), ("B", 2, "o", "X", 1), ("C", 3, "X", "X2", 1), ("D", 4, None, "X", 1), ("E", 5, "zz", "X", 1)]), acc)
    got = {(r.transaction_id, r.direction) for r in legs.filter("entity_id = 'c'").collect()}
    assert got == {("A", "out"), ("B", "in"), ("C", "internal"), ("D", "in"), ("E", "in")}


def legs_of(spark, rows):
    """rows: (id, seconds, direction, usd)"""
    return spark.createDataFrame([("c", "win", i, T0 + timedelta(seconds=s), s, d, float(u), "transfer", "completed", "other") for i, s, d, u in rows],
                                 "entity_id string, period string, transaction_id string, ts timestamp, sec long, direction string, amount_usd double, transaction_type string, status string, other_account string")


def test_pass_through_known_case(spark):
    d = 86400
    legs = legs_of(spark, [("I1", d + sec(10), "in", 100), ("I2", 2 * d + sec(10), "in", 100), ("O1", d + sec(12), "out", 90), ("O2", 5 * d + sec(12), "out", 100)])
    r = fifo.pass_through(legs, ["entity_id"], 24, ("transfer",)).first()
    assert (r.ratio, r.inbound_usd, r.n_inbound, r.pairs) == (0.45, 200.0, 2, ["I1", "O1"])


def test_dwell_known_cases(spark):
    r = fifo.fifo_dwell(legs_of(spark, [("I", 0, "in", 100), ("O1", 3600, "out", 60), ("O2", 30 * 3600, "out", 40)]), ["entity_id"], 24).first()
    assert (r.matched_usd, r.moved_ids, r.median_dwell_hours) == (60.0, ["O1"], 1.0)
    assert fifo.fifo_dwell(legs_of(spark, [("O", 0, "out", 50), ("I", 60, "in", 50)]), ["entity_id"], 24).first().matched_usd == 0.0


def brute_fifo(inc, out, horizon):
    """(credit, outflow, amount) of queue matching, row by row."""
    left, met = [a for _, a in inc], []
    for j, (t, need) in enumerate(out):
        for i, (ti, _) in enumerate(inc):
            if need > 0 and t - horizon <= ti <= t and left[i] > 0:
                take = min(need, left[i])
                left[i] -= take
                need -= take
                met.append((i, j, take))
    return met


def test_fifo_by_summaries_matches_brute_force(spark, monkeypatch):
    """Many small entities, and one with a third of all rows; days, walks and horizons are crossed."""
    monkeypatch.setattr(fifo, "WALK", 3)
    monkeypatch.setattr(fifo, "DAY", 60)
    rnd = random.Random(4)
    sizes = {f"e{i}": rnd.randrange(0, 14) for i in range(60)} | {"hot": 220}
    rows, want = [], {}
    for key, size in sizes.items():
        secs = rnd.sample(range(400), size)
        flows = sorted((s, rnd.choice(("in", "out")), float(rnd.randrange(1, 60)) + rnd.choice((0.0, 0.5))) for s in secs)
        flows += [(s, "out" if side == "in" else "in", usd / 2) for s, side, usd in flows[::5]]
        flows.sort()
        inc, out = [(s, u, f"{key}i{s}") for s, side, u in flows if side == "in"], [(s, u, f"{key}o{s}") for s, side, u in flows if side == "out"]
        rows += [(key, "win", i, T0, s, "in", u, "transfer", "completed", "x") for s, u, i in inc] + [(key, "win", i, T0, s, "out", u, "transfer", "completed", "x") for s, u, i in out]
        for hours in (40, 90):
            met = brute_fifo([x[:2] for x in inc], [x[:2] for x in out], hours)
            dwell = sorted(out[j][0] - inc[i][0] for i, j, _ in met)
            if flows:
                want[key, hours] = (round(sum(t for *_, t in met), 2), statistics.median(dwell) / 3600 if dwell else None, list(dict.fromkeys(out[j][2] for _, j, _ in met))[:10],
                                    [x for i, j, _ in met[:8] for x in (inc[i][2], out[j][2])], round(sum(u for _, u, _ in inc), 2), len(inc))
    legs = spark.createDataFrame(rows, "entity_id string, period string, transaction_id string, ts timestamp, sec long, direction string, amount_usd double, transaction_type string, status string, other_account string")
    for hours in (40, 90):
        dwell = {r.entity_id: r for r in fifo.fifo_dwell(legs, ["entity_id"], hours / 3600).collect()}
        assert set(dwell) == {k for k, h in want if h == hours}
        for k, r in dwell.items():
            assert (r.matched_usd, r.moved_ids) == (want[k, hours][0], want[k, hours][2])
            assert r.median_dwell_hours == pytest.approx(want[k, hours][1])
        through = {r.entity_id: r for r in fifo.pass_through(legs, ["entity_id"], hours / 3600, ("transfer",)).collect()}
        assert set(through) == {k for (k, h), w in want.items() if h == hours and w[5]}
        for k, r in through.items():
            assert (r.matched_usd, r.pairs, r.inbound_usd, r.n_inbound) == (want[k, hours][0], *want[k, hours][3:])


def test_travel(spark):
    rows = [("c", "T1", T0 + timedelta(hours=10), 6.52, 3.38, "pos"), ("c", "T2", T0 + timedelta(hours=11), 51.5, -0.13, "atm"), ("c", "T3", T0 + timedelta(hours=12), 6.52, 3.38, "web")]
    df = spark.createDataFrame(rows, "entity_id string, transaction_id string, ts timestamp, latitude double, longitude double, channel string").withColumn("sec", F.unix_seconds("ts"))
    assert [(r.prev_transaction_id, r.transaction_id) for r in det.travel_pairs(df, ["entity_id"], RiskRules()).collect()] == [("T1", "T2")]
    assert det.travel_pairs(df, ["entity_id"], RiskRules(), physical_only=False).count() == 2


# -------------------------------------------------------------------------------------------------------------- graph
def five_accounts(spark):
    d = datetime
    return spark.createDataFrame([("1", "2", 1, 1000.0, d(2026, 9, 1), d(2026, 9, 1)), ("2", "3", 1, 980.0, d(2026, 9, 2), d(2026, 9, 2)), ("3", "1", 1, 960.0, d(2026, 9, 3), d(2026, 9, 3)),
                                  ("4", "5", 2, 50.0, d(2026, 1, 1), d(2026, 1, 5))], "source string, target string, n long, total_usd double, first_ts timestamp, last_ts timestamp")


def test_small_graph(spark):
    e = five_accounts(spark)
    acc = spark.createDataFrame([(str(i), f"C{i}") for i in range(1, 6)], "account_id string, customer_id string")
    assert [r.cycle for r in g.candidate_cycles(e, 5, None).collect()] == [["1", "2", "3"]]
    assert g.candidate_cycles(e, 2, None).count() == 0 and g.candidate_cycles(e, 5, datetime(2026, 9, 2, 12)).count() == 0
    pairs = spark.createDataFrame([("1", "3"), ("1", "5")], "source string, target string")
    assert [(r.target, r.hops, r.path) for r in g.shortest_paths(e, pairs).collect()] == [("3", 2, ["1", "2", "3"])]
    assert {r.other for r in g.counterparties(e, acc, None).filter("customer_id = 'C1'").collect()} == {"2", "3"}
    use = spark.createDataFrame([("C1", "D"), ("C2", "D"), ("C3", "D"), ("C4", "E")], "customer_id string, device_id string")
    assert {(r.customer_id, r.n_customers) for r in g.shared_devices(use).collect()} == {("C1", 3), ("C2", 3), ("C3", 3)}


def test_betweenness_of_a_path(spark):
    inner = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "d")], "seed string, a string, b string")
    assert {r.id: r.centrality for r in g.betweenness(inner, spark.createDataFrame([("s", 4)], "seed string, size long")).collect()} == {"b": 0.6667, "c": 0.6667, "a": 0.0, "d": 0.0}


def test_cycle_needs_time_order(spark):
    rules = RiskRules()
    good = txns(spark, [("a", 1, "1", "2", 1000), ("b", 10, "2", "3", 900), ("c", 20, "3", "1", 850)])
    assert [(r.cycle, r.ids) for r in verified_cycles(good, T0, T0 + timedelta(days=9), rules).collect()] == [(["1", "2", "3"], ["a", "b", "c"])]
    bad = txns(spark, [("a", 1, "1", "2", 1000), ("b", 10, "2", "3", 300), ("c", 20, "3", "1", 280)])
    assert verified_cycles(bad, T0, T0 + timedelta(days=9), rules).count() == 0


def test_onward_chains_match_brute_force(spark):
    rnd = random.Random(5)
    for n, m in ((6, 14), (9, 30), (5, 20)):
        pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})
        rows = []
        for a, b in pairs:
            f = rnd.randrange(0, 50)
            rows.append((a, b, 1, float(rnd.choice((50, 200))), T0 + timedelta(hours=f), T0 + timedelta(hours=f + rnd.randrange(0, 10))))
        e = spark.createDataFrame(rows, "source long, target long, n long, total_usd double, first_ts timestamp, last_ts timestamp")
        big = [r for r in rows if r[3] >= 100 and r[0] != r[1]]
        want = {x[0] for x in big for y in big if y[0] == x[1] and y[1] != x[0] and y[5] >= x[4] for z in big if z[0] == y[1] and z[1] not in (x[0], x[1]) and z[5] >= y[4]}
        assert {r.account_id for r in onward_chains(e, 100, None).collect()} == want


# ---------------------------------------------------------------------------------------------------------------- gate
NOW = datetime(2026, 1, 15, 12)
BASE = {"transaction_id": "TXN-1", "timestamp": "2026-01-15 11:00:00", "sender_account_id": "ACC-1", "receiver_account_id": "ACC-2", "amount": "100.0", "currency": "USD", "transaction_type": "transfer", "channel": "web"}
CASES = [({}, None), ({"amount": None}, "MISSING_FIELD"), ({"amount": "abc"}, "INVALID_AMOUNT"), ({"amount": "Infinity"}, "INVALID_AMOUNT"), ({"amount": "-1"}, "NON_POSITIVE_AMOUNT"),
         ({"timestamp": "soon"}, "INVALID_TIMESTAMP"), ({"timestamp": "2001-01-01"}, "TIMESTAMP_OUT_OF_RANGE"), ({"currency": "US"}, "INVALID_CURRENCY"), ({"currency": "EUR"}, "UNSUPPORTED_CURRENCY"),
         ({"transaction_type": "gift"}, "INVALID_TYPE"), ({"channel": "fax"}, "INVALID_CHANNEL"), ({"status": "odd"}, "INVALID_STATUS"), ({"sender_account_id": None, "receiver_account_id": " "}, "NO_ACCOUNT"),
         ({"transaction_type": "deposit", "receiver_account_id": None}, "DIRECTION_MISMATCH"), ({"ip_address": "999.1.1.1"}, "INVALID_IP"), ({"ip_address": "fe80::1"}, None), ({"transaction_id": "X-1"}, "INVALID_ID_FORMAT"),
         ({"sender_account_id": "ACC-9"}, "UNKNOWN_ACCOUNT"), ({"sender_account_id": "ACC-3"}, "ACCOUNT_CLOSED"), ({"device_id": "DEV-9"}, "UNKNOWN_DEVICE"), ({"merchant_id": "MER-9"}, "UNKNOWN_MERCHANT"),
         ({"transaction_id": "TXN-50"}, "DUPLICATE_ID")]


def gate(spark, rows, stored_rows=(), rules=GateRules()):
    schema = "row long, " + ", ".join(f"{c} string" for c in dq.FIELDS)
    batch = spark.createDataFrame([(i, *[r.get(c) for c in dq.FIELDS]) for i, r in enumerate(rows)], schema)
    acc = spark.createDataFrame([("ACC-1", "active"), ("ACC-2", "active"), ("ACC-3", "closed")], "account_id string, status string")
    stored = spark.createDataFrame(list(stored_rows) or [("TXN-50", NOW - timedelta(days=3), "ACC-1", "ACC-2", 7.0, "USD")],
                                   "transaction_id string, ts timestamp, sender_account_id string, receiver_account_id string, amount double, currency string")
    return dq.gate(batch, acc, spark.createDataFrame([("DEV-1",)], "device_id string"), spark.createDataFrame([("MER-1",)], "merchant_id string"), stored, NOW, rules)


def test_every_reason_code(spark):
    rows = [{**BASE, "transaction_id": f"TXN-{100 + i}", "amount": f"{100 + i}.0", **change} for i, (change, _) in enumerate(CASES)]
    gated = gate(spark, rows)
    assert {r.row: r.code for r in gated.collect()} == {i: c for i, (_, c) in enumerate(CASES)}
    book = dq.ledger(gated).first()
    assert book.received == book.processed + book.rejected + book.failed == len(CASES)


def test_likely_duplicates_match_brute_force(spark):
    rnd = random.Random(6)
    start = NOW - timedelta(hours=5)
    rows = [{**BASE, "transaction_id": f"TXN-{i}", "timestamp": str(start + timedelta(seconds=rnd.randrange(0, 1500))), "amount": rnd.choice(("10.0", "10.0", "20.0"))} for i in range(120)]
    stored = [(f"TXN-{900 + i}", start + timedelta(seconds=rnd.randrange(0, 1500)), "ACC-1", "ACC-2", 10.0, "USD") for i in range(5)]
    seen = {10.0: [s[1] for s in stored], 20.0: []}
    want = set()
    for i, r in enumerate(rows):
        t, a = datetime.fromisoformat(r["timestamp"]), float(r["amount"])
        if any(abs((t - x).total_seconds()) <= 60 for x in seen[a]):
            want.add(i)
        else:
            seen[a].append(t)
    got = {r.row for r in gate(spark, rows, stored).filter("code = 'LIKELY_DUPLICATE'").collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("ip,ok", [("10.0.0.1", True), ("256.1.1.1", False), ("1.2.3", False), ("::1", True), ("::", True), ("1::2::3", False), ("2001:db8:0:0:0:0:0:1", True), ("1:2:3:4:5:6:7", False),
                                   ("::ffff:1.2.3.4", True), (":1:2:3:4:5:6:7:8", False), ("12345::", False), ("abc", False), (":::1", False), ("1:2:3:4:5:6:7::", True)])
def test_ip_addresses_agree_with_the_standard_library(spark, ip, ok):
    import ipaddress
    try:
        ipaddress.ip_address(ip)
        std = True
    except ValueError:
        std = False
    assert std == ok and spark.range(1).select(dq.valid_ip(F.lit(ip)).alias("v")).first().v == ok


# ------------------------------------------------------------------------------------------------ evaluation, retrieval
def test_evaluation_known_cases(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "truth boolean, predicted boolean")
    r = ev.rates(ev.confusion(rows)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.false_positive_rate) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    for scores, want in (((90.0, 10.0), 1.0), ((10.0, 90.0), 0.0), ((50.0, 50.0), 0.5)):
        df = spark.createDataFrame([(True, scores[0]), (False, scores[1])], "truth boolean, score double")
        assert ev.roc_auc(df).first().auc == want
    one = spark.createDataFrame([(True, 1.0)], "truth boolean, score double")
    assert ev.roc_auc(one).first().auc is None and ev.average_precision(one).first().average_precision is None


def test_keyword_search(spark):
    docs = spark.createDataFrame([("a", "rapid pass-through of funds by money mules"), ("b", "school fees and property deposits")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "mule funds")], "query_id long, text string")
    assert [r.doc_id for r in ret.bm25(docs, q).collect()] == ["a"]
    assert ret.bm25(docs, q, allowed=docs.filter("doc_id = 'b'").select("doc_id")).count() == 0


def test_vector_filter_and_latent_vectors(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0], "a"), ("y", [0.0, 1.0], "b")], "id string, embedding array<double>, type string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert ret.cosine_top_k(v, q, 1).first().id == "x" and ret.cosine_top_k(v.filter("type = 'b'"), q, 1).first().id == "y"
    texts = ["money mule transfers account", "mule account money flow", "school fee property deposit", "property deposit school loan", ""]
    vec = {r.doc_id: np.array(r.embedding) for r in ret.lsa(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 64).collect()}
    assert len(vec) == 5 and not vec[4].any() and vec[0] @ vec[1] > vec[0] @ vec[2]


def test_blocks_and_chunks(spark):
    md = "---\ntitle: x\n---\n# A\npara one\npara two\n\n- item\n  more\n\n## B\n| a | b |\n| 1 | 2 |\n> said\n"
    frame = lambda *texts: spark.createDataFrame([(f"D{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    b = sorted(doc.parse_markdown(frame(md)).collect(), key=lambda r: r.pos)
    assert [(x.kind, x.section) for x in b] == [("heading", "A"), ("paragraph", "A"), ("list", "A"), ("heading", "A > B"), ("table", "A > B"), ("quote", "A > B")]
    assert [x.text for x in b][1:3] == ["para one\npara two", "- item\nmore"] and [x.level for x in b] == [1, 0, 0, 2, 0, 0] and b[5].text == "said"
    text = "# T\n" + "\n\n".join(f"Sentence number {i} is here. And another one follows it." for i in range(60))
    chunks = sorted(doc.chunk_documents(frame(text)).collect(), key=lambda r: r.ordinal)
    assert len(chunks) > 2 and all(len(c.text) <= 1000 for c in chunks) and [c.ordinal for c in chunks] == list(range(len(chunks)))
    assert all(f"Sentence number {i} is" in " ".join(c.text for c in chunks) for i in range(60))
    deep = "### c\nx\n## b\ny\n# a\nz\n### d\nw"  # a higher heading closes the deeper ones
    assert [r.section for r in sorted(doc.parse_markdown(frame(deep)).collect(), key=lambda r: r.pos)] == ["c", "c", "b", "b", "a", "a", "a > d", "a > d"]


def test_chunks_follow_their_rule(spark):
    """Packing again, text by text: sections, long blocks, tables, overlaps."""
    def packs(items, limit, gap, carried=0):
        out = [[]]
        for x in items:
            room = limit - (carried if len(out) > 1 else 0)
            if out[-1] and len(gap.join([*out[-1], x])) > room:
                out.append([])
            out[-1].append(x)
        return [gap.join(p) for p in out if p]

    def tail(text, most):
        if len(text) <= most:
            return text
        parts = text[-most - 1:].split(None, 1)
        cut = text[-most - 1:]
        return "" if not any(c.isspace() for c in cut) else (parts[1] if not cut[0].isspace() and len(parts) > 1 else cut.lstrip() if cut[0].isspace() else "")

    rnd = random.Random(8)
    texts, want = [], {}
    for d in range(25):
        text, sections = "", []
        for h in range(rnd.randrange(1, 4)):
            text += f"# Head {h}\n\n"
            blocks = []
            for _ in range(rnd.randrange(0, 7)):
                block = " ".join(" ".join("w" * rnd.randrange(1, 12) for _ in range(rnd.randrange(1, 9))) + rnd.choice(".!?") for _ in range(rnd.randrange(1, 14)))
                blocks.append(block)
                text += block + "\n\n"
            sections.append((f"Head {h}", blocks))
        texts.append((d, text))
        n = 0
        for head, blocks in sections:
            units = [u for b in blocks for u in ([b] if len(b) <= 200 else packs([x for x in __import__("re").split(r"(?<=[.!?])\s+", b) if x], 200, " "))]
            own = packs(units, 200, "\n\n", 42)
            for k, body in enumerate(own):
                before = tail(own[k - 1], 40) if k else ""
                want[d, n] = head + "\n" + (before + "\n\n" if before else "") + body
                n += 1
    got = doc.chunk_documents(spark.createDataFrame(texts, "doc_id long, text string"), 200, 40).collect()
    assert {(r.doc_id, r.ordinal): r.text for r in got} == want and len(got) == len(want)


def test_claim_grounding(spark):
    claims = spark.createDataFrame([(1, 1, "Sent USD 100.00 on 2026-01-02 from ACC-1 [E1].", []), (1, 2, "Sent USD 500 [E1].", []), (1, 3, "He is a fraudster [E1].", []), (1, 4, "Insufficient evidence.", []),
                                    (1, 5, "See [E9].", []), (1, 6, "Freeze the account [E1].", []), (1, 7, "An analyst may freeze the account [E1].", [])], "case_id long, claim_id long, text string, citations array<string>")
    e = spark.createDataFrame([(1, "E1", "ACC-1 paid 100.5 on 2026-01-02")], "case_id long, ref string, content string")
    assert {r.claim_id: r.supported for r in doc.ground_claims(claims, e).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_triage_maxima_and_order(spark):
    assert sum(FACTORS.values()) == 100
    from riskloom.config import TriageRules
    cols = ("alert_id long, severity string, risk_score double, detector_id string, categories long, amount_usd double, txn_count long, occurrence_count long, network_points double, identity_signals long, "
            "prior_confirmed long, prior_cleared long, status string, triggered_at timestamp")
    top = (1, "critical", 100.0, "FAN_IN", 5, 1e6, 9, 9, 50.0, 3, 2, 0, "NEW", T0)
    low = (2, "low", 0.0, "NETWORK_EXPOSURE", 0, None, 0, 1, 0.0, 0, 0, 1, "RESOLVED", T0)
    r = {x.alert_id: x.new_score for x in triage(spark.createDataFrame([top, low], cols), T0 + timedelta(days=9), TriageRules()).collect()}
    assert r[1] == 100.0 and r[2] == 4.0 and math.isclose(sum(FACTORS.values()), 100)


def test_top_k_limits_groups_before_the_shuffle(spark):
    from riskloom.functions.numeric import top_k
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = top_k(df, ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_staged_parts_make_one_table(spark):
    from riskloom.session import stage_parts
    df = stage_parts(spark, [lambda i=i: spark.range(i, i + 2).toDF("x") for i in range(4)], "parts")
    assert sorted(r.x for r in df.collect()) == [0, 1, 1, 2, 2, 3, 3, 4]


class _ListState:
    """State of one key, held in the test."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Timers:
    def __init__(self):
        self.at = []

    def listTimers(self):
        return iter(list(self.at))

    def deleteTimer(self, at):
        self.at.remove(at)

    def registerTimer(self, at):
        self.at.append(at)


def test_burst_counts_the_window_before_an_arrival_only():
    import pandas as pd

    from riskloom.streaming.jobs import Burst
    p = Burst(60, 2)
    p.recent, p.handle = _ListState(), _Timers()
    feed = lambda *secs: pd.concat(list(p.handleInputRows((1,), iter([pd.DataFrame({"sec": [s], "cents": [100]}) for s in secs]), None)))
    assert len(feed(100_000)) == 0
    assert len(feed(100_000 - 14 * 3600)) == 0  # late, and alone in its own window
    assert feed(100_600, 99_000).in_window.tolist() == [3]
    assert p.handle.at == [(100_600 + 25 * 3600) * 1000]
    assert len(pd.concat(list(p.handleExpiredTimer((1,), None, None)))) == 0 and not p.recent.rows
    rich = Burst(60, 2, min_usd=2.5)
    rich.recent, rich.handle = _ListState(), _Timers()
    rows = lambda *x: pd.concat(list(rich.handleInputRows((1,), iter([pd.DataFrame(x, columns=["sec", "cents"])]), None)))
    assert len(rows((10, 100), (20, 100))) == 0 and rows((30, 100)).usd.tolist() == [3.0]


def test_streamed_pass_through_lets_credits_go_with_the_window():
    import pandas as pd

    from riskloom.streaming.jobs import PassThrough
    p = PassThrough(1, 3, 0.5, 1.0, 1)
    p.credits, p.handle = _ListState(), _Timers()

    def feed(*rows):
        r = pd.concat(list(p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["sec", "side", "cents"])]), None))).iloc[0]
        return r.inbound_usd, r.matched_usd, r.n_inbound, bool(r.flagged)

    assert feed((0, "in", 1000), (1800, "out", 600)) == (10.0, 6.0, 1, True)
    assert feed((3700, "out", 600)) == (10.0, 6.0, 1, True)  # the rest is too old to be drawn on
    assert feed((4000, "in", 3000), (3900, "in", 100)) == (41.0, 6.0, 3, False)  # a late credit takes its place
    assert feed((4100, "out", 50)) == (41.0, 6.5, 3, False)
    assert feed((11000, "in", 100)) == (32.0, 0.5, 3, False)  # the first credit has left the window
    assert p.handle.at == [(11000 + 3 * 3600) * 1000]
    list(p.handleExpiredTimer((7,), None, None))
    assert not p.credits.rows


def test_near_duplicate_state_keeps_order_of_late_rows():
    import pandas as pd

    from riskloom.streaming.jobs import NearDuplicates
    p = NearDuplicates(60)
    p.seen, p.handle = _ListState(), _Timers()

    def feed(*secs):
        rows = pd.DataFrame({"us": [s * 1_000_000 for s in secs], "transaction_id": range(len(secs))})
        return pd.concat(list(p.handleInputRows((1,), iter([rows]), None))).duplicate.tolist()

    assert feed(1000, 1030, 1100) == [False, True, False]
    assert feed(500, 1050) == [False, True]
    assert [t for t, in p.seen.rows] == [500_000_000, 1_000_000_000, 1_100_000_000]


def test_late_flags_are_the_same_when_a_batch_is_replayed(spark, tmp_path):
    from datetime import datetime

    from riskloom.config import GateRules
    from riskloom.streaming.jobs import late_rows
    run = late_rows(str(tmp_path / "store"), str(tmp_path / "sink"), GateRules())
    day = lambda d: spark.createDataFrame([(d, datetime(2024, 1, d)), (d + 1, datetime(2024, 1, d + 1))], "transaction_id long, ts timestamp")
    for batch, d in ((0, 1), (1, 9), (1, 9), (2, 4)):
        run(day(d), batch)
    got = {(r.batch, r.transaction_id): r.late for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert got == {(0, 1): False, (0, 2): False, (1, 9): False, (1, 10): False, (2, 4): True, (2, 5): True}


def test_append_new_is_read_back(spark, tmp_path):
    from datetime import datetime

    from riskloom.sources import dataset
    rows = lambda *ids: spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 3)) for i in ids], "transaction_id long, timestamp timestamp")
    dataset.write_tables({"transactions": rows(1, 2, 3)}, str(tmp_path))
    dataset.append_new(rows(3, 4, 5), str(tmp_path / "transactions"))
    assert sorted(r.transaction_id for r in spark.read.parquet(str(tmp_path / "transactions")).collect()) == [1, 2, 3, 4, 5]


def test_alert_state_is_versioned_by_batch(spark, tmp_path):
    """Two batches: the first creates, the second merges with new evidence; a repeated second batch changes nothing."""
    from riskloom.config import AlertPolicy, TriageRules
    from riskloom.operators import alerts as al
    from riskloom.streaming import jobs
    at = str(tmp_path)
    accounts = spark.createDataFrame([(10, 1), (20, 2)], "account_id long, customer_id long")
    none = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in al.STATE.items()))
    jobs.start_alerts(at, none, spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in al.CITES.items())))
    points = {0: 12.0, 1: 15.0}
    now = {"batch": 0}

    def assess(affected):
        n = now["batch"]
        ids = [r.customer_id for r in affected.collect()]
        cited = [(c, "FAN_IN", f"t{c}{k}") for c in ids for k in range(n + 1)]
        return {"contributions": spark.createDataFrame([(c, "FAN_IN", "fund_flow", 0.9, points[n]) for c in ids], "entity_id long, detector string, category string, strength double, points double"),
                "scores": spark.createDataFrame([(c, 60.0 + n, "high") for c in ids], "entity_id long, score double, band string"),
                "cited": spark.createDataFrame(cited, "customer_id long, detector_id string, transaction_id string"),
                "facts": spark.createDataFrame([(c, "FAN_IN", n + 1, 100.0, [f"t{c}0"], f"t{c}0", 10 * c) for c in ids],
                                               "customer_id long, detector_id string, txn_count long, amount_usd double, transaction_ids array<string>, first_transaction_id string, account_id long"),
                "amounts": spark.createDataFrame([(t, 100.0) for _, _, t in cited], "transaction_id string, amount_usd double")}

    run = jobs.alert_batches(accounts, assess, at, lambda n: T0 + timedelta(days=n), AlertPolicy(), TriageRules())
    rows = lambda *a: spark.createDataFrame([(x, None) for x in a], "sender_account_id long, receiver_account_id long")
    state = lambda n: sorted((r.customer_id, r.status, r.occurrence_count, r.risk_score, r.risk_contribution, r.txn_count, r.amount_usd, r.account_id, r.triage_priority, r.alert_id)
                             for r in jobs.alert_state(spark, at, n)[0].collect())
    run(rows(10, 20), 0)
    first = state(0)
    assert [r[:8] for r in first] == [(1, "NEW", 1, 60.0, 12.0, 1, 100.0, 10), (2, "NEW", 1, 60.0, 12.0, 1, 100.0, 20)]
    now["batch"] = 1
    run(rows(10), 1)
    second = state(1)
    assert [r[:8] for r in second] == [(1, "NEW", 2, 61.0, 15.0, 2, 200.0, 10), (2, "NEW", 1, 60.0, 12.0, 1, 100.0, 20)]
    assert [r[9] for r in second] == [r[9] for r in first]
    cites = lambda n: sorted((r.customer_id, r.transaction_id) for r in jobs.alert_state(spark, at, n)[1].collect())
    assert cites(1) == [(1, "t10"), (1, "t11"), (2, "t20")]
    run(rows(10), 1)
    assert state(1) == second and cites(1) == [(1, "t10"), (1, "t11"), (2, "t20")] and state(0) == first
    events = {(r.batch, r.customer_id, r.event) for r in spark.read.parquet(f"{at}/events").collect()}
    assert events >= {(0, 1, "created"), (0, 2, "created"), (1, 1, "updated")} and not any(b == 1 and e == "created" for b, _, e in events)
