"""Queries over scores, explanations and evidence."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.config import (CATEGORY_LABELS, DETECTORS, EVALUATION_ORDER, GROUP_CAPS, TRIAL_RULES, WEIGHTS)
from riskloom.functions.numeric import lookup
from riskloom.operators import anomaly as an
from riskloom.operators import detectors as det
from riskloom.operators import scoring as sc
from riskloom.operators.orient import legs_for
from riskloom.plans import risk
from riskloom.plans.registry import oracle, query
from riskloom.session import stage
from riskloom.sources.generated import Bank

# every rule has SQL text; all scoring queries run over all of them
COMMON = tuple(n for n in EVALUATION_ORDER if n in risk.SQL)
VIEWS_USED = "recursive legs customers merchants identifiers alerts investigations"
DORMANT_COMMON = oracle("txn", risk.verdict(risk.dormant_sql(TRIAL_RULES.dormant_days, TRIAL_RULES.dormant_usd)))
SHARED_PARTS = risk.PASS.strip() + ",\n" + risk.CYCLES.strip() + ",\n" + risk.gaps_sql("{bs}", "{ws}")


def body_of(name: str) -> str:
    """The rule's SELECT alone: the text after the CTEs of its oracle."""
    text = DORMANT_COMMON if name == "DORMANT_REACTIVATION" else risk.SQL[name][1]
    return text[text.index("\nSELECT entity_id, CASE WHEN") + 1:]


def case(column: str, table: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {repr(v) if isinstance(v, str) else v}" for k, v in table.items() if v is not None) + f" ELSE {default} END"


PLACE = {n: i for i, n in enumerate(EVALUATION_ORDER)}



def results_sql(names) -> str:
    return "results AS MATERIALIZED (" + "\nUNION ALL ".join(f"SELECT '{n}' AS detector, r.* FROM ({body_of(n)}) r" for n in names) + ")"


SCORING = f"""fired AS (SELECT *, {case('detector', {k: float(v[0]) for k, v in WEIGHTS.items()})}::DOUBLE AS weight, {case('detector', {k: v[1] for k, v in WEIGHTS.items()})} AS grp,
  {case('detector', PLACE)} AS place, {case('detector', {d[0]: d[2] for d in DETECTORS})} AS category FROM results WHERE state = 'fired'),
raw AS (SELECT *, floor(weight * strength * 100 + 0.5) / 100 AS raw_points, {case('grp', GROUP_CAPS)}::DOUBLE AS cap FROM fired),
contrib AS MATERIALIZED (SELECT *, CASE WHEN cap IS NULL THEN raw_points ELSE floor((least(cap, spent) - least(cap, round(spent - raw_points, 2))) * 100 + 0.5) / 100 END AS points FROM (
  SELECT *, CAST(sum(CAST(raw_points AS DECIMAL(18,2))) OVER (PARTITION BY entity_id, grp ORDER BY raw_points DESC, place ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM raw) x),
scores AS MATERIALIZED (SELECT e.entity_id, floor(least(100.0, coalesce(s, 0)) * 10 + 0.5) / 10 AS score, coalesce(n, 0) AS n_fired FROM (SELECT DISTINCT customer_id AS entity_id FROM accounts) e
  LEFT JOIN (SELECT entity_id, CAST(sum(CAST(points AS DECIMAL(18,2))) AS DOUBLE) AS s, count(*) AS n FROM contrib GROUP BY 1) p ON p.entity_id = e.entity_id),
cats AS (SELECT entity_id, category, CAST(sum(CAST(points AS DECIMAL(18,2))) AS DOUBLE) AS points FROM contrib GROUP BY 1, 2)"""
SCORED = SHARED_PARTS + ",\n" + results_sql(COMMON) + ",\n" + SCORING
BAND = "CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END"


def common(b: Bank) -> sc.Assessment:
    legs = stage(legs_for(b.txn, b.accounts, b.period), "legs")
    return sc.assess(risk.frames(b, legs=legs))


@query("sc01_group_caps", oracle(VIEWS_USED, "SELECT entity_id, detector, raw_points, points, points < raw_points AS capped FROM contrib", SCORED))
def _(b):
    return common(b).contributions.select("entity_id", "detector", "raw_points", "points", "capped")


@query("w04_capped_running_sum", oracle(VIEWS_USED, "SELECT entity_id, grp, CAST(sum(CAST(points AS DECIMAL(18,2))) AS DOUBLE) AS spent, any_value(cap) AS cap FROM contrib WHERE cap IS NOT NULL GROUP BY 1, 2", SCORED))
def _(b):
    """Points each group of rules spends of its cap."""
    c = common(b).contributions.filter("grp IS NOT NULL")
    return c.groupBy("entity_id", "grp").agg(sc.points_sum().alias("spent")).withColumn("cap", lookup(F.col("grp"), GROUP_CAPS).cast("double"))


@query("sc02_category_breakdown", oracle(VIEWS_USED, """
SELECT entity_id, category, points FROM cats UNION ALL
SELECT s.entity_id, 'cap_adjustment', round(s.score - t.p, 2) FROM scores s JOIN (SELECT entity_id, CAST(sum(CAST(points AS DECIMAL(18,2))) AS DOUBLE) AS p FROM contrib GROUP BY 1) t
  ON t.entity_id = s.entity_id WHERE abs(round(s.score - t.p, 2)) >= 0.05""", SCORED))
def _(b):
    return common(b).categories.select("entity_id", "category", "points")


@query("sc03_band_and_flag", oracle(VIEWS_USED, f"SELECT entity_id, score, {BAND} AS band, score >= 40 AS flagged, n_fired FROM scores", SCORED))
def _(b):
    return common(b).scores


@query("sc04_data_quality_notes", oracle("legs", """
SELECT entity_id, concat_ws('; ', CASE WHEN nb < 5 THEN concat('thin baseline: ', nb, ' outbound transactions') END, CASE WHEN nw = 0 THEN 'no transactions in the window' END) AS notes FROM (
  SELECT entity_id, count(*) FILTER (direction = 'out' AND period = 'base') AS nb, count(*) FILTER (direction <> 'internal' AND period = 'win') AS nw FROM legs GROUP BY 1) a"""))
def _(b):
    legs = legs_for(b.txn, b.accounts, b.period)
    return sc.data_quality_notes(det.baseline_activity(legs), TRIAL_RULES).select("entity_id", F.array_join("notes", "; ").alias("notes"))


@query("sc05_explanation", oracle(VIEWS_USED, f"""
SELECT s.entity_id, CASE WHEN r.t IS NULL THEN format('Score {{:.1f}} ({{}}): no rule crossed its threshold.', score, {BAND})
  ELSE format('Score {{:.1f}} ({{}}), {{}} the investigation threshold of 40. Largest: {{}}. Categories: {{}}.', score, {BAND}, CASE WHEN score >= 40 THEN 'above' ELSE 'below' END, r.t, c.t) END AS explanation
FROM scores s LEFT JOIN (SELECT entity_id, string_agg(format('{{}} +{{:.1f}}', detector, floor(points * 10 + 0.5) / 10), ', ' ORDER BY points DESC, place) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY points DESC, place) AS rn FROM contrib) x WHERE rn <= 4 GROUP BY 1) r ON r.entity_id = s.entity_id
LEFT JOIN (SELECT entity_id, string_agg(format('{{}} {{:.1f}}', {case('category', CATEGORY_LABELS)}, floor(points * 10 + 0.5) / 10), ', ' ORDER BY points DESC, category) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY points DESC, category) AS rn FROM cats) x WHERE rn <= 3 GROUP BY 1) c ON c.entity_id = s.entity_id""", SCORED))
def _(b):
    a = common(b)
    return sc.explanations(a.contributions, a.scores, a.categories, TRIAL_RULES)


@query("sc07_detector_table", oracle(VIEWS_USED, f"""
SELECT e.entity_id, d.detector, coalesce(r.state, '') = 'fired' AS triggered, coalesce(c.points, 0) AS points,
  CASE r.state WHEN 'fired' THEN 'triggered' WHEN 'not_evaluated' THEN 'not evaluated' WHEN 'below_threshold' THEN 'below threshold' ELSE 'no data' END AS reason,
  CASE WHEN r.state = 'fired' THEN CASE WHEN r.strength >= 0.85 THEN 'high' WHEN r.strength >= 0.65 THEN 'medium' ELSE 'low' END END AS severity
FROM (SELECT DISTINCT customer_id AS entity_id FROM accounts) e CROSS JOIN (SELECT unnest([{', '.join(repr(d[0]) for d in DETECTORS)}]) AS detector) d
LEFT JOIN results r ON r.entity_id = e.entity_id AND r.detector = d.detector LEFT JOIN contrib c ON c.entity_id = e.entity_id AND c.detector = d.detector""", SCORED))
def _(b):
    a = common(b)
    t = sc.detector_table(a.results, a.contributions, a.scores)
    return t.select("entity_id", "detector", "triggered", "points", "reason", "severity")




def cited_rows(rule: str, rows: str, order: str, k: int, start: int = 0) -> str:
    """SQL of the first `k` of `rows` (l) that support each customer flagged by `rule` (r)."""
    return f"""SELECT entity_id, detector, transaction_id, {start} + rn AS pos FROM (SELECT r.entity_id, r.detector, l.transaction_id, row_number() OVER (PARTITION BY r.entity_id ORDER BY {order}) AS rn
  FROM results r JOIN {rows} WHERE r.detector = '{rule}' AND r.state = 'fired') x WHERE rn <= {k}"""


_OWN = "legs l ON l.entity_id = r.entity_id AND period = 'win'"
_TIME = "ts, transaction_id"
_BAND = """(direction = 'out' OR (direction = 'in' AND other_account IS NULL)) AND status = 'completed'
      AND transaction_type IN ('cash_withdrawal', 'transfer', 'deposit') AND amount_usd >= 30 AND amount_usd < 100"""
_LARGE = f"{_OWN} AND direction = 'out' AND status = 'completed' AND amount_usd >= r.threshold - 1e-6"
EVIDENCE = ("""
bursts AS (SELECT entity_id, min(start_sec) AS t_at FROM (SELECT *, max(max_count) OVER (PARTITION BY entity_id) AS top FROM (""" + risk.ROLL_SQL + """) q WHERE period = 'win') z WHERE max_count = top GROUP BY 1),
peaks AS (SELECT entity_id, arg_max(day, struct_pack(c := c, d := -date_diff('day', DATE '2000-01-01', day))) AS day FROM (
  SELECT entity_id, CAST(ts AS DATE) AS day, count(*) AS c FROM legs WHERE period = 'win' AND direction = 'out' GROUP BY 1, 2) z GROUP BY 1),
banded_at AS (SELECT * FROM (SELECT entity_id, sec AS t_at, row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, s DESC, sec DESC) AS rn FROM (
    SELECT entity_id, sec, count(*) OVER w AS c, sum(CAST(amount_usd AS DECIMAL(18,2))) OVER w AS s FROM legs WHERE period = 'win' AND """ + _BAND + """
    WINDOW w AS (PARTITION BY entity_id ORDER BY sec RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING)) a) z WHERE rn = 1),
fresh AS (SELECT entity_id, device_id FROM legs WHERE direction = 'out' AND device_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (period = 'base') = 0 AND count(*) FILTER (period = 'win') > 0),
woken AS (SELECT customer_id AS entity_id, arg_max(account_id, struct_pack(u := usd, g := gap, a := account_id)) AS account_id FROM gaps WHERE gap >= """ + f"{TRIAL_RULES.dormant_days} AND usd >= {TRIAL_RULES.dormant_usd}" + """ GROUP BY 1),
rounds AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY cycle) AS rank FROM (
  SELECT DISTINCT a.customer_id AS entity_id, c.cycle, c.ids FROM (SELECT cycle, ids, unnest(cycle) AS account_id FROM best) c JOIN accounts a ON a.account_id = c.account_id) z),
cited AS MATERIALIZED (
""" + "\nUNION ALL ".join([
    cited_rows("TRANSACTION_BURST", f"bursts b ON b.entity_id = r.entity_id JOIN {_OWN} AND direction = 'out' AND sec BETWEEN t_at AND t_at + 3600", _TIME, 10),
    cited_rows("VELOCITY_SPIKE", f"peaks b ON b.entity_id = r.entity_id JOIN {_OWN} AND direction = 'out' AND CAST(ts AS DATE) = b.day", _TIME, 10),
    cited_rows("AMOUNT_DEVIATION", _LARGE, "amount_usd DESC, transaction_id", 10),
    cited_rows("PEER_AMOUNT_DEVIATION", _LARGE, "amount_usd DESC, transaction_id", 10),
    cited_rows("FAN_IN", f"{_OWN} AND direction = 'in'", _TIME, 12),
    cited_rows("FAN_OUT", f"{_OWN} AND direction = 'out' AND status = 'completed' AND transaction_type = 'transfer'", _TIME, 12),
    cited_rows("STRUCTURING", f"banded_at b ON b.entity_id = r.entity_id JOIN {_OWN} AND {_BAND} AND sec BETWEEN t_at AND t_at + 172800", _TIME, 10),
    cited_rows("GEO_NEW_COUNTRY", f"""customers c ON c.customer_id = r.entity_id JOIN {_OWN} AND l.country IS NOT NULL AND l.country <> c.country AND NOT EXISTS (SELECT 1 FROM legs b WHERE b.entity_id = l.entity_id
    AND b.country = l.country AND b.period = 'base' AND b.direction <> 'internal')""", _TIME, 10),
    cited_rows("NEW_DEVICE", f"fresh b ON b.entity_id = r.entity_id JOIN {_OWN} AND direction = 'out' AND l.device_id = b.device_id", _TIME, 8, 5),
    cited_rows("HIGH_RISK_MERCHANT", f"{_OWN} AND direction = 'out' AND status = 'completed' AND merchant_id IN (SELECT merchant_id FROM merchants WHERE risk_profile = 'high')", _TIME, 10, 5),
    cited_rows("DORMANT_REACTIVATION", "woken b ON b.entity_id = r.entity_id JOIN txn l ON (l.sender_account_id = b.account_id OR l.receiver_account_id = b.account_id) AND l.ts >= {ws} AND l.ts <= {we}", _TIME, 10),
    """SELECT entity_id, detector, unnest([pid, transaction_id]) AS transaction_id, unnest([2 * rn - 1, 2 * rn]) AS pos FROM (SELECT r.entity_id, r.detector, p.pid, p.transaction_id,
    row_number() OVER (PARTITION BY r.entity_id ORDER BY l.ts, l.transaction_id) AS rn FROM results r JOIN (""" + risk.PAIRS + """) p ON p.entity_id = r.entity_id
  JOIN legs l ON l.entity_id = p.entity_id AND l.transaction_id = p.transaction_id AND l.direction = 'out' WHERE r.detector = 'IMPOSSIBLE_TRAVEL' AND r.state = 'fired') x WHERE rn <= 5""",
    """SELECT entity_id, detector, CAST(unnest([in_id, out_id]) AS BIGINT) AS transaction_id, unnest([2 * rn - 1, 2 * rn]) AS pos FROM (SELECT r.entity_id, r.detector, in_id, out_id,
    row_number() OVER (PARTITION BY r.entity_id ORDER BY place) AS rn FROM results r JOIN sl ON sl.entity_id = r.entity_id AND period = 'win' WHERE r.detector = 'RAPID_PASS_THROUGH' AND r.state = 'fired') x WHERE rn <= 8""",
    """SELECT entity_id, detector, transaction_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS n FROM (
    SELECT r.entity_id, r.detector, rank * 8 + unnest(range(0, len(ids) + 1)) AS pos, unnest(list_prepend(NULL, ids)) AS transaction_id FROM results r
    JOIN rounds b ON b.entity_id = r.entity_id AND rank <= 5 WHERE r.detector = 'CIRCULAR_FLOW' AND r.state = 'fired') x) y WHERE n <= 25 AND transaction_id IS NOT NULL""",
]) + ")")


def cited(b: Bank) -> DataFrame:
    f, a = full(b)
    return sc.evidence(f, a.results)


@query("sc06_supporting_transactions", oracle(VIEWS_USED, f"""
SELECT entity_id, CAST(transaction_id AS VARCHAR) AS transaction_id, row_number() OVER (PARTITION BY entity_id ORDER BY o, CAST(transaction_id AS VARCHAR)) AS rank FROM (
  SELECT entity_id, transaction_id, min({case('detector', PLACE)} * 100 + pos) AS o FROM cited GROUP BY 1, 2) x""", SCORED + "," + EVIDENCE))
def _(b):
    return sc.supporting_transactions(cited(b))


@query("sc08_most_cited_transactions", oracle(VIEWS_USED, """
SELECT * FROM (SELECT c.entity_id, CAST(c.transaction_id AS VARCHAR) AS transaction_id, t.amount_usd, n_signals, signals,
    row_number() OVER (PARTITION BY entity_id ORDER BY n_signals DESC, t.amount_usd DESC, CAST(c.transaction_id AS VARCHAR) DESC) AS rank FROM (
  SELECT entity_id, transaction_id, count(DISTINCT detector) AS n_signals, string_agg(DISTINCT detector, ',' ORDER BY detector) AS signals FROM cited GROUP BY 1, 2) c
  JOIN txn t ON t.transaction_id = c.transaction_id) z WHERE rank <= 5""", SCORED + "," + EVIDENCE))
def _(b):
    return sc.most_cited(cited(b), b.txn)


@query("sc09_account_assessment", oracle("legs", risk.verdict(risk.BURST)).replace("so.customer_id = ro.customer_id", "so.account_id = ro.account_id")
       .replace("so.customer_id AS entity_id", "so.account_id AS entity_id").replace("'in', ro.customer_id", "'in', ro.account_id")
       .replace("so.customer_id IS DISTINCT FROM ro.customer_id", "so.account_id IS DISTINCT FROM ro.account_id"))
def _(b):
    """The same rule with every account as its own entity."""
    return risk.shown(det.burst(risk.frames(b, grain="account")))


def full(b: Bank) -> tuple[det.Frames, sc.Assessment]:
    f = risk.frames(b, legs=stage(legs_for(b.txn, b.accounts, b.period), "legs"))
    return f, sc.assess(f)


@query("sc00_evidence_dormant", oracle("txn accounts", """
SELECT entity_id, 0 AS pos, 'account' AS kind, CAST(account_id AS VARCHAR) AS id FROM hit UNION ALL
SELECT entity_id, CAST(n AS INTEGER), 'transaction', CAST(transaction_id AS VARCHAR) FROM (
  SELECT h.entity_id, t.transaction_id, row_number() OVER (PARTITION BY h.entity_id ORDER BY t.ts, t.transaction_id) AS n FROM hit h
  JOIN txn t ON (t.sender_account_id = h.account_id OR t.receiver_account_id = h.account_id) AND t.ts >= TIMESTAMP '2024-01-28 00:00:00' AND t.ts <= {we}) x WHERE n <= 10""",
       risk.GAPS + """, hit AS (SELECT customer_id AS entity_id, account_id FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY usd DESC, gap DESC, account_id DESC) AS rn FROM gaps WHERE gap >= 1.5 AND usd >= 20) z WHERE rn = 1)"""))
def _(b):
    """The reactivated account itself and its own rows, for every customer that the rule flags."""
    f = risk.frames(b, risk.DORMANT_RULES, risk.DORMANT_PERIOD)
    return sc.evidence(f, det.dormant(f).withColumn("detector", F.lit("DORMANT_REACTIVATION")), ("DORMANT_REACTIVATION",)).drop("detector")


@query("sc00_evidence_device_sharing", oracle("legs", """
SELECT entity_id, CAST(pos AS INTEGER) AS pos, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS place FROM (
  SELECT entity_id, d * 9 AS pos, 'device' AS kind, CAST(device_id AS VARCHAR) AS id FROM mine UNION ALL
  SELECT entity_id, d * 9 + n, 'customer', CAST(customer_id AS VARCHAR) FROM (
    SELECT m.entity_id, m.d, u.customer_id, row_number() OVER (PARTITION BY m.entity_id, m.d ORDER BY u.customer_id) AS n
    FROM mine m JOIN users u ON u.device_id = m.device_id AND u.customer_id <> m.entity_id) x WHERE n <= 8) y) z WHERE place <= 25""", """
users AS (SELECT DISTINCT t.device_id, a.customer_id FROM txn t JOIN accounts a ON a.account_id = t.sender_account_id WHERE t.device_id IS NOT NULL AND ts >= {bs} AND ts <= {we}),
shared AS (SELECT device_id, count(*) AS c FROM users GROUP BY 1 HAVING count(*) >= 3),
mine AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, device_id) AS d FROM (
  SELECT DISTINCT l.entity_id, l.device_id, s.c FROM legs l JOIN shared s ON s.device_id = l.device_id WHERE l.direction = 'out' AND l.period = 'win') q)"""))
def _(b):
    """Every shared device with up to eight of its other users."""
    f = risk.frames(b)
    return sc.evidence(f, det.device_sharing(f).withColumn("detector", F.lit("DEVICE_SHARING")), ("DEVICE_SHARING",)).drop("detector")


@query("sc01_scores", oracle(VIEWS_USED, f"SELECT entity_id, score, {BAND} AS band, score >= 40 AS flagged, n_fired FROM scores", SCORED))
def _(b):
    """All rules, all customers."""
    return full(b)[1].scores


@query("sc00_scores_with_model")
def _(b):
    """All rules and the anomaly model, whose features are the rules' own results."""
    f, a = full(b)
    rows = stage(an.features(f, a.results), "features")
    model = an.anomaly_results(an.percentiles(an.score(rows, *an.train(rows))), f.rules.anomaly_percentile)
    results = a.results.unionByName(model.select(*a.results.columns))
    return sc.scores(sc.contributions(results), sc.entities(f), f.rules)


@query("sc00_account_scores")
def _(b):
    f = risk.frames(b, grain="account", legs=stage(legs_for(b.txn, b.accounts, b.period, "account"), "legs"))
    return sc.assess(f).scores


@query("sc00_contributions_with_confidence", oracle(VIEWS_USED, f"""
SELECT c.entity_id, detector, points, CASE WHEN detector = 'CIRCULAR_FLOW' THEN 0.9 WHEN detector = 'HISTORICAL_ALERTS' THEN 0.7 WHEN detector = 'NEW_DEVICE' AND baseline = 0 THEN 0.5
  WHEN coalesce(n, 0) < {TRIAL_RULES.thin_baseline} THEN 0.6 WHEN detector = 'NEW_DEVICE' THEN 0.85 ELSE 0.9 END AS confidence
FROM contrib c LEFT JOIN (SELECT entity_id, count(*) FILTER (direction = 'out' AND period = 'base') AS n FROM legs GROUP BY 1) a ON a.entity_id = c.entity_id""", SCORED))
def _(b):
    a = full(b)[1]
    return sc.with_confidence(a.contributions, a.activity, TRIAL_RULES).select("entity_id", "detector", "points", "confidence")


@query("sc00_all_evidence")
def _(b):
    f, a = full(b)
    return sc.evidence(f, a.results)
