"""Projection of the generated star-schema tables onto the bank domain.

The projection is deterministic arithmetic on the given rows, so that the number of domain rows grows with the tables.
`ORACLE` holds the same projection as SQL text for another engine.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import Period
from riskloom.session import tune

AS_OF = datetime(2024, 1, 31)
PERIOD = Period(AS_OF, lookback_days=10, baseline_days=20)


class Bank:
    """The domain tables over one folder; each is planned only when it is used."""

    def __init__(self, spark: SparkSession, folder: str, period: Period = PERIOD):
        self.spark, self.folder, self.period = tune(spark), folder, period

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = view(self.spark, self.folder, {"labels": "labels_"}.get(name, name))
        if name == "investigations":
            df = df.withColumn("signals", F.split("signal_list", ",")).drop("signal_list")
        if name == "labels":
            df = df.withColumn("expected_signals", F.expr("filter(split(expected_list, ','), x -> x <> '')")).drop("expected_list")
        setattr(self, name, df)
        return df


TXN = """
SELECT event_id AS transaction_id, {ts} AS ts,
  CASE WHEN event_id % 5 <> 0 THEN user_id END AS sender_account_id,
  CASE WHEN event_id % 7 <> 0 OR event_id % 5 = 0 THEN (user_id * 31 + event_id * 17 + 7) % (top_user + 1) END AS receiver_account_id,
  CASE WHEN event_type = 'purchase' THEN event_id % 97 END AS merchant_id,
  CASE WHEN event_id % 11 <> 0 THEN {device} END AS device_id,
  value AS amount, CASE WHEN event_id % 101 = 0 THEN 'EUR' ELSE 'USD' END AS currency, value AS amount_usd,
  CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'deposit' WHEN event_type = 'signup' THEN 'cash_withdrawal'
       WHEN event_type = 'purchase' THEN 'card_payment' ELSE 'transfer' END AS transaction_type,
  CASE event_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile' WHEN 2 THEN 'pos' WHEN 3 THEN 'atm' WHEN 4 THEN 'branch' ELSE 'api' END AS channel,
  concat('NATION_', CAST((user_id + CASE WHEN event_id % 41 = 0 THEN event_id % 25 ELSE 0 END) % 25 AS {text})) AS country,
  CASE WHEN event_id % 13 <> 0 THEN 5.0E0 * ((user_id + CASE WHEN event_id % 41 = 0 THEN event_id % 25 ELSE 0 END) % 25) - 60 END AS latitude,
  CASE WHEN event_id % 13 <> 0 THEN 13.5E0 * ((user_id + CASE WHEN event_id % 41 = 0 THEN event_id % 25 ELSE 0 END) % 25) - 170 END AS longitude,
  concat('10.', CAST(user_id % 200 AS {text}), '.', CAST(event_id % 5 AS {text}), '.', CAST(user_id % 250 AS {text})) AS ip_address,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_id % 7 = 0 AND event_id % 5 <> 0 THEN concat('EXT-', CAST(event_id % 23 AS {text}))
       WHEN event_id % 10 = 0 THEN concat('EXT-', CAST(event_id % 29 AS {text})) END AS external_counterparty
FROM {events}, (SELECT max(user_id) AS top_user FROM {events}) m
"""
CUSTOMERS = """
SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 4 = 0 THEN 'business' ELSE 'individual' END AS customer_type,
  c_mktsegment AS segment, concat('NATION_', CAST(c_nationkey AS {text})) AS country,
  5.0E0 * c_nationkey - 60 AS home_latitude, 13.5E0 * c_nationkey - 170 AS home_longitude,
  CASE WHEN c_custkey % 10 = 0 THEN 'high' ELSE 'low' END AS risk_profile, 'active' AS status, c_name AS name
FROM {customer}
"""
ACCOUNTS = """
SELECT c_custkey AS account_id, CASE WHEN c_custkey % 3 = 2 THEN c_custkey - 1 ELSE c_custkey END AS customer_id,
  CASE WHEN c_custkey % 20 = 3 THEN TIMESTAMP '2024-01-18 00:00:00' ELSE TIMESTAMP '2023-03-01 00:00:00' END AS opened_at,
  CASE WHEN c_custkey % 40 = 7 THEN 'closed' ELSE 'active' END AS status, c_acctbal AS balance
FROM {customer}
"""
MERCHANTS = """
SELECT s_suppkey AS merchant_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'retail' ELSE 'gaming' END AS category,
  concat('NATION_', CAST(s_nationkey AS {text})) AS country,
  CASE WHEN s_suppkey % 10 = 0 THEN 'high' WHEN s_suppkey % 3 = 0 THEN 'medium' ELSE 'low' END AS risk_profile
FROM {supplier}
"""
DEVICES = """
SELECT DISTINCT k AS device_id, CASE WHEN k % 2 = 0 THEN 'phone' ELSE 'laptop' END AS device_type,
  TIMESTAMP '2024-01-05 00:00:00' AS first_seen, TIMESTAMP '2024-01-06 00:00:00' AS last_seen
FROM (SELECT {device} AS k FROM {events}) e WHERE k < 90
"""
IDENTIFIERS = """
SELECT customer_id, identifier_type, {hash} AS value_hash, concat('***', CAST(k % 100 AS {text})) AS masked_value FROM (
  SELECT c_custkey AS customer_id, 'phone' AS identifier_type, CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS k FROM {customer}
  UNION ALL SELECT c_custkey, 'email', CASE WHEN c_custkey % 7 = 4 THEN c_custkey - 1 ELSE c_custkey END FROM {customer}
  UNION ALL SELECT c_custkey, 'address', CAST(floor(c_custkey / 4.0E0) AS BIGINT) FROM {customer}) x
"""
ALERTS = """
SELECT o_orderkey AS alert_id, o_custkey AS entity_id, 'customer' AS entity_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'FAN_IN' WHEN 1 THEN 'STRUCTURING' WHEN 2 THEN 'NEW_DEVICE' ELSE 'VELOCITY_SPIKE' END AS alert_type,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  floor(o_totalprice / 5000) * 1.0E0 AS risk_score, {order_ts} + INTERVAL '8400' DAY AS created_at,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 15 = 0 THEN 'open' WHEN o_orderstatus = 'P' THEN 'in_review' ELSE 'closed' END AS status
FROM {orders}
"""
INVESTIGATIONS = """
SELECT o_orderkey AS investigation_id, o_custkey AS subject_id, 'customer' AS subject_type,
  concat('analyst', CAST(o_orderkey % 5 AS {text})) AS assigned_to,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending_review' END AS status,
  {order_ts} + INTERVAL '8400' DAY AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN {order_ts} + INTERVAL '8405' DAY END AS closed_at,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'confirmed_suspicious' WHEN 1 THEN 'cleared' ELSE 'false_positive' END END AS conclusion,
  floor(o_totalprice / 5000) * 1.0E0 AS risk_score,
  CASE o_orderkey % 4 WHEN 0 THEN 'FAN_IN,FAN_OUT' WHEN 1 THEN 'STRUCTURING' WHEN 2 THEN 'NEW_DEVICE,FAN_IN' ELSE 'VELOCITY_SPIKE,NEW_DEVICE,STRUCTURING' END AS signal_list,
  concat('Order ', CAST(o_orderkey AS {text}), ' reviewed.') AS summary
FROM {orders} WHERE o_orderkey % 7 = 0
"""
LABELS = """
SELECT 'customer' AS entity_type, c_custkey AS entity_id,
  CASE c_custkey % 6 WHEN 0 THEN 'mule' WHEN 1 THEN 'structuring' WHEN 2 THEN 'account_takeover' ELSE 'normal' END AS scenario,
  c_custkey % 6 < 3 AS is_suspicious,
  CASE c_custkey % 6 WHEN 0 THEN 'FAN_IN,FAN_OUT' WHEN 1 THEN 'STRUCTURING' WHEN 2 THEN 'NEW_DEVICE' ELSE '' END AS expected_list
FROM {customer}
"""
# Monitoring alerts as they stand: mutable state, one row per alert.
MONITORING = """
SELECT o_orderkey AS alert_id, CASE WHEN o_custkey % 3 = 2 THEN o_custkey - 1 ELSE o_custkey END AS customer_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'FAN_IN' WHEN 1 THEN 'STRUCTURING' WHEN 2 THEN 'NEW_DEVICE' WHEN 3 THEN 'VELOCITY_SPIKE' ELSE 'FAN_OUT' END AS detector_id,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'INVESTIGATING' ELSE 'ESCALATED' END
       WHEN o_orderkey % 2 = 0 THEN 'NEW' ELSE 'TRIAGED' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'CONFIRMED_SUSPICIOUS' WHEN 1 THEN 'CLEARED' ELSE 'FALSE_POSITIVE' END END AS resolution,
  floor(o_totalprice / 5000) * 1.0E0 AS risk_score, floor(o_totalprice / 20000) * 1.0E0 AS risk_contribution,
  1 + o_orderkey % 4 AS occurrence_count,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(o_orderkey % 700 AS INT) AS triggered_at,
  CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(o_orderkey % 700 + o_orderkey % 90 AS INT) END AS resolved_at,
  CASE WHEN o_orderkey % 6 <> 0 THEN concat('analyst', CAST(o_orderkey % 5 AS {text})) END AS assigned_to,
  CASE WHEN o_orderkey % 8 = 1 THEN o_custkey END AS case_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice / 6000) * 1.0E0 END AS triage_score,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN floor(o_totalprice / 6000) >= 65 THEN 'CRITICAL' WHEN floor(o_totalprice / 6000) >= 50 THEN 'HIGH'
       WHEN floor(o_totalprice / 6000) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS triage_priority,
  concat('Order ', CAST(o_orderkey AS {text}), ' over 100% of plan_', CAST(o_orderkey % 9 AS {text})) AS description,
  CAST(o_orderkey % 4 AS BIGINT) AS categories, CASE WHEN o_orderkey % 3 = 0 THEN 4.5E0 ELSE 0.0E0 END AS network_points,
  CAST(o_orderkey % 3 AS BIGINT) AS identity_signals,
  CASE WHEN o_orderkey % 12 <> 5 THEN floor(o_totalprice / 5) * 1.0E0 END AS amount_usd, CAST(o_orderkey % 7 AS BIGINT) AS txn_count
FROM {orders}
"""
CASES = """
SELECT c_custkey AS case_id, c_custkey AS customer_id, concat('FC-2024-', CAST(c_custkey AS {text})) AS case_number,
  CASE c_custkey % 5 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'ESCALATED' WHEN 3 THEN 'PENDING_REVIEW' ELSE 'CLOSED' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority,
  concat('Review of ', c_name) AS title, CASE WHEN c_custkey % 4 <> 1 THEN concat('analyst', CAST(c_custkey % 5 AS {text})) END AS assigned_to,
  TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 300 AS INT) AS opened_at,
  CASE WHEN c_custkey % 5 = 4 THEN TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 300 + 30 AS INT) END AS closed_at,
  TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 311 AS INT) AS updated_at,
  CASE WHEN c_custkey % 5 = 4 THEN 'CONFIRMED_SUSPICIOUS' END AS decision
FROM {customer} WHERE c_custkey % 3 <> 2
"""
# Alert status changes as a log; lineitem has no unique key, so equal rows are told apart by all columns.
ALERT_EVENTS = """
SELECT l_orderkey AS alert_id, {ship_ts} + INTERVAL '1' HOUR * CAST(l_linenumber AS INT) AS ts,
  concat(CAST(l_partkey AS {text}), '-', CAST(l_suppkey AS {text}), '-', CAST(l_linenumber AS {text})) AS event_id,
  CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'TRIAGED' WHEN 2 THEN 'INVESTIGATING' WHEN 3 THEN 'ESCALATED' ELSE 'RESOLVED' END AS from_status,
  CASE l_partkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'TRIAGED' WHEN 2 THEN 'INVESTIGATING' WHEN 3 THEN 'ESCALATED' ELSE 'RESOLVED' END AS to_status,
  concat('analyst', CAST(l_suppkey % 5 AS {text})) AS actor
FROM {lineitem}
"""

# Incoming rows as text: the window's events, some with one fault, some sent twice half a minute apart.
BATCH = """
SELECT event_id * 2 + c AS row, event_id % 139 = 1 AS malformed,
  CASE WHEN event_id % 53 = 1 THEN NULL WHEN event_id % 59 = 1 THEN 'BAD-1' WHEN event_id % 61 = 1 THEN concat('TXN-', CAST(event_id % 500 AS {text}))
       ELSE concat('TXN-', CAST(event_id + c * 100000000 AS {text})) END AS transaction_id,
  CASE WHEN event_id % 67 = 1 THEN 'not a time' WHEN event_id % 71 = 1 THEN '2001-01-01 00:00:00' ELSE {iso} END AS timestamp,
  CASE WHEN event_id % 73 = 1 THEN '999999999999' WHEN event_id % 5 <> 0 THEN CAST(user_id AS {text}) END AS sender_account_id,
  CASE WHEN event_id % 7 <> 0 THEN CAST((user_id * 31 + event_id * 17 + 7) % (top_user + 1) AS {text}) END AS receiver_account_id,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 97 AS {text}) END AS merchant_id, CAST({device} AS {text}) AS device_id,
  CASE WHEN event_id % 79 = 1 THEN 'abc' WHEN event_id % 83 = 1 THEN '-5' WHEN event_id % 89 = 1 THEN 'inf' ELSE CAST(value AS {text}) END AS amount,
  CASE WHEN event_id % 97 = 1 THEN NULL WHEN event_id % 101 = 1 THEN 'US' WHEN event_id % 103 = 1 THEN 'EUR' WHEN event_id % 2 = 0 THEN 'gbp' ELSE 'USD' END AS currency,
  CASE WHEN event_id % 3 = 0 THEN CAST(value AS {text}) END AS amount_usd,
  CASE WHEN event_id % 107 = 1 THEN 'gift' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'deposit' WHEN event_type = 'purchase' THEN 'Card_Payment' ELSE 'transfer' END AS transaction_type,
  CASE WHEN event_id % 109 = 1 THEN 'fax' ELSE 'Web' END AS channel, 'NG' AS country, CAST(NULL AS {text}) AS latitude, CAST(NULL AS {text}) AS longitude,
  CASE WHEN event_id % 127 = 1 THEN '999.1.1.1' WHEN event_id % 131 = 1 THEN 'fe80::1' WHEN event_id % 137 = 1 THEN 'fe80::1::2' WHEN event_id % 4 = 0 THEN '10.1.2.3' END AS ip_address,
  CASE WHEN event_id % 113 = 1 THEN 'unknown' WHEN event_id % 3 <> 0 THEN 'Completed' END AS status, CAST(NULL AS {text}) AS external_counterparty
FROM (SELECT e.*, c, {ts} + INTERVAL '30' SECOND * CAST(c AS INT) AS sent FROM {events} e, (SELECT 0 AS c UNION ALL SELECT 1) k WHERE (c = 0 OR event_id % 29 = 2)) e,
  (SELECT max(user_id) AS top_user FROM {events}) m WHERE sent >= TIMESTAMP '2024-01-21 00:00:00'
"""

VIEWS = {"batch": BATCH, "txn": TXN, "customers": CUSTOMERS, "accounts": ACCOUNTS, "merchants": MERCHANTS, "devices": DEVICES,
         "identifiers": IDENTIFIERS, "alerts": ALERTS, "investigations": INVESTIGATIONS, "labels_": LABELS,
         "monitoring": MONITORING, "cases": CASES, "alert_events": ALERT_EVENTS}
SPARK_WORDS = {"ts": "CAST(ts AS TIMESTAMP)", "device": "CAST(get_json_object(props, '$.k') AS BIGINT)", "text": "STRING",
               "hash": "sha2(concat(identifier_type, ':', CAST(k AS STRING)), 256)",
               "order_ts": "CAST(o_orderdate AS TIMESTAMP)", "ship_ts": "CAST(l_shipdate AS TIMESTAMP)",
               "iso": "date_format(sent, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"}
ORACLE_WORDS = {"ts": "CAST(ts AS TIMESTAMP)", "device": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
                "text": "VARCHAR", "hash": "sha256(concat(identifier_type, ':', CAST(k AS VARCHAR)))",
                "order_ts": "CAST(o_orderdate AS TIMESTAMP)", "ship_ts": "CAST(l_shipdate AS TIMESTAMP)",
                "iso": "strftime(sent, '%Y-%m-%d %H:%M:%S.%f')"}
TABLES = ("events", "customer", "supplier", "orders", "lineitem")


def oracle_view(name: str) -> str:
    """The projection `name` as SQL text over the registered tables."""
    return VIEWS[name].format(**ORACLE_WORDS, **{t: t for t in TABLES}).strip()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = VIEWS[name]
    words = {t: "{" + t + "}" for t in TABLES}
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.format(**SPARK_WORDS, **words), **used)
