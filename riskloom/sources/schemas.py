"""Explicit schemas of the dataset tables (never inferred)."""
from __future__ import annotations

TRANSACTIONS = (
    "transaction_id string, timestamp timestamp, sender_account_id string, receiver_account_id string, "
    "merchant_id string, device_id string, amount double, currency string, amount_usd double, transaction_type string, "
    "channel string, country string, latitude double, longitude double, ip_address string, status string, "
    "external_counterparty string")
CUSTOMERS = (
    "customer_id string, customer_type string, segment string, created_at timestamp, country string, home_city string, "
    "home_latitude double, home_longitude double, risk_profile string, status string, kyc_level int")
IDENTIFIERS = "customer_id string, identifier_type string, value_hash string, masked_value string"
ACCOUNTS = ("account_id string, customer_id string, account_type string, currency string, opened_at timestamp, "
            "status string, balance decimal(18,2)")
MERCHANTS = ("merchant_id string, name string, category string, country string, city string, latitude double, "
             "longitude double, risk_profile string")
DEVICES = "device_id string, device_type string, fingerprint string, first_seen timestamp, last_seen timestamp"
ALERTS = ("alert_id string, entity_id string, entity_type string, alert_type string, severity string, "
          "risk_score double, created_at timestamp, status string")
INVESTIGATIONS = ("investigation_id string, subject_id string, subject_type string, assigned_to string, status string, "
                  "created_at timestamp, closed_at timestamp, conclusion string, signals string, summary string")
LABELS = ("entity_type string, entity_id string, scenario string, is_suspicious boolean, window_start timestamp, "
          "window_end timestamp, expected_signals string, related_entities string, notes string")

DATASET = {"transactions": TRANSACTIONS, "customers": CUSTOMERS, "customer_identifiers": IDENTIFIERS,
           "accounts": ACCOUNTS, "merchants": MERCHANTS, "devices": DEVICES, "alerts": ALERTS,
           "investigations": INVESTIGATIONS, "scenario_labels": LABELS}
ARRAY_COLUMNS = {"investigations": ("signals",), "scenario_labels": ("expected_signals", "related_entities")}
