"""Thresholds, weights and policies. Plain frozen dataclasses; plans turn them into literals."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

# ---- fixed values: detector catalogue (id, name, category, tier), in catalogue order ----------------------------
DETECTORS: tuple[tuple[str, str, str, str], ...] = (
    ("TRANSACTION_BURST", "Transaction burst", "transaction_behaviour", "standalone"),
    ("VELOCITY_SPIKE", "Velocity spike", "transaction_behaviour", "supporting"),
    ("AMOUNT_DEVIATION", "Unusual amount", "transaction_behaviour", "supporting"),
    ("PEER_AMOUNT_DEVIATION", "Unusual amount vs peers", "transaction_behaviour", "supporting"),
    ("STRUCTURING", "Structuring", "transaction_behaviour", "standalone"),
    ("HIGH_RISK_MERCHANT", "High-risk merchant", "transaction_behaviour", "standalone"),
    ("DORMANT_REACTIVATION", "Dormant account activation", "transaction_behaviour", "standalone"),
    ("BEHAVIOURAL_SHIFT", "Behavioural shift", "transaction_behaviour", "context"),
    ("RAPID_PASS_THROUGH", "Rapid movement of funds", "fund_flow", "standalone"),
    ("FAN_IN", "Fan-in", "fund_flow", "standalone"),
    ("FAN_OUT", "Fan-out", "fund_flow", "standalone"),
    ("CIRCULAR_FLOW", "Circular flow", "fund_flow", "standalone"),
    ("GEO_NEW_COUNTRY", "New country", "geographic", "supporting"),
    ("IMPOSSIBLE_TRAVEL", "Impossible travel", "geographic", "standalone"),
    ("NEW_DEVICE", "New device", "device_identity", "supporting"),
    ("DEVICE_SHARING", "Device sharing", "device_identity", "standalone"),
    ("SHARED_IDENTIFIER", "Shared identifier", "device_identity", "supporting"),
    ("NETWORK_EXPOSURE", "Network exposure", "network", "context"),
    ("HISTORICAL_ALERTS", "Historical alerts", "history", "context"),
    ("ML_ANOMALY", "ML anomaly", "anomaly_model", "context"),
)
# ---- fixed values: order in which the rules are evaluated; ties in points keep this order -----------------------
EVALUATION_ORDER: tuple[str, ...] = (
    "TRANSACTION_BURST", "VELOCITY_SPIKE", "AMOUNT_DEVIATION", "PEER_AMOUNT_DEVIATION", "RAPID_PASS_THROUGH",
    "FAN_IN", "FAN_OUT", "STRUCTURING", "GEO_NEW_COUNTRY", "IMPOSSIBLE_TRAVEL", "NEW_DEVICE", "DEVICE_SHARING",
    "SHARED_IDENTIFIER", "CIRCULAR_FLOW", "DORMANT_REACTIVATION", "HIGH_RISK_MERCHANT", "BEHAVIOURAL_SHIFT",
    "NETWORK_EXPOSURE", "HISTORICAL_ALERTS", "ML_ANOMALY",
)
# ---- fixed values: category labels ------------------------------------------------------------------------------
CATEGORY_LABELS = {
    "transaction_behaviour": "Transaction behaviour", "fund_flow": "Fund flow", "geographic": "Geographic",
    "device_identity": "Device and identity", "network": "Network", "history": "Historical alerts",
    "anomaly_model": "Anomaly model",
}
# ---- fixed values: points a fully triggered rule contributes, and the group that shares a cap ------------------
WEIGHTS: dict[str, tuple[float, str | None]] = {
    "TRANSACTION_BURST": (20, "velocity"), "VELOCITY_SPIKE": (14, "velocity"), "AMOUNT_DEVIATION": (16, "amount"),
    "PEER_AMOUNT_DEVIATION": (10, "amount"), "RAPID_PASS_THROUGH": (24, "flow"), "FAN_IN": (18, "flow"),
    "FAN_OUT": (14, "flow"), "STRUCTURING": (22, None), "GEO_NEW_COUNTRY": (12, "geo"),
    "IMPOSSIBLE_TRAVEL": (40, "geo"), "NEW_DEVICE": (12, "device"), "DEVICE_SHARING": (32, "device"),
    "SHARED_IDENTIFIER": (8, "device"), "CIRCULAR_FLOW": (30, None), "DORMANT_REACTIVATION": (26, None),
    "HIGH_RISK_MERCHANT": (24, None), "BEHAVIOURAL_SHIFT": (8, None), "NETWORK_EXPOSURE": (8, None),
    "HISTORICAL_ALERTS": (4, None), "ML_ANOMALY": (8, None),
}
GROUP_CAPS = {"velocity": 22.0, "amount": 20.0, "flow": 32.0, "geo": 45.0, "device": 36.0}
# ---- fixed values: units of currency per one US dollar ----------------------------------------------------------
FX_PER_USD = {"NGN": 1500.0, "GHS": 15.0, "KES": 130.0, "ZAR": 18.0, "GBP": 0.78, "USD": 1.0, "CAD": 1.36,
              "AED": 3.67, "CNY": 7.2, "TRY": 34.0}
# ---- fixed values: side each transaction type needs (S sender, R receiver) --------------------------------------
TYPE_SIDE = {"bill_payment": "S", "card_payment": "S", "cash_withdrawal": "S", "deposit": "R", "salary": "R",
             "transfer": "S"}
CHANNELS = ("web", "mobile", "pos", "atm", "branch", "api")
PHYSICAL_CHANNELS = ("pos", "atm", "branch")
STATUSES = ("completed", "failed", "reversed", "pending")
UNRESOLVED = ("NEW", "TRIAGED", "INVESTIGATING", "ESCALATED")
RESOLUTIONS = ("CLEARED", "FALSE_POSITIVE", "CONFIRMED_SUSPICIOUS")
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
FLOW_DETECTORS = ("FAN_IN", "FAN_OUT", "RAPID_PASS_THROUGH", "CIRCULAR_FLOW", "DORMANT_REACTIVATION", "DEVICE_SHARING")


# ---- fixed values: the defaults
@dataclass(frozen=True)
class RiskRules:
    """Thresholds of the risk rules."""
    ramp: float = 1.0
    burst_minutes: int = 60
    burst_min: float = 6
    burst_multiplier: float = 2.0
    velocity_min: float = 6
    velocity_std: float = 4.0
    amount_min_usd: float = 200
    amount_mad: float = 6.0
    amount_p99: float = 2.0
    amount_min_baseline: int = 5
    peer_p99: float = 3.0
    pass_hours: int = 24
    pass_min_ratio: float = 0.7
    pass_min_usd: float = 500
    pass_min_count: int = 3
    pass_types: tuple[str, ...] = ("transfer",)
    pass_ramp: float = 0.35
    fan_in_min: float = 8
    fan_in_multiplier: float = 3.0
    fan_out_min: float = 8
    fan_out_multiplier: float = 3.0
    fan_out_types: tuple[str, ...] = ("transfer",)
    band_usd: float = 10000
    band_lower: float = 0.8
    band_hours: int = 24
    band_min: float = 3
    band_total: float = 1.0
    band_multiplier: float = 2.0
    band_types: tuple[str, ...] = ("cash_withdrawal", "transfer", "deposit")
    country_min: float = 1
    high_risk_countries: tuple[str, ...] = ()
    travel_kmh: float = 900
    travel_km: float = 500
    device_share: float = 0.3
    device_min: int = 3
    sharing_customers: float = 3
    sharing_days: int = 90
    identifier_customers: float = 3
    identifier_always: tuple[str, ...] = ("phone", "email")
    cycle_length: int = 5
    cycle_gap_hours: int = 72
    cycle_tolerance: float = 0.3
    cycle_min_usd: float = 500
    dormant_days: float = 90
    dormant_usd: float = 1000
    merchant_min: int = 3
    merchant_multiplier: float = 3.0
    merchant_usd: float = 300
    shift_jsd: float = 0.35
    shift_min: int = 8
    exposure_min: float = 1
    history_full: float = 3
    anomaly_percentile: float = 0.99
    thin_baseline: int = 5
    score_cap: float = 100.0
    investigate_at: float = 40.0
    bands: tuple[tuple[str, float], ...] = (("critical", 75.0), ("high", 50.0), ("medium", 25.0), ("low", 0.0))
    evidence_limit: int = 25


# Thresholds low enough for the small generated tables (30 days, one row every few minutes).
TRIAL_RULES = replace(
    RiskRules(), burst_min=2, burst_multiplier=1.0, velocity_min=3, velocity_std=1.5, amount_min_usd=50, amount_mad=3.0,
    amount_p99=1.0, peer_p99=1.0, pass_min_ratio=0.3, pass_min_usd=50, pass_min_count=2, fan_in_multiplier=1.0,
    fan_out_multiplier=1.0, band_usd=100, band_lower=0.3, band_hours=48, band_multiplier=1.0, sharing_days=30,
    cycle_min_usd=20, dormant_days=5, dormant_usd=20, merchant_usd=10, merchant_multiplier=1.0, merchant_min=1,
    shift_jsd=0.1, shift_min=5)


@dataclass(frozen=True)
class Period:
    """Investigation window and the baseline before it; both ends of the window are inclusive."""
    as_of: datetime
    lookback_days: int = 30
    baseline_days: int = 90

    @property
    def end(self) -> datetime:
        return self.as_of

    @property
    def window_start(self) -> datetime:
        return self.as_of - timedelta(days=self.lookback_days)

    @property
    def baseline_start(self) -> datetime:
        return self.window_start - timedelta(days=self.baseline_days)


# ---- fixed values: the defaults
@dataclass(frozen=True)
class MuleRules:
    window_days: int = 30
    fan_in_min: int = 5
    fan_out_min: int = 5
    rapid_hours: int = 24
    rapid_share: float = 0.7
    retention_max: float = 0.15
    min_usd: float = 1000
    new_account_days: int = 30
    bands: tuple[tuple[str, float], ...] = (("HIGH", 60.0), ("MEDIUM", 35.0), ("LOW", 15.0))


TRIAL_MULE = replace(MuleRules(), window_days=10, min_usd=50, rapid_share=0.3, retention_max=0.5)


# ---- fixed values: the defaults
@dataclass(frozen=True)
class TriageRules:
    thresholds: tuple[tuple[str, float], ...] = (("CRITICAL", 65.0), ("HIGH", 50.0), ("MEDIUM", 30.0))
    severity_points: dict[str, float] = field(default_factory=lambda: {"low": 3, "medium": 7, "high": 11, "critical": 13})
    tier_points: dict[str, float] = field(default_factory=lambda: {"standalone": 5, "supporting": 4, "context": 0})
    amount_tiers: tuple[tuple[float, float], ...] = ((1000, 2), (5000, 4), (10000, 6), (50000, 8))
    network_points_full: float = 10
    age_hours: tuple[tuple[float, float], ...] = ((24, 1), (48, 3), (96, 5))
    overdue_hours: dict[str, float] = field(default_factory=lambda: {"CRITICAL": 4, "HIGH": 24, "MEDIUM": 72, "LOW": 168})


@dataclass(frozen=True)
class AlertPolicy:
    min_points: float = 0.0
    supporting_gate: float = 40.0
    critical_band: str = "critical"
    cooldown_days: int = 7


@dataclass(frozen=True)
class GateRules:
    """Rules of the ingestion gate."""
    max_age_days: int = 3650
    max_future_hours: int = 24
    late_after_hours: int = 24
    likely_duplicate_seconds: int = 60
    reject_likely_duplicates: bool = True
    reject_closed_accounts: bool = True
    require_transaction_id: bool = False
