"""Data quality: the gate for incoming rows, batch accounting, and the audit of stored rows."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import CHANNELS, FX_PER_USD, STATUSES, TYPE_SIDE, GateRules
from riskloom.functions.numeric import join_optional, lookup, rnd
from riskloom.operators.windows import running_max, with_previous
from riskloom.session import stage

# ---- fixed values: groups of reason codes
CODE_GROUPS = {
    "malformed": ("MALFORMED_ROW", "MISSING_FIELD", "INVALID_TIMESTAMP", "INVALID_AMOUNT", "INVALID_CURRENCY", "INVALID_ID_FORMAT", "INVALID_IP", "INVALID_STATUS"),
    "duplicate": ("DUPLICATE_ID", "LIKELY_DUPLICATE"),
    "referential": ("UNKNOWN_ACCOUNT", "UNKNOWN_DEVICE", "UNKNOWN_MERCHANT"),
}
FIELDS = ("transaction_id", "timestamp", "sender_account_id", "receiver_account_id", "merchant_id", "device_id", "amount", "currency", "amount_usd",
          "transaction_type", "channel", "country", "latitude", "longitude", "ip_address", "status", "external_counterparty")
REQUIRED = ("timestamp", "amount", "currency", "transaction_type", "channel")
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
# full form, or one '::' anywhere, each with at most eight groups; an IPv4 tail counts as two groups
IPV6_CHARS = r"^[0-9A-Fa-f:.]+$"


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def group_of(code: Column) -> Column:
    out = F.lit("invalid")
    for group, codes in CODE_GROUPS.items():
        out = F.when(code.isin(*codes), group).otherwise(out)
    return F.when(code.isNotNull(), out)


def valid_ip(c: Column) -> Column:
    """IPv4 dotted quad or IPv6 text (at most one '::'; eight groups without it, fewer with it; optional IPv4 tail)."""
    tail = F.regexp_extract(c, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 2)
    v6 = F.when(tail != "", F.concat(F.regexp_extract(c, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 1), F.lit("0:0"))).otherwise(c)
    tail_ok = (tail == "") | tail.rlike(IPV4)
    groups = F.filter(F.split(v6, ":"), lambda g: g != "")
    groups_ok = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    doubles = F.size(F.split(v6, "::")) - 1
    shape = (F.when(v6.contains(":::"), False).when(doubles == 1, (F.size(groups) <= 7) & ~v6.rlike("^:[^:]") & ~v6.rlike("[^:]:$"))
             .when(doubles == 0, (F.size(groups) == 8) & ~v6.startswith(":") & ~v6.endswith(":")).otherwise(False))
    return c.rlike(IPV4) | (c.contains(":") & c.rlike(IPV6_CHARS) & tail_ok & groups_ok & shape)


# ---------------------------------------------------------------------------------------------------------------- gate
def field_code(now: datetime, rules: GateRules) -> Column:
    """First failure that the row alone shows, in the fixed order of the checks; null when there is none."""
    text = {c: F.when(~blank(F.col(c)), F.trim(F.col(c).cast("string"))) for c in FIELDS}
    raw = F.col("timestamp").cast("string")
    ts = F.expr("try_to_timestamp(cast(timestamp as string))")
    amount = F.expr("try_cast(cast(amount as string) as double)")
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf"))
    kind, channel = F.lower(text["transaction_type"]), F.lower(text["channel"])
    status = F.coalesce(F.lower(text["status"]), F.lit("completed"))
    need = lookup(kind, TYPE_SIDE)
    no_s, no_r = text["sender_account_id"].isNull(), text["receiver_account_id"].isNull()
    checks = [
        ("MALFORMED_ROW", F.coalesce(F.col("malformed"), F.lit(False))),
        ("MISSING_FIELD", F.greatest(*[text[c].isNull() for c in REQUIRED])),
        ("INVALID_TIMESTAMP", ts.isNull() & raw.isNotNull()),
        ("TIMESTAMP_OUT_OF_RANGE", (ts < F.lit(now - timedelta(days=rules.max_age_days))) | (ts > F.lit(now + timedelta(hours=rules.max_future_hours)))),
        ("INVALID_AMOUNT", ~finite), ("NON_POSITIVE_AMOUNT", amount <= 0),
        ("INVALID_CURRENCY", ~F.col("currency").cast("string").rlike("^[A-Za-z]{3}$")),
        ("UNSUPPORTED_CURRENCY", ~F.upper(F.col("currency")).isin(*FX_PER_USD)),
        ("INVALID_TYPE", ~kind.isin(*TYPE_SIDE)), ("INVALID_CHANNEL", ~channel.isin(*CHANNELS)), ("INVALID_STATUS", ~status.isin(*STATUSES)),
        ("NO_ACCOUNT", no_s & no_r), ("DIRECTION_MISMATCH", ((need == "S") & no_s) | ((need == "R") & no_r)),
        ("INVALID_IP", text["ip_address"].isNotNull() & ~valid_ip(text["ip_address"])),
        ("MISSING_TRANSACTION_ID", F.lit(rules.require_transaction_id) & text["transaction_id"].isNull()),
        ("INVALID_ID_FORMAT", text["transaction_id"].isNotNull() & ~F.col("transaction_id").cast("string").rlike(r"^TXN-\d{1,12}$")),
    ]
    out = None
    for code, cond in checks:
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out


def reference_code(rows: DataFrame, accounts: DataFrame, devices: DataFrame, merchants: DataFrame, rules: GateRules) -> DataFrame:
    """First failure against the stored entities, for rows without one so far: sender, receiver, device, merchant."""
    acc = accounts.select(F.col("account_id").cast("string").alias("__k"), F.col("status").alias("__v"))
    out = rows
    for side in ("sender", "receiver"):
        out = join_optional(out, acc, f"{side}_account_id", "__k", "row").withColumnRenamed("__v", f"__{side}")
    for name, ref in (("device", devices), ("merchant", merchants)):
        ids = ref.select(F.col(f"{name}_id").cast("string").alias("__k"), F.lit(True).alias("__v"))
        out = join_optional(out, ids, f"{name}_id", "__k", "row").withColumnRenamed("__v", f"__{name}")

    def account(side: str) -> Column:
        given = F.col(f"{side}_account_id").isNotNull()
        closed = F.lit(rules.reject_closed_accounts) & (F.col(f"__{side}") == "closed")
        return F.when(given & F.col(f"__{side}").isNull(), "UNKNOWN_ACCOUNT").when(given & closed, "ACCOUNT_CLOSED")

    def known(name: str) -> Column:
        return F.when(F.col(f"{name}_id").isNotNull() & F.col(f"__{name}").isNull(), f"UNKNOWN_{name.upper()}")

    code = F.coalesce("code", account("sender"), account("receiver"), known("device"), known("merchant"))
    return out.withColumn("code", code).drop("__sender", "__receiver", "__device", "__merchant")


def duplicate_ids(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """DUPLICATE_ID for ids that are stored already or that an earlier live row of the batch carries."""
    stored_ids = stored.select(F.col("transaction_id").cast("string").alias("__id"), F.lit(True).alias("__stored")).dropDuplicates(["__id"])
    live = rows.filter("code IS NULL AND transaction_id IS NOT NULL")
    first = live.groupBy(F.col("transaction_id").alias("__first_id")).agg(F.min("row").alias("__first"))
    j = join_optional(rows, stored_ids, "transaction_id", "__id", "row")
    j = join_optional(j, first, "transaction_id", "__first_id", "row")
    again = F.col("code").isNull() & F.col("transaction_id").isNotNull() & (F.coalesce("__stored", F.lit(False)) | (F.col("row") > F.col("__first")))
    return j.withColumn("code", F.when(again, "DUPLICATE_ID").otherwise(F.col("code"))).drop("__stored", "__first")


def likely_duplicates(rows: DataFrame, stored: DataFrame, rules: GateRules) -> DataFrame:
    """LIKELY_DUPLICATE for live rows within the window of a stored row, or of an earlier accepted row, with the same
    parties, amount and currency.

    Whether a row counts depends on which earlier rows were accepted, so it is folded in order. What is folded is small:
    of rows with equal key and instant only the first can be accepted, keys without near neighbours are left out, and a
    key's time line is cut wherever two neighbours are farther apart than the window.
    """
    width = rules.likely_duplicate_seconds * 1_000_000
    parts = ["sender_account_id", "receiver_account_id", "cents", "currency"]

    def keyed_rows(df: DataFrame, row: Column) -> DataFrame:
        d = df.select(row.cast("long").alias("row"), F.col("sender_account_id").cast("string").alias("sender_account_id"),
                      F.col("receiver_account_id").cast("string").alias("receiver_account_id"), F.round("amount", 2).alias("cents"),
                      F.col("currency").cast("string").alias("currency"), F.unix_micros("ts").alias("us"))
        return d.withColumn("k", F.to_json(F.struct(*parts)))

    live = keyed_rows(rows.filter("code IS NULL"), F.col("row"))
    bounds = live.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    held = keyed_rows(stored, F.lit(-1)).join(F.broadcast(bounds), (F.col("us") >= F.col("lo") - width) & (F.col("us") <= F.col("hi") + width)  # one row
                                              ).drop("lo", "hi")
    both = live.unionByName(held).select("row", "us", "k")
    chunk = F.floor(F.col("us") / (width * 60))
    instants = stage(both.groupBy("k", "us").agg(F.min("row").alias("row")), "instants")
    near = with_previous(instants, ["k"], ["us"], ["us"], chunk)
    start = F.col("prev_us").isNull() | (F.col("us") - F.col("prev_us") > width)
    clustered = stage(running_max(near, ["k"], ["us"], F.when(start, F.col("us")), chunk, "cluster"), "clusters")
    crowded = clustered.filter("us > cluster").select("k", "cluster").distinct()
    folding = clustered.join(crowded, ["k", "cluster"], "left_semi").select("k", "cluster", "us", "row")

    def fold(group):
        import bisect

        import pandas as pd
        times, bad = [], []
        for row, us in sorted(zip(group.row, group.us)):
            at = bisect.bisect_left(times, us - width)
            if row >= 0 and at < len(times) and times[at] <= us + width:
                bad.append(row)
            else:
                bisect.insort(times, us)
        return pd.DataFrame({"row": pd.Series(bad, dtype="int64")})

    bad = folding.groupBy("k", "cluster").applyInPandas(fold, "row long")
    repeats = both.join(instants.withColumnRenamed("row", "first"), ["k", "us"]).filter("row > first").select("row")
    flagged = bad.union(repeats).withColumn("__likely", F.lit(True))
    j = rows.join(flagged, "row", "left")
    return j.withColumn("code", F.when(F.col("code").isNull() & F.col("__likely"), "LIKELY_DUPLICATE").otherwise(F.col("code"))).drop("__likely")


def gate(batch: DataFrame, accounts: DataFrame, devices: DataFrame, merchants: DataFrame, stored: DataFrame, now: datetime, rules: GateRules) -> DataFrame:
    """Every row with its first failure code (null when accepted) and the normalised columns.

    `batch` holds the fields as text, a unique `row` number in arrival order and, optionally, `malformed`.
    """
    rows = batch if "malformed" in batch.columns else batch.withColumn("malformed", F.lit(False))
    rows = rows.withColumn("code", field_code(now, rules))
    rows = rows.select("row", "code", *[F.when(~blank(F.col(c)), F.col(c).cast("string")).alias(c) for c in FIELDS])
    rows = rows.withColumn("ts", F.expr("try_to_timestamp(timestamp)")).withColumn("raw_amount", F.col("amount")).withColumn("amount", F.expr("try_cast(amount as double)"))
    rows = rows.withColumn("currency", F.when(F.col("code").isNull(), F.upper("currency")).otherwise(F.col("currency")))
    for c in ("transaction_type", "channel"):
        rows = rows.withColumn(c, F.when(F.col("code").isNull(), F.lower(F.trim(c))).otherwise(F.col(c)))
    rows = rows.withColumn("status", F.when(F.col("code").isNull(), F.coalesce(F.lower(F.trim("status")), F.lit("completed"))).otherwise(F.col("status")))
    rows = reference_code(rows, accounts, devices, merchants, rules)
    rows = duplicate_ids(rows, stored)
    return likely_duplicates(stage(rows, "gated"), stored, rules) if rules.reject_likely_duplicates else rows


def accepted(gated: DataFrame, batch_id: str) -> DataFrame:
    """Accepted rows: missing ids derived from batch and row, missing dollar amounts from the rate table."""
    fx = lookup(F.col("currency"), FX_PER_USD).cast("double")
    row = F.col("row").cast("string")  # unique in its batch, so ids only meet if batch ids do
    made = F.concat(F.lit("TXN-9"), F.lpad(F.pmod(F.xxhash64(F.lit(batch_id)), F.lit(10 ** 18)).cast("string"), 18, "0"),
                    F.when(F.length(row) < 12, F.lpad(row, 12, "0")).otherwise(row))
    usd = F.coalesce(F.expr("try_cast(amount_usd as double)"), rnd(F.col("amount") / fx))
    return gated.filter("code IS NULL").withColumn("id_generated", F.col("transaction_id").isNull()).withColumn(
        "transaction_id", F.coalesce("transaction_id", made)).withColumn("amount_usd", usd).drop("code", "raw_amount", "timestamp")


def late(rows: DataFrame, latest: datetime, rules: GateRules) -> DataFrame:
    """Accepted rows older than the newest stored row by more than the allowed lateness."""
    return rows.withColumn("late", F.col("ts") < F.lit(latest - timedelta(hours=rules.late_after_hours)))


def quarantine(gated: DataFrame) -> DataFrame:
    """Rejected rows with code, group and a sanitised copy of their fields."""
    ip = F.col("ip_address")
    shown = F.when(ip.isNull(), ip).when(F.size(F.split(ip, r"\.")) == 4, F.concat_ws(".", F.slice(F.split(ip, r"\."), 1, 2), F.lit("x.x"))).otherwise("masked")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), (shown if c == "ip_address" else F.col("raw_amount") if c == "amount" else F.col(c)).alias("value")) for c in FIELDS])
    payload = sanitise(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
    return gated.filter("code IS NOT NULL").select("row", "code", group_of(F.col("code")).alias("group"), F.substring("transaction_id", 1, 40).alias("transaction_id"), payload.alias("payload"))


def sanitise(payload: Column, keys: int = 30, width: int = 120) -> Column:
    """At most `keys` entries of a map, values cut at `width` characters, keys at forty."""
    return F.map_from_entries(F.transform(F.slice(F.map_entries(payload), 1, keys), lambda e: F.struct(F.substring(e["key"], 1, 40).alias("key"), F.substring(e["value"], 1, width).alias("value"))))


def missing_ids(received: DataFrame, stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected ids that neither the batch nor the store holds."""
    return expected.select("transaction_id").join(received.select("transaction_id"), "transaction_id", "left_anti").join(stored.select("transaction_id"), "transaction_id", "left_anti")


def expected_sequence(spark, prefix: str, start: int, end: int) -> DataFrame:
    return spark.range(start, end + 1).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("transaction_id"))


def missing_count(expected: int | None, received: Column) -> Column:
    """Shortfall against a declared count; null when none was declared."""
    return F.lit(None).cast("long") if expected is None else F.greatest(F.lit(expected) - received, F.lit(0))


def ledger(gated: DataFrame, keys: tuple[str, ...] = (), failed: int = 0) -> DataFrame:
    """Batch accounting: received = processed + rejected + failed, with counts per code group."""
    g = group_of(F.col("code"))
    return gated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), (F.count(F.when(F.col("code").isNull(), 1)) - failed).alias("processed"), F.count("code").alias("rejected"),
        F.lit(failed).cast("long").alias("failed"), F.count(F.when(g == "duplicate", 1)).alias("duplicates"), F.count(F.when(g == "malformed", 1)).alias("malformed"),
        F.count(F.when(g == "referential", 1)).alias("referential"), F.count(F.when(g == "invalid", 1)).alias("invalid"))


def reason_counts(gated: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return gated.filter("code IS NOT NULL").groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n")).withColumn("group", group_of(F.col("code")))


def quality_totals(batches: DataFrame) -> DataFrame:
    """Totals over batch rows; rates are null where their denominator is missing."""
    declared = F.col("expected_count").isNotNull()
    t = batches.agg(
        F.count(F.lit(1)).alias("batches"), F.count(F.when(declared, 1)).alias("batches_with_expected"), F.sum("expected_count").alias("expected"),
        *[F.sum(c).alias(c) for c in ("received", "processed", "rejected", "duplicates", "malformed", "late", "failed")], F.sum("missing").alias("missing"),
        F.sum(F.when(declared, F.col("received"))).alias("r_exp"), F.sum(F.when(declared, F.col("processed"))).alias("p_exp"))
    ratio = lambda a, b, d=6: F.when(b > 0, rnd(a / b, d))
    return t.select("batches", "batches_with_expected", "expected", "received", "processed", "rejected", "duplicates", "malformed", "late", "failed", "missing",
                    F.when(F.col("expected") > 0, rnd(F.least(F.col("r_exp") / F.col("expected"), F.lit(1.0)), 6)).alias("coverage"),
                    ratio(F.col("p_exp"), F.col("expected")).alias("effective_coverage"), ratio(F.col("processed"), F.col("received")).alias("processing_success"),
                    ratio((F.col("processed") - F.col("late")) * 100.0, F.col("received"), 2).alias("quality_score"))


def seed_ledger(tables: dict[str, DataFrame], declared: dict[str, int | None]) -> DataFrame:
    """Declared against held rows of every bulk-loaded table."""
    out = None
    for name, df in tables.items():
        n = F.count(F.lit(1))
        row = df.agg(F.lit(name).alias("source"), F.lit(declared.get(name)).cast("long").alias("expected"), n.alias("processed")).withColumn(
            "missing", F.when(F.col("expected").isNotNull(), F.greatest(F.col("expected") - F.col("processed"), F.lit(0))))
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------------------------------------------- audit
CHECKS = ("missing_transaction_id", "duplicate_transaction_id", "likely_duplicate", "invalid_amount", "invalid_currency", "invalid_timestamp", "future_timestamp",
          "no_account", "orphan_sender_account", "orphan_receiver_account", "orphan_merchant", "orphan_device", "impossible_state", "incomplete_record")


def audit_rows(txn: DataFrame, accounts: DataFrame, merchants: DataFrame, devices: DataFrame, as_of: datetime, row: str = "row") -> DataFrame:
    """Stored rows with one flag per check. `row` is a unique arrival number; `ts` is null when it could not be read."""
    out = txn.withColumn("row", F.col(row))
    amount = F.col("amount")
    kind = F.lower(F.col("transaction_type").cast("string"))
    s_blank, r_blank = blank(F.col("sender_account_id")), blank(F.col("receiver_account_id"))
    need = lookup(kind, TYPE_SIDE)
    flags = {
        "missing_transaction_id": blank(F.col("transaction_id")),
        "invalid_amount": amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount <= 0),
        "invalid_currency": ~F.coalesce(F.upper("currency").isin(*FX_PER_USD), F.lit(False)), "invalid_timestamp": F.col("ts").isNull(),
        "future_timestamp": F.coalesce(F.col("ts") > F.lit(as_of + timedelta(days=1)), F.lit(False)), "no_account": s_blank & r_blank,
        "impossible_state": ~F.coalesce(F.lower("status").isin(*STATUSES), F.lit(False)) | F.coalesce((need == "S") & s_blank, F.lit(False)) | F.coalesce((need == "R") & r_blank, F.lit(False)),
        "incomplete_record": blank(F.col("transaction_type")) | blank(F.col("channel")),
    }
    out = out.withColumns(flags)
    for side in ("sender", "receiver"):
        ref = accounts.select(F.col("account_id").alias("__k"), F.lit(True).alias("__ok")).dropDuplicates(["__k"])
        out = join_optional(out, ref, f"{side}_account_id", "__k", "row")
        out = out.withColumn(f"orphan_{side}_account", ~blank(F.col(f"{side}_account_id")) & F.col("__ok").isNull()).drop("__ok")
    for name, ref in (("merchant", merchants), ("device", devices)):
        ids = ref.select(F.col(f"{name}_id").alias("__k"), F.lit(True).alias("__ok")).dropDuplicates(["__k"])
        out = join_optional(out, ids, f"{name}_id", "__k", "row")
        out = out.withColumn(f"orphan_{name}", ~blank(F.col(f"{name}_id")) & F.col("__ok").isNull()).drop("__ok")
    first = out.filter("NOT missing_transaction_id").groupBy(F.col("transaction_id").alias("__id")).agg(F.min("row").alias("__first"))
    out = join_optional(out, first, "transaction_id", "__id", "row")
    out = out.withColumn("duplicate_transaction_id", F.coalesce(F.col("row") > F.col("__first"), F.lit(False))).drop("__first")
    parties = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sender_account_id", "receiver_account_id", "currency")]
    keyed = out.filter("ts IS NOT NULL AND amount IS NOT NULL").select("row", "ts", F.unix_micros("ts").alias("us"), F.concat_ws("|", *parties, F.round("amount", 2).cast("string")).alias("k"))
    prev = with_previous(keyed, ["k"], ["us", "row"], ["us"], F.floor(F.col("us") / 86_400_000_000))
    near = prev.filter("us - prev_us <= 60000000").select("row", F.lit(True).alias("__near"))
    out = out.join(near, "row", "left")
    return out.withColumn("likely_duplicate", F.coalesce("__near", F.lit(False)) & ~F.col("duplicate_transaction_id")).drop("__near")


def audit_summary(flagged: DataFrame) -> DataFrame:
    """Rows, valid rows, score and the count of every check."""
    issue = F.greatest(*[F.col(c) for c in CHECKS])
    t = flagged.agg(F.count(F.lit(1)).alias("records_processed"), F.count(F.when(issue, 1)).alias("with_issues"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in CHECKS],
                    F.max("ts").alias("latest"))
    n = F.col("records_processed")
    return t.select("records_processed", (n - F.col("with_issues")).alias("valid"), "with_issues",
                    F.when(n > 0, rnd((n - F.col("with_issues")) * 100.0 / n)).alias("quality_score"), *CHECKS, F.unix_micros("latest").alias("latest_us"))


def audit_entities(customers: DataFrame, accounts: DataFrame, merchants: DataFrame, devices: DataFrame) -> DataFrame:
    """Counts over the entity tables: rows, repeated ids, incomplete customers, orphan and status-less accounts."""
    c = customers.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("customer_id")).alias("d"),
                      F.count(F.when(blank(F.col("country")) | blank(F.col("segment")), 1)).alias("i"))
    a = accounts.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(blank(F.col("status")), 1)).alias("s"))
    orphan = accounts.join(customers.select("customer_id"), "customer_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))

    def row(name: str, df: DataFrame, col: str) -> DataFrame:
        return df.select(F.lit(name).alias("measure"), F.col(col).alias("n"))

    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    return (row("customers", c, "n").union(row("customers_duplicate_ids", c, "d")).union(row("customers_incomplete", c, "i"))
            .union(row("accounts", a, "n")).union(row("accounts_missing_status", a, "s")).union(row("accounts_orphan_owner", orphan, "n"))
            .union(row("merchants", size(merchants), "n")).union(row("devices", size(devices), "n")))
