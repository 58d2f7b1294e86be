"""Transactions seen from an entity: direction, window/baseline split, lookups by account, device and customer."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import Period
from riskloom.functions.numeric import join_optional, seconds, top_k

LEG_COLUMNS = ("transaction_id", "ts", "merchant_id", "device_id", "amount_usd", "transaction_type", "channel",
               "country", "latitude", "longitude", "status", "external_counterparty")


def between(ts: str, start: datetime | None, end: datetime | None) -> Column:
    """Time window with both ends inclusive; a missing end leaves that side open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(start))
    if end is not None:
        cond = cond & (F.col(ts) <= F.lit(end))
    return cond


def split_period(ts: str, period: Period) -> Column:
    """'base' before the window start, 'win' from it on: one scan serves both."""
    return F.when(F.col(ts) < F.lit(period.window_start), "base").otherwise("win")


def orient(txn: DataFrame, accounts: DataFrame, grain: str = "customer") -> DataFrame:
    """One row per (entity, transaction): 'out', 'in', or 'internal' when the entity owns both sides.

    `grain='account'` makes every known account its own entity.
    """
    entity = F.col("customer_id") if grain == "customer" else F.col("account_id")
    own = accounts.select(F.col("account_id").alias("__acc"), entity.alias("__ent"))
    s = join_optional(txn, own, "sender_account_id", "__acc", "transaction_id").withColumnRenamed("__ent", "__s")
    b = join_optional(s, own, "receiver_account_id", "__acc", "transaction_id").withColumnRenamed("__ent", "__r")

    def leg(direction: str, ent: str, other: str, acc: str, other_acc: str) -> Column:
        return F.struct(F.lit(direction).alias("direction"), F.col(ent).alias("entity_id"),
                        F.col(acc).alias("account_id"), F.col(other_acc).alias("other_account"),
                        F.col(other).alias("other_entity"))

    out = leg("out", "__s", "__r", "sender_account_id", "receiver_account_id")
    inn = leg("in", "__r", "__s", "receiver_account_id", "sender_account_id")
    internal = leg("internal", "__s", "__r", "sender_account_id", "receiver_account_id")
    legs = F.when(F.col("__s") == F.col("__r"), F.array(internal)).otherwise(
        F.filter(F.array(out, inn), lambda x: x["entity_id"].isNotNull()))
    return (b.select(F.explode(legs).alias("leg"), *[c for c in LEG_COLUMNS])
            .select("leg.*", *LEG_COLUMNS).withColumn("sec", seconds(F.col("ts"))))


def legs_for(txn: DataFrame, accounts: DataFrame, period: Period, grain: str = "customer") -> DataFrame:
    """Oriented rows of [baseline start, window end] with their period; the time filter reaches the scan."""
    rows = txn.filter(between("ts", period.baseline_start, period.end))
    return orient(rows, accounts, grain).withColumn("period", split_period("ts", period))


def for_accounts(txn: DataFrame, accounts: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Transactions with either side in `accounts`, each once, oldest first."""
    keys = accounts.select(F.col("account_id").alias("__acc")).distinct()
    rows = txn.filter(between("ts", start, end))
    sent = rows.join(keys, rows.sender_account_id == keys["__acc"], "left_semi")
    received = rows.join(keys, rows.receiver_account_id == keys["__acc"], "left_semi")
    return sent.union(received).distinct().orderBy("ts", "transaction_id")


def device_history(txn: DataFrame, device_id, limit: int, start: datetime | None = None,
                   end: datetime | None = None) -> DataFrame:
    """Oldest `limit` transactions of one device."""
    return (txn.filter(F.col("device_id") == device_id).filter(between("ts", start, end))
            .orderBy("ts", "transaction_id").limit(limit))


def latest_per_customer(legs: DataFrame, n: int) -> DataFrame:
    """Latest n transactions of every customer with the total and whether more exist."""
    totals = legs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total"))
    newest = top_k(legs.select("entity_id", "transaction_id", "ts", "sec", "direction", "amount_usd"), ["entity_id"],
                   [F.col("ts").desc(), F.col("transaction_id").desc()], n)
    return newest.join(totals, "entity_id").withColumn("truncated", F.col("total") > n)


def active_customers(txn: DataFrame, accounts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Owners of any sender or receiver account in the period."""
    rows = txn.filter(between("ts", start, end))
    ids = rows.select(F.col("sender_account_id").alias("account_id")).union(
        rows.select(F.col("receiver_account_id").alias("account_id"))).filter("account_id IS NOT NULL").distinct()
    return ids.join(accounts.select("account_id", "customer_id"), "account_id").select("customer_id").distinct()


def device_users(txn: DataFrame, accounts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Customers per device in a period: count, first and last use."""
    rows = txn.filter(between("ts", start, end) & F.col("device_id").isNotNull() & F.col("sender_account_id").isNotNull())
    per_account = rows.groupBy("device_id", F.col("sender_account_id").alias("account_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    owned = per_account.join(accounts.select("account_id", "customer_id"), "account_id")
    return owned.groupBy("device_id", "customer_id").agg(
        F.sum("n").alias("n_transactions"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def known_ids(batch: DataFrame, reference: DataFrame, column: str, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ids of `batch[column]` with whether `reference[key]` holds them, plus carried attributes."""
    ids = batch.select(F.col(column).alias("id")).filter("id IS NOT NULL").distinct()
    ref = reference.select(F.col(key).alias("id"), F.lit(True).alias("known"), *carry).dropDuplicates(["id"])
    return ids.join(ref, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def search_entities(query: str, limit: int, customers: DataFrame, accounts: DataFrame, devices: DataFrame,
                    merchants: DataFrame, txn: DataFrame) -> DataFrame:
    """Id-prefix search over four entity tables, merchant names that contain the text, an exact transaction id.

    Every branch and the union keep `limit` hits; branches come in this fixed order.
    """
    q = query.strip().upper()

    def branch(df: DataFrame, cond: Column, kind: str, key: str, order: int) -> DataFrame:
        return (df.filter(cond).select(F.lit(order).alias("branch"), F.lit(kind).alias("entity_type"),
                                       F.col(key).cast("string").alias("entity_id"))
                .orderBy("entity_id").limit(limit))

    def prefix(df: DataFrame, kind: str, key: str, order: int) -> DataFrame:
        return branch(df, F.upper(F.col(key).cast("string")).startswith(q), kind, key, order)

    parts = [prefix(customers, "customer", "customer_id", 1), prefix(accounts, "account", "account_id", 2),
             prefix(devices, "device", "device_id", 3), prefix(merchants, "merchant", "merchant_id", 4)]
    if len(q) >= 3 and not q.startswith("MER-"):
        parts.append(branch(merchants, F.contains(F.upper("name"), F.lit(q)), "merchant", "merchant_id", 5))
    if q.startswith("TXN-"):
        parts.append(branch(txn, F.col("transaction_id").cast("string") == q, "transaction", "transaction_id", 6))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits.orderBy("branch", "entity_id").limit(limit)
