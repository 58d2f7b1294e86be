"""Stateful jobs over state that behaves as the engine's does."""
from __future__ import annotations

import pandas as pd

from riskloom.streaming.jobs import NearDuplicateGroups, NearDuplicates, PassThrough


class _State:
    """List or value state of one key; like the engine's it refuses empty lists."""

    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        return iter(self.held) if isinstance(self.held, list) else self.held

    def put(self, rows):
        assert rows
        self.held, self.calls = list(rows), self.calls + 1

    def update(self, value):
        self.held, self.calls = value, self.calls + 1

    def clear(self):
        self.held = None


class _Timers:
    def __init__(self):
        self.at = []

    def listTimers(self):
        return iter(list(self.at))

    def deleteTimer(self, at):
        self.at.remove(at)

    def registerTimer(self, at):
        self.at.append(at)


class _Clock:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


def test_pass_through_of_an_entity_without_credits():
    p = PassThrough(1, 3, 0.5, 1.0, 1)
    p.credits, p.handle = _State(), _Timers()

    def feed(*rows):
        r = pd.concat(list(p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["sec", "side", "cents"])]), None))).iloc[0]
        return r.inbound_usd, r.matched_usd, r.n_inbound, bool(r.flagged)

    assert feed((20_000, "out", 600)) == (0.0, 0.0, 0, False)
    assert feed((100, "in", 500)) == (0.0, 0.0, 0, False)  # older than the window that the outflow ends
    assert feed((20_100, "in", 1000), (20_200, "out", 600)) == (10.0, 6.0, 1, True)
    assert p.handle.at == [(20_200 + 3 * 3600) * 1000]


def test_near_duplicates_of_a_bucket_are_those_of_its_keys():
    batches = [[("a", 1000, 1), ("a", 1030, 2), ("b", 1030, 3), ("a", 1100, 4)], [("b", 500, 5), ("a", 1050, 6), ("b", 1090, 7), ("c", 1050, 8)], [("c", 1050, 9), ("a", 1161, 10)]]
    groups = NearDuplicateGroups(60)
    groups.seen, groups.handle = _State(), _Timers()
    alone = {}
    for batch in batches:
        frames = [pd.DataFrame([(k, s * 1_000_000, i) for k, s, i in part], columns=["k", "us", "transaction_id"]) for part in (batch[:1], batch[1:])]
        got = pd.concat(list(groups.handleInputRows((0,), iter(frames), _Clock(0))))
        want = {}
        for k in {k for k, _, _ in batch}:
            p = alone.setdefault(k, NearDuplicates(60))
            if not hasattr(p, "seen"):
                p.seen, p.handle = _State(), _Timers()
            rows = pd.DataFrame([(s * 1_000_000, i) for x, s, i in batch if x == k], columns=["us", "transaction_id"])
            out = pd.concat(list(p.handleInputRows((k,), iter([rows]), None)))
            want |= dict(zip(out.transaction_id, out.duplicate, strict=True))
        assert dict(zip(got.transaction_id, got.duplicate, strict=True)) == want and len(got) == len(batch)
    assert groups.seen.calls == len(batches)  # one state call a bucket, not one a key
    assert groups.handle.at == [(1161 + groups.keep) * 1000]
    later = pd.DataFrame({"k": ["d"], "us": [10_000_000 * 1_000_000], "transaction_id": [11]})
    list(groups.handleInputRows((0,), iter([later]), _Clock(1161 + groups.keep + 1)))
    assert groups.seen.held == (["d"], [10_000_000 * 1_000_000])  # the others have been silent for long enough
    list(groups.handleExpiredTimer((0,), None, None))
    assert not groups.seen.exists()


def test_near_duplicates_tell_missing_values_apart(spark, tmp_path):
    from riskloom.streaming.jobs import near_duplicates
    rows = [(1, None, 2, 5.0, "USD"), (2, None, 2, 5.0, "USD"), (3, None, 2, None, "USD"), (4, None, 2, None, "USD"), (5, None, 2, 5.0, None), (6, -1, 2, 5.001, "USD"), (7, 1, 2, 5.0, "USD"), (8, 1, 2, 0.0, "USD"), (9, 1, 2, -0.0, "USD")]
    table = spark.createDataFrame(rows, "transaction_id long, sender_account_id long, receiver_account_id long, amount double, currency string").selectExpr(
        "*", "timestamp_seconds(1000 + transaction_id) AS ts")
    table.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = near_duplicates(live).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.transaction_id for r in spark.read.parquet(str(tmp_path / "out")).filter("duplicate").collect()}
    assert got == {2, 4, 6, 9} and spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
