"""Connected accounts in order of (hops, id) against a plain search, and the work that is left out."""
from __future__ import annotations

import random
from datetime import datetime

from riskloom.operators import graph as g

D = datetime(2026, 9, 1)


def plain(links, owners, uses, limit):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for seed, owner in owners.items():
        best = {}
        for x in {y for n in near.get(seed, ()) for y in near[n]}:
            best[x] = (2, "transfers")
        for x in near.get(seed, ()):
            best[x] = (1, "transfers")
        for x, other in owners.items():
            shared = [d for c, d in uses if c == owner and (other, d) in uses]
            if other != owner and shared:
                best[x] = (1, f"shared_device:{min(shared)}")
            if other == owner:
                best[x] = (0, "same_owner")
        best.pop(seed, None)
        out[seed] = [(x, *best[x]) for x in sorted(best, key=lambda x: (best[x][0], x))][:limit]
    return out


def test_connected_accounts_leave_out_levels_that_cannot_be_kept(spark, monkeypatch):
    rnd = random.Random(8)
    owners = {a: a - 1 if a % 3 == 2 else a for a in range(80)}
    uses = {(rnd.choice([c for c in set(owners.values()) if c < 60]), rnd.randrange(9)) for _ in range(50)}
    links = {(rnd.randrange(80), rnd.randrange(80)) for _ in range(150)} | {(i, 79) for i in range(0, 80, 3)}
    edges = spark.createDataFrame([(a, b, D) for a, b in links], "source long, target long, last_ts timestamp")
    # accounts come twice: a repeated row must not take the place of another account
    accounts = spark.createDataFrame([*owners.items()] * 2, "account_id long, customer_id long")
    use = spark.createDataFrame(sorted(uses), "customer_id long, device_id long")
    staged = {}
    real = g.stage
    monkeypatch.setattr(g, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    for limit in (4, 12, 100):
        staged.clear()
        got = {}
        for r in sorted(g.connected_accounts(edges, accounts, use, accounts, 2, limit).collect(), key=lambda r: (r.seed, r.rank)):
            got.setdefault(r.seed, []).append((r.account_id, r.hops, r.via))
        want = plain(links, owners, uses, limit)
        assert got == {s: rows for s, rows in want.items() if rows}
        second = {r.seed for r in staged["near2"].select("seed").distinct().collect()}
        assert not second & {s for s, rows in want.items() if len(rows) == limit and rows[-1][1] < 2}
