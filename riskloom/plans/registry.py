"""Named queries and, where another engine can state them, the same question as SQL text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.generated import PERIOD, VIEWS, Bank, oracle_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PERIOD_WORDS = {"bs": f"TIMESTAMP '{PERIOD.baseline_start}'", "ws": f"TIMESTAMP '{PERIOD.window_start}'",
                "we": f"TIMESTAMP '{PERIOD.end}'"}
# rows seen from the owner of each side, as `operators.orient` defines them
LEGS = """
legs AS (
  SELECT x.*, epoch_us(ts) // 1000000 AS sec, CASE WHEN ts < {ws} THEN 'base' ELSE 'win' END AS period FROM (
    SELECT CASE WHEN so.customer_id = ro.customer_id THEN 'internal' ELSE 'out' END AS direction, so.customer_id AS entity_id,
      t.sender_account_id AS account_id, t.receiver_account_id AS other_account, ro.customer_id AS other_entity, t.*
    FROM txn t JOIN accounts so ON so.account_id = t.sender_account_id LEFT JOIN accounts ro ON ro.account_id = t.receiver_account_id
    UNION ALL
    SELECT 'in', ro.customer_id, t.receiver_account_id, t.sender_account_id, so.customer_id, t.*
    FROM txn t JOIN accounts ro ON ro.account_id = t.receiver_account_id LEFT JOIN accounts so ON so.account_id = t.sender_account_id
    WHERE so.customer_id IS DISTINCT FROM ro.customer_id) x
  WHERE ts >= {bs} AND ts <= {we})""".format(**PERIOD_WORDS)


def oracle(views: str, body: str, extra: str = "") -> str:
    """SQL text: the wanted domain views as CTEs ('legs' adds the oriented rows), then `body`."""
    names = views.split()
    if "legs" in names:
        names = list(dict.fromkeys(["txn", "accounts", *[n for n in names if n != "legs"]]))
    ctes = [f"{n} AS (\n{oracle_view(n)})" for n in names if n in VIEWS]
    if "legs" in views.split():
        ctes.append(LEGS.strip())
    if extra:
        ctes.append(extra.strip())
    text = body
    for key, value in PERIOD_WORDS.items():
        text = text.replace("{" + key + "}", value)
        ctes = [c.replace("{" + key + "}", value) for c in ctes]
    return (("WITH RECURSIVE " if "recursive" in names else "WITH ") + ",\n".join(ctes) + "\n" if ctes else "") + text.strip()


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Bank], DataFrame]], Callable[[Bank], DataFrame]]:
    def register(fn: Callable[[Bank], DataFrame]) -> Callable[[Bank], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Bank(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from riskloom.plans import behaviour, casework, dataquality, library, measures, network, risk, scores, streams  # noqa: F401
