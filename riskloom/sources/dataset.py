"""Dataset loading and keyed writes: CSV/Parquet scans, bulk load, append without repeats, document replace."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskloom.sources.schemas import ARRAY_COLUMNS, DATASET


def read_csv_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One delimited table with its explicit schema; timestamps are UTC ISO-8601 text.

    A gzip file cannot be split, so each is one task: keep large tables in many files.
    """
    return (spark.read.schema(DATASET[name]).option("header", True).option("escape", '"')
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]").csv(path))


def read_csv_tables(spark: SparkSession, folder: str, suffix: str = ".csv.gz") -> dict[str, DataFrame]:
    return {name: read_csv_table(spark, name, f"{folder}/{name}{suffix}") for name in DATASET}


def bulk_load(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Parse list columns held as JSON text and keep one label per (type, id, scenario)."""
    out = dict(tables)
    for name, cols in ARRAY_COLUMNS.items():
        if name in out:
            for c in cols:
                out[name] = out[name].withColumn(c, parse_list(F.col(c)))
    if "scenario_labels" in out:
        out["scenario_labels"] = out["scenario_labels"].dropDuplicates(["entity_type", "entity_id", "scenario"])
    return out


def parse_list(c):
    """JSON array text to array<string>; single-quoted lists and empty text are accepted."""
    text = F.regexp_replace(F.trim(c), "'", '"')
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet sink; the fact table is partitioned by day so that windows prune files."""
    for name, df in tables.items():
        write_rows(df, f"{folder}/{name}", "overwrite")


def write_rows(df: DataFrame, path: str, mode: str) -> None:
    """One layout for loading and appending: rows with a time are partitioned by its day, others are not."""
    time = next((c for c in ("timestamp", "ts") if c in df.columns), None)
    if time:
        df.withColumn("day", F.to_date(time)).write.mode(mode).partitionBy("day").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows whose key is not stored yet; the first copy wins when a batch repeats a key."""
    order = [F.col(c).asc_nulls_last() for c in incoming.columns if c != key]
    first = (incoming.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
             .filter("__n = 1").drop("__n"))
    return first.join(stored.select(key), key, "left_anti")


def append_new(incoming: DataFrame, stored_path: str, key: str = "transaction_id") -> None:
    """Append rows with unseen keys to a table that `write_rows` laid out."""
    write_rows(new_rows(incoming, incoming.sparkSession.read.parquet(stored_path), key), stored_path, "append")


def replace_keyed(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """New snapshot in which every incoming key replaces all its current rows (documents with their chunks, vectors)."""
    kept = current.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming)
