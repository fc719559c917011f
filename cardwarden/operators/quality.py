"""Record validation that warns and never rejects, key checks and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden import constants as C


def _rules(table: str, columns: list[str]) -> list[tuple[str, str, Column]]:
    """(field, rule, broken?) for one stored table; fields a frame lacks break ``required`` only."""
    rules = []
    for name in C.REQUIRED_FIELDS.get(table, []):
        missing = F.col(name).isNull() if name in columns else F.lit(True)
        rules.append((name, "required", missing))
    for name, kind in C.FIELD_TYPES.get(table, {}).items():
        if name in columns:
            fits = F.col(name).try_cast(kind).isNotNull()
            rules.append((name, f"type:{kind}", F.col(name).isNotNull() & ~fits))
    for name, values in C.ALLOWED_VALUES.get(table, {}).items():
        if name in columns:
            allowed = F.col(name).cast("string").isin([str(v) for v in values])
            rules.append((name, "allowed", F.col(name).isNotNull() & ~allowed))
    return rules


def with_violations(df: DataFrame, table: str) -> DataFrame:
    """Every row with the list of rules it breaks; rows are kept."""
    checks = [
        F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
        for field, rule, broken in _rules(table, df.columns)
    ]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def schema_violations(df: DataFrame, table: str, key: str) -> DataFrame:
    """One row per broken rule: (key, field, rule)."""
    return with_violations(df, table).select(key, F.inline("violations"))


def violation_counts(df: DataFrame, table: str, key: str) -> DataFrame:
    return schema_violations(df, table, key).groupBy("field", "rule").agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def within_retention(df: DataFrame, table: str, now: Column) -> DataFrame:
    """Rows younger than the table's retention."""
    age_limit = now - F.make_interval(days=F.lit(C.RETENTION_DAYS[table]))
    return df.filter(F.col(C.RETENTION_COLUMN[table]) > age_limit)


def stored_key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Per stored table with a unique key: rows, distinct keys, and rows without a key."""
    counted = [
        df.groupBy(C.UNIQUE_KEYS[name]).agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(C.UNIQUE_KEYS[name]).alias("keys"),
            F.coalesce(F.sum(F.when(F.col(C.UNIQUE_KEYS[name]).isNull(), F.col("n"))), F.lit(0)).alias("keyless"))
        .select(F.lit(name).alias("table_name"), "rows", "keys", "keyless")
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)
