"""Column selection, gap filling and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden import constants as C
from cardwarden.plans.quantiles import exact_quantiles
from cardwarden.plans.selection import sequence_numbers
from cardwarden.session import written


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def drop_identifiers(df: DataFrame, columns: tuple[str, ...] = ("isFraud", "TransactionID")) -> DataFrame:
    """Columns that are not there are ignored."""
    return df.drop(*columns)


def null_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percentage of nulls per column, as (column_name, null_pct); all columns in one pass."""
    names = columns or df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "share").select(
        "column_name", (F.col("share") * 100).alias("null_pct"))


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with gaps, the sparsest first."""
    return null_shares(df).filter("null_pct > 0").orderBy(F.desc("null_pct"), "column_name")


def sparse_column_count(df: DataFrame, limit_pct: float = 80.0) -> DataFrame:
    return null_shares(df).agg(F.count_if(F.col("null_pct") > limit_pct).alias("sparse_columns"))


def gap_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and nulls per column, in one pass."""
    row = df.agg(F.count("*").alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return row["__rows"], {c: row[c] for c in columns}


def drop_sparse(df: DataFrame, limit: float = 0.8,
                gaps: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """Drop the columns whose share of nulls is strictly above the limit."""
    n, nulls = gaps or gap_counts(df, df.columns)
    return df.drop(*[c for c in df.columns if n and nulls[c] / n > limit])


def impute_median(df: DataFrame, columns: list[str] | None = None,
                  gaps: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """Fill numeric gaps with the exact median. An integer column with a gap becomes double."""
    names = columns or numeric_columns(df)
    nulls = (gaps or gap_counts(df, names))[1]
    names = [c for c in names if nulls[c] > 0]
    medians = exact_quantiles(df, {c: [0.5] for c in names})
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(m[0])) for c, m in medians.items()
        if m[0] is not None})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of (column_name, value) over several columns in one shuffle, nulls left out."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value")
    return long.filter("value is not null").groupBy("column_name", "value").agg(
        F.count("*").alias("n"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    return value_counts(df, columns).groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def impute_mode(df: DataFrame, columns: list[str] | None = None,
                gaps: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """Fill text gaps with the most frequent value; one scalar per column is read."""
    names = [c for c in columns or text_columns(df) if gaps is None or gaps[1][c] > 0]
    if not names:
        return df
    fill = {r["column_name"]: r["mode"] for r in modes(df, names).collect()}
    return df.fillna(fill) if fill else df


def clean(df: DataFrame, limit: float = 0.8) -> DataFrame:
    """Drop sparse columns, then fill numbers with the median and texts with the mode.

    Nulls are counted once for all three steps; only columns with gaps are read again.
    """
    gaps = gap_counts(df, df.columns)
    kept = drop_sparse(df, limit, gaps)
    return impute_mode(impute_median(kept, gaps=gaps), text_columns(kept), gaps)


def fill_profile_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({c: v for c, v in C.PROFILE_FILL.items() if c in df.columns})


def fill_constant(df: DataFrame, value: float = -999) -> DataFrame:
    """One constant in every column, as text in text columns."""
    return df.fillna(value, numeric_columns(df)).fillna(str(int(value)), text_columns(df))


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, code): the place of each text among the sorted distinct texts.

    A missing value counts as the text ``nan``. The distinct values are numbered in place
    over range partitions, so no task sorts a dictionary.
    """
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns])
    values = long.unpivot([], columns, "column_name", "value").distinct()
    numbered = sequence_numbers(values, ["column_name", "value"])
    first = numbered.groupBy("column_name").agg(F.min("sequence").alias("first"))
    return numbered.join(first, "column_name").select(
        "column_name", "value", (F.col("sequence") - F.col("first")).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text columns by their label codes; the dictionary is written once."""
    if not columns:
        return df
    codes = written(label_codes(df, columns), "label-codes")
    out = df
    for name in columns:
        lookup = codes.filter(F.col("column_name") == F.lit(name)).select(
            F.col("value").alias("__value"), F.col("code").alias("__code"))
        key = F.coalesce(out[name].cast("string"), F.lit("nan"))
        out = out.join(lookup, key == lookup["__value"], "left").withColumn(
            name, F.col("__code")).drop("__value", "__code")
    return out
