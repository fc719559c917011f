"""Exploratory aggregates. Each is one pass and one shuffle per aggregate family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden.functions import scalars as S
from cardwarden.operators.cleaning import fill_profile_defaults, value_counts
from cardwarden.plans.quantiles import exact_quantiles


def fraud_rate(df: DataFrame) -> DataFrame:
    """Share of fraud in percent and the contamination a model should assume."""
    if "isFraud" not in df.columns:
        return df.agg(F.count("*").alias("n")).select(
            "n", F.lit(None).cast("double").alias("fraud_pct"),
            F.lit(C.DEFAULT_RATE).alias("contamination"))
    share = F.avg("isFraud")
    return df.agg(F.count("*").alias("n"), share.alias("share")).select(
        "n", (F.col("share") * 100).alias("fraud_pct"),
        contamination_of(F.col("share")).alias("contamination"))


def contamination_of(share: Column) -> Column:
    usable = (share > 0) & (share < 0.5)
    return F.when(usable, share).otherwise(F.lit(C.CONTAMINATION))


def category_label_counts(df: DataFrame, columns: list[str], label: str = "isFraud") -> DataFrame:
    long = df.select(label, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [label], columns, "column_name", "value")
    return long.filter("value is not null").groupBy("column_name", "value", label).agg(
        F.count("*").alias("n"))


def label_counts(df: DataFrame, label: str = "isFraud") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _pair_moments(df: DataFrame, columns: list[str], centers: list[float]) -> DataFrame:
    """(a, b, moments) of every pair of column numbers over the rows where both are present.

    Each task adds up its batches with a few matrix products and sends one row per pair.
    """
    import numpy as np
    import pyarrow as pa

    first, second = np.triu_indices(len(columns))
    center = np.array(centers)

    def stage(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = ~np.isnan(x)
            x, one = np.where(there, x - center, 0.0), there.astype(float)
            part = np.stack([one.T @ one, x.T @ one, one.T @ x, (x * x).T @ one, one.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
                 *[pa.array(m[first, second]) for m in total]], names=["a", "b", *MOMENTS])

    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sent = numbers.mapInArrow(stage, "a int, b int, " + ", ".join(f"{m} double" for m in MOMENTS))
    return sent.groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation as (col_a, col_b, corr), both triangles and the diagonal.

    Every pair counts the rows where both columns are present (NaN is missing). A pair in
    which a column does not vary has a null. Values are centred by the column means first,
    which keeps the sums small; two passes whatever the number of columns.
    """
    present = [F.col(c).cast("double") for c in columns]
    row = df.agg(*[F.avg(F.when(~F.isnan(c), c)).alias(f"m{i}") for i, c in enumerate(present)]).first()
    moments = _pair_moments(df, columns, [row[f"m{i}"] or 0.0 for i in range(len(columns))])
    n = F.col("n")
    va, vb = (n * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "ab")
    # rounding leaves a remainder of this order where nothing varies
    varies = (va > n * F.col("saa") * 1e-13) & (vb > n * F.col("sbb") * 1e-13)
    corr = F.when(varies, (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va) / F.sqrt(vb))
    names = F.array(*[F.lit(c) for c in columns])
    a, b = names[F.col("a")], names[F.col("b")]
    both = F.array(F.struct(a.alias("col_a"), b.alias("col_b"), corr.alias("corr")),
                   F.struct(b.alias("col_a"), a.alias("col_b"), corr.alias("corr")))
    return moments.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.lit(quartiles[c][0]).cast("double").alias("q25"),
            F.lit(quartiles[c][1]).cast("double").alias("q50"),
            F.lit(quartiles[c][2]).cast("double").alias("q75"),
            F.max(c).cast("double").alias("max"),
        ).alias(c) for c in columns
    ])
    return row.select(F.inline(F.array(*columns)))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are left out."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        low, high = 0.0, 0.0
    width = (high - low) / bins
    value = F.col(column).cast("double")
    index = (F.least(F.floor((value - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0))
    return (
        df.filter(F.col(column).isNotNull()).groupBy(index.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
    )


def box_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, 1.5-IQR fences and the number of rows outside them, per column."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    entries = []
    for c in columns:
        q1, q2, q3 = quartiles[c]
        low, high = fences(q1, q3)
        outside = (F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))
        entries.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(q1).cast("double").alias("q25"),
            F.lit(q2).cast("double").alias("q50"), F.lit(q3).cast("double").alias("q75"),
            F.lit(low).cast("double").alias("low_fence"),
            F.lit(high).cast("double").alias("high_fence"),
            F.count_if(outside).alias("outliers")).alias(c))
    return df.agg(*entries).select(F.inline(F.array(*columns)))


def fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the 1.5-IQR fences of one column."""
    q1, q3 = exact_quantiles(df, {column: [0.25, 0.75]})[column]
    low, high = fences(q1, q3)
    return df.filter((F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high)))


def mean_spend_per_card(df: DataFrame) -> DataFrame:
    return df.groupBy("card1").agg(S.exact_mean(F.col("TransactionAmt")).alias("mean_spend"))


def mean_of_card_means(df: DataFrame) -> DataFrame:
    return mean_spend_per_card(df).agg(F.avg("mean_spend").alias("mean_of_means"))


def fraud_by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(S.hour_of_day(F.col("TransactionDT")).alias("hour")).agg(
        (F.avg("isFraud") * 100).alias("fraud_pct"))


def fraud_by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(S.day_of_week(F.col("TransactionDT")).alias("day_of_week")).agg(
        F.sum("isFraud").alias("frauds"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column).limit(k)
    )


def rows_of_top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Only the rows of the k most frequent values, which are a bounded semi-join side."""
    return df.join(top_values(df, column, k).select(column), column, "left_semi")


def spend_by_label(df: DataFrame, key: str = "card1") -> DataFrame:
    """Summed amount per key, one column per label, zero where there is none."""
    return (
        df.groupBy(key).pivot("isFraud", [0, 1]).agg(F.sum("TransactionAmt")).fillna(0.0)
        .withColumnsRenamed({"0": "legit_amt", "1": "fraud_amt"})
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.avg(c).alias("mean"),
            F.lit(medians[c][0]).cast("double").alias("median"), F.stddev_samp(c).alias("std"),
            F.var_samp(c).alias("variance"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ).alias(c) for c in columns
    ])
    return row.select(F.inline(F.array(*columns)))


def categorical_profile(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column with their share of the non-null rows."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return top.join(totals, "column_name").select(
        "column_name", "value", (F.col("n") / F.col("total")).alias("share"))


def spending_profiles(df: DataFrame, limit: int = C.PROFILE_LIMIT) -> DataFrame:
    """Mean, sample variance and count per combination of nine keys, the most active first."""
    return (
        fill_profile_defaults(df).groupBy(*C.PROFILE_KEYS)
        .agg(S.exact_mean(F.col("TransactionAmt")).alias("mean"),
             F.coalesce(S.exact_variance(F.col("TransactionAmt")), F.lit(0.0)).alias("var"),
             F.count("TransactionAmt").alias("count"))
        .orderBy(F.desc("count"), *C.PROFILE_KEYS).limit(limit)
    )


def learned_rates(df: DataFrame, columns: list[str], label: str = "isFraud") -> DataFrame:
    """Fraud rate per category value, learned from the rows: (column_name, value, rate, n)."""
    long = df.select(label, *columns).unpivot([label], columns, "column_name", "value")
    return long.filter("value is not null").groupBy("column_name", "value").agg(
        F.avg(label).alias("rate"), F.count("*").alias("n"))


def statistics_report(df: DataFrame, numeric: list[str], categorical: list[str]) -> dict[str, DataFrame]:
    """The frames of the statistics job: globals, numeric and categorical profiles, correlations."""
    return {
        "global": fraud_rate(df),
        "numeric": numeric_profile(df, numeric),
        "categorical": categorical_profile(df, categorical),
        "correlation": correlation_matrix(df, numeric),
    }
