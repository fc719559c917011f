"""Model input: category rates, engineered features and the 27-entry vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden import schemas
from cardwarden.functions import scalars as S


def category_rate(name: str) -> Column:
    """Fraud rate of a category value out of the fixed table; unseen or missing gives the default."""
    table = ", ".join(f"'{value}', {rate}D" for value, rate in C.CATEGORY_RATES[name].items())
    return F.expr(f"coalesce(map({table})[{name}], {C.DEFAULT_RATE}D)")


def engineered() -> dict[str, Column]:
    amount = F.col("TransactionAmt")
    return {
        "zscore_amt": S.zscore_amt(amount),
        "velocity": S.velocity(F.col("C1"), F.col("D1")),
        "amt_distance": S.amt_distance(amount),
    }


def user_relative() -> dict[str, Column]:
    amount, mean = F.col("TransactionAmt"), F.col("promedio_de_gastos")
    return {
        "ratio_vs_user": S.ratio_vs_user(amount, mean),
        "zscore_vs_user": S.zscore_vs_user(amount, mean, F.col("varianza_de_gastos")),
    }


def feature_columns() -> list[Column]:
    """The 27 model inputs, named and ordered as in ``schemas.FEATURE_NAMES``."""
    entries = [F.expr(f"coalesce(try_cast({name} as double), 0D)") for name in C.NUMERIC_FEATURES]
    entries += [category_rate(name) for name in C.CATEGORY_RATES]
    entries += list(user_relative().values())
    return [entry.alias(name) for entry, name in zip(entries, schemas.FEATURE_NAMES)]


def feature_vector() -> Column:
    return F.array(*feature_columns())


def with_engineered(df: DataFrame) -> DataFrame:
    return df.withColumns(engineered())


def with_user_relative(df: DataFrame) -> DataFrame:
    return df.withColumns(user_relative())


def with_amount_ratio(df: DataFrame, mean_source: DataFrame | None = None) -> DataFrame:
    """Amount over the mean amount, and its log.

    The mean is a scalar subquery over ``mean_source``; leaving that out takes it
    over all rows, passing the training rows takes it over those only.
    """
    source = df if mean_source is None else mean_source
    mean = source.select(F.avg("TransactionAmt")).scalar()
    return df.withColumns({
        "amt_ratio": F.col("TransactionAmt") / (mean + F.lit(1e-9)),
        "log_amt": S.log_amount(F.col("TransactionAmt")),
    })
