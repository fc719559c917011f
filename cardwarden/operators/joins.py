"""Equi-joins of the data model. Broadcast or shuffle follows the measured size of a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden.plans.selection import first_per_key, latest_per_key


def with_profile(tx: DataFrame, profiles: DataFrame, fill: bool = False) -> DataFrame:
    """Left join on the user with two profile columns; ``fill`` puts the defaults where none is."""
    wanted = profiles.select("usuarioID", "promedio_de_gastos", "varianza_de_gastos")
    joined = tx.join(wanted, "usuarioID", "left")
    if fill:
        joined = joined.fillna({
            "promedio_de_gastos": C.AMT_MEAN, "varianza_de_gastos": C.AMT_STD ** 2})
    return joined


def profiles_in_use(batch: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of the users of one micro-batch.

    The batch's few keys are what gets broadcast, so a dimension of any size is
    scanned in place and never shuffled for a small batch.
    """
    keys = batch.select("usuarioID").distinct()
    return profiles.join(keys, "usuarioID", "left_semi")


def with_latest_card(tx: DataFrame, cards: DataFrame, order: list[Column]) -> DataFrame:
    """Inner join with the last card of each user; a user without a card drops out."""
    last = latest_per_key(cards, ["usuarioID"], order).select(
        "usuarioID", *[F.col(c).alias(f"card_{c}") for c in cards.columns if c != "usuarioID"])
    return tx.join(last, "usuarioID")


def with_card(tx: DataFrame, cards: DataFrame, columns: list[str]) -> DataFrame:
    """Left join on the card id."""
    wanted = cards.select("tarjetaID", *[F.col(c).alias(f"card_{c}") for c in columns])
    return tx.join(wanted, "tarjetaID", "left")


def with_identity(tx: DataFrame, identity: DataFrame, key: str = "transaccionID") -> DataFrame:
    return tx.join(identity, key, "left")


def not_yet_stored(batch: DataFrame, stored: DataFrame, key: str,
                   order: list[Column] | None) -> DataFrame:
    """First row per key of a batch, without the keys a table already holds.

    The stored side is first reduced to the batch's own keys, so the stored table
    is scanned, not shuffled, when the batch is small. Without an order the batch is
    taken to hold each key once.
    """
    first = batch if order is None else first_per_key(batch, [key], order)
    keys = batch.select(key) if order is None else batch.select(key).distinct()
    hits = stored.select(key).join(keys, key, "left_semi")
    return first.join(hits, key, "left_anti")


def rate_table(spark) -> DataFrame:
    """The fixed category rates as rows (column_name, value, rate): 24 of them."""
    rows = [(c, v, r) for c, rates in C.CATEGORY_RATES.items() for v, r in rates.items()]
    return F.broadcast(spark.createDataFrame(rows, "column_name string, value string, rate double"))


def with_category_rates(tx: DataFrame, rates: DataFrame, columns: list[str],
                        default: float = C.DEFAULT_RATE) -> DataFrame:
    """Rate per category column from a table of rates; unseen and missing values get the default."""
    out = tx
    for name in columns:
        lookup = rates.filter(F.col("column_name") == name).select(
            F.col("value").alias(name), F.col("rate").alias(f"{name}_rate"))
        out = out.join(lookup, name, "left").fillna({f"{name}_rate": default})
    return out
