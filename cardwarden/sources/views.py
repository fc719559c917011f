"""Adapter views: the entities of the data model derived from the star-schema test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden import constants as C
from cardwarden.functions.scalars import exact_mean, exact_variance


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


TRANSACTION_COLUMNS = {
    "transaccionID": "cast(event_id as string)",
    "fecha_hora_transaccion": "ts",
    "usuarioID": "cast(user_id as string)",
    "terminalID": "concat('TER_', cast(event_id % 97 as string))",
    "tarjetaID": "concat('CRD_', cast(user_id as string))",
    "TransactionAmt": "value",
    "TransactionDT": "seconds",
    "card1": "cast(user_id % 17397 + 1000 as int)",
    "addr1": "cast(c_nationkey as double)",
    "addr2": "cast(c_nationkey % 7 + 80 as double)",
    "C1": "k",
    "C13": "cast((k * 3 + event_id) % 200 as int)",
    "D1": "cast(seconds div 86400 as int)",
    "V314": "(event_id * 37 % 1000) / 2D",
    "V201": "cast(event_id % 3 as double)",
    "V243": "cast(event_id % 5 as double)",
    "V257": "cast(k % 4 as double)",
    "C7": "cast(k % 5 as int)",
    "V242": "cast(user_id % 3 as double)",
    "V45": "(event_id % 11) / 4D",
    "V246": "(k % 7) / 2D",
    "V200": "cast(event_id % 2 as double)",
    "V258": "(k % 9) / 4D",
    "C14": "cast(event_id % 50 as int)",
    "ProductCD": (
        "case event_type when 'purchase' then 'W' when 'view' then 'C'"
        " when 'click' then 'R' when 'signup' then 'H' else event_type end"),
    "card4": (
        "case user_id % 5 when 0 then 'visa' when 1 then 'mastercard'"
        " when 2 then 'american express' when 3 then 'discover' end"),
    "card6": (
        "case user_id % 4 when 0 then 'debit' when 1 then 'credit'"
        " when 2 then 'debit or credit' when 3 then 'charge card' end"),
    "P_emaildomain": (
        "case user_id % 7 when 0 then 'gmail.com' when 1 then 'yahoo.com'"
        " when 2 then 'hotmail.com' when 3 then 'anonymous.com' when 4 then 'aol.com'"
        " when 5 then 'mail.example' end"),
    "DeviceType": (
        "case c_mktsegment when 'MACHINERY' then 'desktop'"
        " when 'BUILDING' then 'desktop' when 'AUTOMOBILE' then 'mobile'"
        " when 'HOUSEHOLD' then 'mobile' end"),
    "DeviceInfo": (
        "case event_id % 6 when 0 then 'Windows' when 1 then 'iOS Device'"
        " when 2 then 'MacOS' when 3 then 'Trident/7.0' when 4 then 'rv:11.0' end"),
    "isFraud": "case when event_id % 29 = 0 then 1 else 0 end",
}


OWNER_COLUMNS = {"addr1", "addr2", "DeviceType"}


def transactions_from(events: DataFrame, customer: DataFrame | None,
                      columns: tuple[str, ...] = ()) -> DataFrame:
    """One transaction per event; works on a static or a streaming ``events``.

    Name the columns a query needs: without an owner column the customer join is left out.
    """
    timed = events.selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "cast(get_json_object(props, '$.k') as int) as k",
        "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) as seconds")
    if not columns or OWNER_COLUMNS & set(columns):
        owner = customer.selectExpr("c_custkey as user_id", "c_nationkey", "c_mktsegment")
        timed = timed.join(owner, "user_id", "left")
    return timed.select(*[F.expr(e).alias(c) for c, e in TRANSACTION_COLUMNS.items()
                          if not columns or c in columns])


def transactions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return transactions_from(
        table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"), columns)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending statistics of four users in five; the fifth has none, so that lookups miss too."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("user_id") % 5 != 0)
        .groupBy(F.col("user_id").cast("string").alias("usuarioID"))
        .agg(exact_mean(F.col("value")).alias("promedio_de_gastos"),
             exact_variance(F.col("value")).alias("varianza_de_gastos"))
    )


def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card messages out of orders: a user may own several, the last one counts."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("CRD_"), F.col("o_orderkey").cast("string")).alias("tarjetaID"),
        F.col("o_custkey").cast("string").alias("usuarioID"),
        F.col("o_orderstatus").alias("card6"),
        F.col("o_orderpriority").alias("card4"),
        F.lpad((F.col("o_orderkey") * 7919 % 100000000).cast("string"), 8, "0").alias("card_number"),
        F.date_format("o_orderdate", "yyMM").alias("expiry_yymm"),
        F.col("o_orderdate").alias("event_time"),
        F.col("o_orderkey").alias("seq"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity attributes of the open orders' transactions; the others are the join's misses."""
    return (
        table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "O")
        .select(F.col("o_orderkey").cast("string").alias("transaccionID"),
                F.col("o_orderpriority").alias("id_01"),
                F.col("o_totalprice").alias("id_02"))
    )


def sparse(tx: DataFrame) -> DataFrame:
    """Columns with gaps: 30 %, 90 % and one row in seven."""
    n = F.col("transaccionID").cast("bigint")
    return tx.select(
        "transaccionID",
        F.when(n % 10 >= 3, F.col("TransactionAmt")).alias("amt_gap"),
        F.when(n % 10 == 0, F.col("addr1")).alias("addr_sparse"),
        F.when(n % 7 != 0, F.col("ProductCD")).alias("cat_gap"),
        "isFraud",
    )


def scored(tx: DataFrame) -> DataFrame:
    """Transactions under a deterministic stand-in score."""
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(
        F.lit(-5.0) * (F.col("TransactionAmt") - F.lit(C.AMT_MEAN)) / F.lit(C.AMT_STD)))
    kept = ["transaccionID", "usuarioID", "tarjetaID", "ProductCD", "card4", "DeviceType",
            "P_emaildomain", "TransactionAmt"]
    return tx.select(
        *[c for c in kept if c in tx.columns],
        F.col("fecha_hora_transaccion").alias("processed_at"), "isFraud",
        F.round(raw, 4).alias("fraud_score"),
        (F.col("transaccionID").cast("bigint") >= 500).alias("is_warmed_up"),
    )


def alerts(scored_df: DataFrame) -> DataFrame:
    """Suspicious, warmed-up rows with a derived review workflow."""
    slot = F.col("transaccionID").cast("bigint") % 10
    return scored_df.filter((F.col("fraud_score") >= 0.5) & F.col("is_warmed_up")).withColumns({
        "status": F.when(slot < 3, "flagged").when(slot == 3, "blocked")
        .when(slot == 4, "dismissed").otherwise("confirmed_fraud"),
        "review_minutes": F.when(slot >= 3, F.col("transaccionID").cast("bigint") % 56 + 5),
    })


def as_messages(tx: DataFrame) -> DataFrame:
    """Transactions as JSON text messages in a ``value`` column."""
    stamped = tx.withColumn(
        "fecha_hora_transaccion", F.date_format("fecha_hora_transaccion", "yyyy-MM-dd HH:mm:ss"))
    return stamped.select(F.to_json(F.struct("*")).alias("value"))


def flawed_messages(tx: DataFrame) -> DataFrame:
    """Messages of which some are not JSON, some hold a wrong-typed field and some are null."""
    n = F.col("transaccionID").cast("bigint") % 50
    good = F.to_json(F.struct("transaccionID", "usuarioID", "TransactionAmt", "C1", "isFraud"))
    bad = F.to_json(F.struct(
        "transaccionID", "usuarioID", F.lit("x").alias("TransactionAmt"), "C1", "isFraud"))
    return tx.select(
        F.when(n == 0, F.concat(F.lit("not json "), F.col("transaccionID")))
        .when(n == 1, bad).when(n == 2, F.lit(None).cast("string")).otherwise(good).alias("value")
    )


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(os.path.join(sf_dir, "events.parque[t]"))
    )
