"""Every operator as a named query over the star-schema test tables."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden import constants as C
from cardwarden import schemas
from cardwarden.functions import features as X
from cardwarden.functions import scalars as S
from cardwarden.operators import cleaning, dashboards, evaluation, joins, profiling, projections
from cardwarden.operators import quality
from cardwarden.operators.forest import (
    NODE_SCHEMA, Forest, ForestParams, anomaly_score, fit_forest, grow_forest, scaling, spread,
    stored_nodes, with_scores,
)
from cardwarden.operators.model_selection import (
    MODELS, compare_models, feature_importance, grid_search, stratified_split,
)
from cardwarden.plans.flagship import risk_ranking
from cardwarden.plans.selection import (
    first_rows, last_rows, latest_per_key, recent_per_key,
)
from cardwarden.session import path_exists, scratch_path, written
from cardwarden.sinks.daytable import DayTable
from cardwarden.sinks.feeds import as_feed
from cardwarden.sinks.outbox import Outbox
from cardwarden.sinks.tables import batch_days
from cardwarden.sources import events as ev
from cardwarden.sources import segments
from cardwarden.sources import views as V
from cardwarden.streaming.dimensions import card_table, start_upserts, user_table
from cardwarden.streaming.lifecycle import TrainingPolicy
from cardwarden.streaming.scoring import ScoringJob, new_session_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CATEGORIES = list(C.CATEGORY_RATES)
NUMBERS = ["TransactionAmt", "C1", "C13", "V314"]
RAW_COLUMNS = ["transaccionID", "usuarioID", "tarjetaID", "fecha_hora_transaccion",
               "TransactionAmt", "TransactionDT", "isFraud"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Doubles (or the named columns) rounded: what is summed or computed in an engine's own way."""
    return df.select(*[
        F.round(f.name, places).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and (columns is None or f.name in columns)
        else F.col(f.name) for f in df.schema.fields])


def _scored(spark: SparkSession, d: str, *more: str) -> DataFrame:
    tx = V.transactions(spark, d, "transaccionID", "usuarioID", "TransactionAmt",
                        "fecha_hora_transaccion", "isFraud", *more)
    return V.scored(tx)


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    return V.sparse(V.transactions(
        spark, d, "transaccionID", "TransactionAmt", "addr1", "ProductCD", "isFraud"))


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return V.alerts(_scored(spark, d))


def _stand_in_score() -> F.Column:
    amount = F.col("TransactionAmt")
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-5.0) * (amount - C.AMT_MEAN) / C.AMT_STD))
    return F.when(F.col("transaccionID").cast("bigint") % 100 == 0, F.lit(-1.0)).otherwise(raw)


def _enriched(spark: SparkSession, d: str, warmed_up: bool = True) -> DataFrame:
    tx = V.transactions(spark, d).withColumn("score", _stand_in_score())
    return projections.enriched_projection(tx, warmed_up, now=F.col("fecha_hora_transaccion"))


# --- sources ---------------------------------------------------------------------------


def _flawed(spark: SparkSession, d: str) -> DataFrame:
    fields = ("transaccionID", "usuarioID", "TransactionAmt", "C1", "isFraud")
    schema = T.StructType([f for f in schemas.TRANSACTION.fields if f.name in fields])
    return ev.parse_events(V.flawed_messages(V.transactions(spark, d, *fields)), schema)


@query
def parse_events_json(spark, d):
    return ev.accepted(_flawed(spark, d), "transaccionID")


@query
def quarantine_split(spark, d):
    return ev.quarantined(_flawed(spark, d), "transaccionID")


# --- projections -----------------------------------------------------------------------


@query
def raw_projection(spark, d):
    return projections.raw_projection(
        V.transactions(spark, d, *RAW_COLUMNS), F.col("fecha_hora_transaccion"))


@query
def enriched_projection(spark, d):
    return _enriched(spark, d)


@query
def alert_projection(spark, d):
    return projections.alert_projection(_enriched(spark, d), F.col("processed_at"))


@query
def cached_model_alerts(spark, d):
    """A model that is not warmed up marks rows suspicious but raises no alert."""
    rows = _enriched(spark, d, warmed_up=False)
    return rows.agg(F.count_if("is_suspicious").alias("suspicious"),
                    F.count_if(F.col("is_suspicious") & F.col("is_warmed_up")).alias("alerts"))


@query
def score_feed(spark, d):
    return projections.score_feed(_enriched(spark, d))


@query
def alert_feed(spark, d):
    alerts = projections.alert_projection(_enriched(spark, d), F.col("processed_at"))
    return as_feed(alerts.select("transaccionID", "TransactionAmt", "fraud_score", "isFraud_label",
                                 "alerted_at", "status"), "transaccionID")


@query
def keep_existing_columns(spark, d):
    tx = V.transactions(spark, d, "TransactionAmt", "C1", "isFraud")
    return cleaning.keep_existing(tx, ["TransactionAmt", "C1", "V999", "isFraud"])


@query
def drop_identifier_columns(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt", "isFraud")
    return cleaning.drop_identifiers(tx, ("isFraud", "TransactionID"))


@query
def anomaly_flags(spark, d):
    tx = _scored(spark, d)
    prediction = F.when(F.col("fraud_score") > 0.9, F.lit(-1)).otherwise(F.lit(1))
    return tx.select("transaccionID", S.anomaly_flag(prediction).alias("anomaly"))


# --- joins -----------------------------------------------------------------------------


@query
def profile_join(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "usuarioID", "TransactionAmt")
    joined = joins.with_profile(tx, V.profiles(spark, d), fill=True)
    return joined.select("transaccionID", "usuarioID", "TransactionAmt",
                                 "promedio_de_gastos", "varianza_de_gastos")


@query
def card_join(spark, d):
    order = [F.col("event_time"), F.col("seq")]
    joined = joins.with_latest_card(
        V.transactions(spark, d, "transaccionID", "usuarioID"), V.card_events(spark, d), order)
    return joined.select("transaccionID", "usuarioID", "card_tarjetaID", "card_card4", "card_card6")


@query
def card_left_join(spark, d):
    cards = V.card_events(spark, d)
    tx = V.transactions(spark, d, "transaccionID", "tarjetaID")
    return joins.with_card(tx, cards, ["card4", "card6"])


@query
def identity_left_join(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt", "isFraud")
    return joins.with_identity(tx, V.identities(spark, d))


@query
def dedupe_anti_join(spark, d):
    """First event per user, without the users already held (those with a negative balance)."""
    batch = V.table(spark, d, "events").select(
        F.col("user_id").alias("user"), "event_id", "ts", "value")
    stored = V.table(spark, d, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("user"))
    return joins.not_yet_stored(batch, stored, "user", [F.col("ts"), F.col("event_id")])


@query
def category_rate_lookup(spark, d):
    tx = V.transactions(spark, d).select("transaccionID", *CATEGORIES)
    return joins.with_category_rates(tx, joins.rate_table(spark), CATEGORIES)


# --- features and scalars --------------------------------------------------------------


@query
def engineered_features(spark, d):
    return X.with_engineered(
        V.transactions(spark, d, "transaccionID", "TransactionAmt", "C1", "D1"))


@query
def user_relative_features(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "usuarioID", "TransactionAmt")
    joined = joins.with_profile(tx, V.profiles(spark, d))
    return X.with_user_relative(joined).select(
        "transaccionID", "ratio_vs_user", "zscore_vs_user")


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    joined = joins.with_profile(V.transactions(spark, d), V.profiles(spark, d))
    return joined.select("transaccionID", *X.feature_columns())


@query
def feature_vector(spark, d):
    return _model_rows(spark, d)


@query
def feature_vector_length(spark, d):
    joined = joins.with_profile(V.transactions(spark, d), V.profiles(spark, d))
    return joined.select(F.size(X.feature_vector()).alias("entries")).groupBy("entries").agg(
        F.count("*").alias("n"))


@query
def rule_probability(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt", "V314")
    p = S.rule_probability(F.col("TransactionAmt"), F.col("V314"))
    return tx.select("transaccionID", p.alias("probability"),
                             S.is_suspicious(p, 0.1).alias("suspicious"))


@query
def sigmoid_score(spark, d):
    """Anomaly scores between -1 and 0 out of the amount, around a fixed offset."""
    raw = -F.lit(1.0) * (F.col("TransactionAmt") / (F.col("TransactionAmt") + 60))
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt").select("transaccionID", raw.alias("s"))
    offset = F.when(F.col("transaccionID").cast("bigint") % 9 == 0, F.lit(1e-12)).otherwise(
        F.lit(-0.55))
    return rounded(tx.select("transaccionID", S.anomaly_probability(F.col("s"), offset).alias("score")))


@query
def amt_ratio_log(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt")
    return rounded(X.with_amount_ratio(tx))


@query
def safe_casts(spark, d):
    o = V.table(spark, d, "orders")
    return o.select(
        "o_orderkey", S.safe_double(F.col("o_orderpriority"), 7.5).alias("bad_double"),
        S.safe_double(F.col("o_totalprice").cast("string")).alias("good_double"),
        S.safe_int(F.left("o_orderpriority", F.lit(1))).alias("good_int"),
        S.safe_int(F.col("o_orderstatus"), 1).alias("bad_int"))


@query
def clip_and_inflate(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt", "C1")
    return tx.select(
        "transaccionID", S.clip(F.col("TransactionAmt"), 5.0, 100.0).alias("clipped"),
        S.inflate_amount(F.col("TransactionAmt"), F.lit(8.0) * F.col("C1")).alias("inflated"))


@query
def hour_and_day_index(spark, d):
    seconds = F.col("TransactionDT") - 500000
    return V.transactions(spark, d, "transaccionID", "TransactionDT").select(
        "transaccionID", S.hour_of_day(seconds).alias("hour"), S.day_of_week(seconds).alias("day"))


@query
def email_domain(spark, d):
    c = V.table(spark, d, "customer")
    address = F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit("@mail"),
                       (F.col("c_nationkey")).cast("string"), F.lit(".example"))
    return c.select("c_custkey", S.email_domain(address).alias("domain"))


@query
def mask_card(spark, d):
    return V.card_events(spark, d).select("tarjetaID", S.mask_card(F.col("card_number")).alias("masked"))


@query
def expiry_format(spark, d):
    cards = V.card_events(spark, d)
    yymm = F.when(F.col("seq") % 10 != 0, F.col("expiry_yymm"))
    return cards.select("tarjetaID", S.expiry_text(yymm).alias("expiry"))


@query
def secret_round_trip(spark, d):
    """A short secret is encrypted and comes back; a long one is kept. Each card has its own key."""
    key = F.md5("tarjetaID")
    secret = F.when(F.col("seq") % 2 == 0, F.col("card_number")).otherwise(
        F.concat("card_number", "card_number", "card_number"))
    held = V.card_events(spark, d).select("tarjetaID", secret.alias("secret"))
    held = held.withColumn("stored", S.protect_secret(F.col("secret"), key))
    kept = F.col("stored") == F.col("secret")
    return held.select(
        "tarjetaID", kept.alias("kept"),
        F.when(kept, F.col("stored")).otherwise(S.reveal_secret(F.col("stored"), key)).alias("back"))


@query
def iso_timestamps(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_id", S.iso_text(F.col("ts")).alias("iso"))


@query
def label_encode(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "ProductCD", "card4", "DeviceInfo")
    return cleaning.label_encode(tx, ["ProductCD", "card4", "DeviceInfo"])


@query
def fill_defaults(spark, d):
    return cleaning.fill_profile_defaults(
        V.transactions(spark, d).select("transaccionID", *C.PROFILE_KEYS))


@query
def constant_fill(spark, d):
    return cleaning.fill_constant(_sparse(spark, d))


# --- cleaning and profiling ------------------------------------------------------------


@query
def fraud_rate(spark, d):
    return profiling.fraud_rate(V.transactions(spark, d, "isFraud"))


@query
def null_profile(spark, d):
    return cleaning.null_profile(_sparse(spark, d))


@query
def null_share_histogram(spark, d):
    """Ten bins over the null percentages of the columns that have gaps."""
    shares = cleaning.null_profile(_sparse(spark, d))
    return rounded(profiling.histogram(shares, "null_pct", 10))


@query
def sparse_column_count(spark, d):
    return cleaning.sparse_column_count(_sparse(spark, d))


@query
def drop_sparse(spark, d):
    return cleaning.drop_sparse(_sparse(spark, d))


@query
def median_impute(spark, d):
    rows = _sparse(spark, d).select("transaccionID", "amt_gap", "addr_sparse")
    return rounded(cleaning.impute_median(rows))


@query
def mode_impute(spark, d):
    return cleaning.impute_mode(
        _sparse(spark, d).select("transaccionID", "cat_gap"), ["cat_gap"])


@query
def clean_dataset(spark, d):
    return rounded(cleaning.clean(_sparse(spark, d)))


@query
def category_label_counts(spark, d):
    return profiling.category_label_counts(
        V.transactions(spark, d, "ProductCD", "card4", "card6", "isFraud"), ["ProductCD", "card4", "card6"])


@query
def label_counts(spark, d):
    return profiling.label_counts(V.transactions(spark, d, "isFraud"))


@query
def correlation_matrix(spark, d):
    """With a constant column, which correlates with nothing, and one with gaps."""
    columns = [*NUMBERS, "C7", "isFraud"]
    tx = V.transactions(spark, d, *columns).withColumns({
        "constant": F.lit(0.1), "gappy": F.when(F.col("C7") > 1, F.col("V314"))})
    return rounded(profiling.correlation_matrix(tx, [*columns, "constant", "gappy"]))


WIDE = 60


@query
def correlation_wide(spark, d):
    """Sixty derived columns with gaps; the last one is constant."""
    n = F.col("event_id")
    columns = [F.when((n + k) % (k + 3) != 0, F.lit(1.0) if k == WIDE - 1 else n * (k * 7 + 3) % (101 + k) / 2)
               .alias(f"w{k}") for k in range(WIDE)]
    return rounded(profiling.correlation_matrix(
        V.table(spark, d, "events").select(*columns), [f"w{k}" for k in range(WIDE)]))


@query
def describe_numeric(spark, d):
    return rounded(profiling.describe_numeric(V.transactions(spark, d, *NUMBERS), NUMBERS))


@query
def histogram_50(spark, d):
    return rounded(profiling.histogram(V.transactions(spark, d, "TransactionAmt"), "TransactionAmt", 50))


@query
def box_statistics(spark, d):
    return rounded(profiling.box_statistics(V.transactions(spark, d, *NUMBERS), NUMBERS))


@query
def iqr_outliers(spark, d):
    return profiling.outliers(
        V.transactions(spark, d, "transaccionID", "TransactionAmt"), "TransactionAmt")


@query
def mean_spend_per_card(spark, d):
    return profiling.mean_spend_per_card(V.transactions(spark, d, "card1", "TransactionAmt"))


@query
def mean_of_card_means(spark, d):
    return rounded(profiling.mean_of_card_means(V.transactions(spark, d, "card1", "TransactionAmt")))


@query
def fraud_by_hour(spark, d):
    return profiling.fraud_by_hour(V.transactions(spark, d, "TransactionDT", "isFraud"))


@query
def fraud_by_day(spark, d):
    return profiling.fraud_by_day(V.transactions(spark, d, "TransactionDT", "isFraud"))


@query
def top_cards(spark, d):
    return profiling.top_values(V.transactions(spark, d, "card1"), "card1", 10)


@query
def top_card_rows(spark, d):
    return profiling.rows_of_top_values(
        V.transactions(spark, d, "transaccionID", "card1"), "card1", 10)


@query
def spend_pivot(spark, d):
    tx = V.transactions(spark, d, "card1", "isFraud", "TransactionAmt")
    return rounded(profiling.spend_by_label(profiling.rows_of_top_values(tx, "card1", 10)))


@query
def numeric_profile(spark, d):
    return rounded(profiling.numeric_profile(V.transactions(spark, d, *NUMBERS), NUMBERS))


@query
def categorical_top5(spark, d):
    return profiling.categorical_profile(V.transactions(spark, d), CATEGORIES)


@query
def spending_profiles(spark, d):
    return profiling.spending_profiles(V.transactions(spark, d))


@query
def category_fraud_rates(spark, d):
    return profiling.learned_rates(V.transactions(spark, d), CATEGORIES)


# --- evaluation ------------------------------------------------------------------------


def _evaluable(spark, d):
    return evaluation.evaluable(_scored(spark, d))


@query
def evaluable_rows(spark, d):
    return _evaluable(spark, d).select("transaccionID", "fraud_score", "isFraud")


@query
def confusion_metrics(spark, d):
    predicted = evaluation.with_prediction(_evaluable(spark, d))
    return evaluation.classification_metrics(evaluation.confusion_counts(predicted))


@query
def class_report(spark, d):
    predicted = evaluation.with_prediction(_evaluable(spark, d))
    return evaluation.class_report(evaluation.confusion_counts(predicted))


@query
def roc_auc(spark, d):
    return evaluation.roc_auc(_evaluable(spark, d))


@query
def evaluation_summary(spark, d):
    return rounded(evaluation.evaluation_summary(_evaluable(spark, d)))


@query
def single_class_evaluation(spark, d):
    """Rows of one class: no metrics, no report, no area."""
    rows = _evaluable(spark, d).filter("isFraud = 0")
    measured = evaluation.classification_metrics(
        evaluation.confusion_counts(evaluation.with_prediction(rows)))
    report = evaluation.class_report(measured.select("tn", "fp", "fn", "tp"))
    return measured.select(
        "tn", "fp", "fn", "tp", "precision", "recall", "f1",
        report.agg(F.count("*").alias("n")).scalar().alias("report_rows"),
        evaluation.roc_auc(rows).scalar().alias("auc_roc"))


@query
def model_metrics_row(spark, d):
    when = F.expr("TIMESTAMP_NTZ'2024-02-01 00:00:00'")
    return evaluation.model_metrics(_evaluable(spark, d), evaluated_at=when)


# --- windows and ordering --------------------------------------------------------------


@query
def last_n_window(spark, d):
    e = V.table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return last_rows(e, ["ts", "event_id"], C.WINDOW_SIZE, F.date_trunc("hour", "ts"))


@query
def warmup_rows(spark, d):
    e = V.table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return first_rows(e, ["ts", "event_id"], C.WARMUP_SIZE, F.date_trunc("hour", "ts"))


@query
def latest_per_user(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return latest_per_key(e, ["user_id"], [F.col("ts"), F.col("event_id")])


@query
def recent_per_user(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return recent_per_key(e, ["user_id"], [F.col("ts"), F.col("event_id")], 5)


@query
def top_alerts(spark, d):
    alerts = _alerts(spark, d).select("transaccionID", "fraud_score", "processed_at", "status")
    return dashboards.top_alerts(alerts, 50, time="processed_at")


@query
def latest_alerts(spark, d):
    alerts = _alerts(spark, d).select("transaccionID", "fraud_score", "processed_at", "status")
    return dashboards.latest_alerts(alerts, 50, time="processed_at")


# --- monitoring and quality --------------------------------------------------------------


@query
def batch_counters(spark, d):
    return dashboards.batch_counters(_enriched(spark, d))


@query
def fraud_rate_drift(spark, d):
    return dashboards.fraud_rate_drift(V.transactions(spark, d, "fecha_hora_transaccion", "isFraud"))


@query
def dimension_breakdown(spark, d):
    return dashboards.dimension_breakdown(
        _scored(spark, d, "card4", "DeviceType", "P_emaildomain"),
        ["card4", "DeviceType", "P_emaildomain"])


@query
def alert_triage(spark, d):
    return dashboards.alert_triage(_alerts(spark, d))


@query
def handled_share(spark, d):
    return dashboards.handled_share(_alerts(spark, d))


def _suspect_records(spark, d):
    """Raw records as text with planted flaws: no amount, text amount, label 2."""
    n = F.col("transaccionID").cast("bigint")
    tx = V.transactions(spark, d, *RAW_COLUMNS)
    return tx.select(
        "transaccionID", "usuarioID", "tarjetaID",
        F.col("fecha_hora_transaccion").cast("string").alias("fecha_hora_transaccion"),
        F.when(n % 31 == 0, F.lit(None).cast("string")).when(n % 37 == 0, F.lit("many"))
        .otherwise(F.col("TransactionAmt").cast("string")).alias("TransactionAmt"),
        F.col("TransactionDT").cast("string").alias("TransactionDT"),
        F.when(n % 41 == 0, F.lit("2")).otherwise(F.col("isFraud").cast("string")).alias("isFraud"))


@query
def schema_violations(spark, d):
    return quality.schema_violations(_suspect_records(spark, d), "transactions_raw", "transaccionID")


@query
def violation_counts(spark, d):
    return quality.violation_counts(_suspect_records(spark, d), "transactions_raw", "transaccionID")


@query
def unique_key_violations(spark, d):
    return quality.duplicate_keys(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def retention_filter(spark, d):
    """Raw rows within 30 days of a date 20 days after the last event's month began."""
    tx = V.transactions(spark, d, "transaccionID", "fecha_hora_transaccion")
    now = F.expr("TIMESTAMP_NTZ'2024-02-10 00:00:00'")
    return quality.within_retention(tx, "transactions_raw", now)


# --- models ----------------------------------------------------------------------------


@query
def split_test_rows(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "isFraud")
    return stratified_split(tx, "transaccionID")


@query
def forest_nodes(spark, d):
    rows = written(_model_rows(spark, d), "training-rows")
    forest = grow_forest(rows, "transaccionID", schemas.FEATURE_NAMES)
    return stored_nodes(forest, scratch_path(spark, "nodes")).nodes


@query
def forest_scores(spark, d):
    rows = written(_model_rows(spark, d), "training-rows")
    forest = fit_forest(rows, "transaccionID", schemas.FEATURE_NAMES)
    return with_scores(spread(rows), forest).select(
        "transaccionID", "anomaly_score", "decision", "prediction", "score")


@query
def forest_alerts(spark, d):
    rows = written(_model_rows(spark, d), "training-rows")
    forest = fit_forest(rows, "transaccionID", schemas.FEATURE_NAMES)
    scored = with_scores(spread(rows), forest).select("transaccionID", "score")
    tx = V.transactions(spark, d).join(scored, "transaccionID")
    enriched = projections.enriched_projection(tx, True, now=F.col("fecha_hora_transaccion"))
    return projections.alert_projection(enriched, F.col("processed_at"))


@query
def scaling_stats(spark, d):
    """Mean and population deviation per feature, as the forest scales by them."""
    _, means, stds = scaling(_model_rows(spark, d), schemas.FEATURE_NAMES)
    short = lambda c: F.when(F.abs(c) < 1000, F.round(c, 4)).otherwise(F.round(c, 1)).alias(c)
    return spark.createDataFrame(
        list(zip(schemas.FEATURE_NAMES, means, stds)), "feature string, mean double, std double",
    ).select("feature", short("mean"), short("std"))


# fixed values: (tree, node, feature, cut, left, right, rows, depth, path length)
FIXED_NODES = [
    (0, 0, "TransactionAmt", 100.0, 1, 2, 256, 0, 0.0), (0, 1, None, None, -1, -1, 200, 1, 11.5),
    (0, 2, "C13", 150.0, 3, 4, 56, 1, 0.0), (0, 3, None, None, -1, -1, 40, 2, 7.25),
    (0, 4, None, None, -1, -1, 16, 2, 2.5),
    (1, 0, "V314", 400.0, 1, 2, 256, 0, 0.0), (1, 1, None, None, -1, -1, 205, 1, 10.0),
    (1, 2, None, None, -1, -1, 51, 1, 3.0),
    (2, 0, "ratio_vs_user", 1.5, 1, 2, 256, 0, 0.0), (2, 1, None, None, -1, -1, 220, 1, 12.0),
    (2, 2, None, None, -1, -1, 36, 1, 1.75),
]
FIXED_OFFSET = -0.6


def fixed_forest(spark: SparkSession) -> Forest:
    """Three small trees given by hand, so that scores have a closed form."""
    names = schemas.FEATURE_NAMES
    nodes = spark.createDataFrame([
        (t, n, names.index(f) if f else -1, float("inf") if cut is None else cut, left, right, size, depth, path)
        for t, n, f, cut, left, right, size, depth, path in FIXED_NODES], NODE_SCHEMA)
    return Forest(nodes, names, [0.0] * len(names), [1.0] * len(names), 256, 256,
                  ForestParams(trees=3, max_samples=256), FIXED_OFFSET)


@query
def fixed_forest_scores(spark, d):
    scored = with_scores(_model_rows(spark, d), fixed_forest(spark))
    return rounded(scored.select("transaccionID", "anomaly_score", "decision", "prediction", "score"))


@query
def forest_contract(spark, d):
    """Per tree: the rows at its root, the rows in its leaves, and whether it keeps the height limit."""
    rows = written(_model_rows(spark, d), "training-rows")
    forest = grow_forest(rows, "transaccionID", schemas.FEATURE_NAMES)
    at_root = F.max(F.when(F.col("node_id") == 0, F.col("size")))
    return forest.nodes.groupBy("tree_id").agg(
        at_root.cast("bigint").alias("root_rows"),
        F.sum(F.when(F.col("left") < 0, F.col("size"))).alias("leaf_rows"),
        (F.max("depth") <= F.ceil(F.log2(at_root))).alias("within_height"))


@query
def offset_share(spark, d):
    """The offset lies at the rank of the contamination among all training scores."""
    rows = written(_model_rows(spark, d), "training-rows")
    params = ForestParams(trees=40, max_samples=256)
    forest = fit_forest(rows, "transaccionID", schemas.FEATURE_NAMES, params)
    scores = spread(rows).select(anomaly_score(forest).alias("s"))
    counts = scores.agg(F.count("*").alias("n"), F.count_if(F.col("s") < forest.offset).alias("below"),
                        F.count_if(F.col("s") <= forest.offset).alias("upto"))
    rank = F.floor((F.col("n") - 1) * params.contamination) + 1
    return counts.select("n", ((F.col("below") <= rank) & (F.col("upto") >= rank)).alias("at_rank"))


@query
def grid_contract(spark, d):
    """The settings of the grid and the test rows behind each."""
    return grid_search(V.transactions(spark, d), "transaccionID", trees=(10, 30)).drop("f1")


@query
def comparison_contract(spark, d):
    """Names, sizes and test rows of all models of the comparison, with small forests."""
    small = {name: (columns, 10, samples, share) for name, (columns, _, samples, share) in MODELS.items()}
    rows = compare_models(V.transactions(spark, d), "transaccionID", IGNORED, small)
    return rows.select("model", "n_features", "trees", "sample_size", (F.col("tp") + F.col("fn")).alias("frauds"),
                       (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("test_rows"))


IGNORED = ["usuarioID", "tarjetaID", "terminalID", "fecha_hora_transaccion"]


@query
def model_comparison(spark, d):
    return compare_models(V.transactions(spark, d), "transaccionID", IGNORED)


@query
def grid_search_f1(spark, d):
    return grid_search(V.transactions(spark, d), "transaccionID")


@query
def feature_importances(spark, d):
    return feature_importance(V.transactions(spark, d), "transaccionID", IGNORED)


@query
def importance_contract(spark, d):
    """Two planted columns among the others: the one that tells the label ranks first, a constant has no weight."""
    tx = V.transactions(spark, d, "transaccionID", "TransactionAmt", "C1", "C13", "V314", "card4", "isFraud").withColumns({
        "decisive": F.col("isFraud") * 10 + F.pmod(F.xxhash64("transaccionID"), F.lit(7)), "constant": F.lit(1)})
    ranked = feature_importance(tx, "transaccionID", trees=5, depth=4)
    return ranked.agg(
        F.max_by("feature", "importance").alias("first"), F.count("*").alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("shares"),
        F.max(F.when(F.col("feature") == "constant", F.col("importance"))).alias("of_the_constant"))


# --- streams ---------------------------------------------------------------------------

ONCE = {"availableNow": True}


#: Files of one micro-batch of a fixture, and events of the table for each once there are more.
FILES, EVENTS_PER_FILE = 4, 250_000


def _message_batches(spark: SparkSession, d: str, folder: str, batches: list[DataFrame]) -> DataFrame:
    """Message frames (``offset``, ``value``) as a stream with one micro-batch each, in order.

    Every batch has the same number of files, dealt evenly, which grows with the table; rows arrive in the
    order of their offsets.
    """
    path = os.path.join(folder, "messages")
    files = max(FILES, V.table(spark, d, "events").count() // EVENTS_PER_FILE)
    for number, rows in enumerate(batches):
        dealt = rows.select(F.lit(0).alias("partition"), "offset", "value").repartition(files)
        dealt.write.parquet(os.path.join(path, str(number)))
    return ev.read_events(spark, "parquet", {"maxFilesPerTrigger": str(files)}, os.path.join(path, "*"),
                          T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
                                        T.StructField("value", T.StringType())]))


def _messages(tx: DataFrame, again: int = 0) -> DataFrame:
    """Transactions as messages whose offset is the event's number, later for a copy sent again."""
    number = F.get_json_object("value", "$.transaccionID").cast("bigint")
    return V.as_messages(tx).withColumn("offset", number + F.lit(again << 40))


def _quarters(spark: SparkSession, d: str) -> list[DataFrame]:
    """All transactions as messages in four batches of about eight days each; the first takes all earlier ones."""
    tx = V.transactions(spark, d)
    part = F.greatest(F.least(F.expr("D1 div 8"), F.lit(3)), F.lit(0))
    return [_messages(tx.filter(part == k)) for k in range(4)]


def _run(job: ScoringJob, stream: DataFrame) -> ScoringJob:
    job.start(stream, os.path.join(job.folder, "checkpoint"), ONCE).awaitTermination()
    return job


NEVER = TrainingPolicy(warmup_size=10**9, window_size=10**9)


def _training_once(spark: SparkSession, label: str) -> ScoringJob:
    """A session that trains after its first batch; at threshold 0 every scored row is suspicious."""
    return ScoringJob(spark, scratch_path(spark, label), threshold=0.0,
                      forest=ForestParams(trees=10, max_samples=64),
                      policy=TrainingPolicy(warmup_size=100, retrain_seconds=1e9))


def _scored_by_fixed_forest(spark: SparkSession, d: str) -> ScoringJob:
    """The scoring stream over all transactions in four batches, with profiles and a stored model."""
    folder = scratch_path(spark, "stream-scored")
    profiles = written(V.profiles(spark, d), "profiles")
    job = ScoringJob(spark, folder, profiles=lambda: profiles, policy=NEVER)
    job.models.save(fixed_forest(spark), "an earlier session", 0.0)
    return _run(job, _message_batches(spark, d, folder, _quarters(spark, d)))


@query
def stream_scored(spark, d):
    """The scoring stream with profiles and a stored model, which scores but raises no alert."""
    return _scored_by_fixed_forest(spark, d).table("transactions_enriched").select(
        "transaccionID", "usuarioID", "TransactionAmt", "zscore_amt", "velocity", "amt_distance",
        "fraud_score", "is_suspicious", "is_warmed_up", "model_version", "isFraud")


@query
def session_counters(spark, d):
    """Running totals of the session after each of its four batches."""
    job = _scored_by_fixed_forest(spark, d)
    return dashboards.session_counters(job.table("batch_log")).drop("session_id").withColumn(
        "batch_id", F.col("batch_id").cast("bigint"))


@query
def stream_alerts(spark, d):
    """Alerts of a session that has trained after its first batch."""
    job = _training_once(spark, "stream-alerts")
    _run(job, _message_batches(spark, d, job.folder, _quarters(spark, d)))
    return job.table("fraud_alerts").select(
        "transaccionID", "usuarioID", "TransactionAmt", "isFraud_label", "status")


@query
def stream_dedupe_two_batches(spark, d):
    """Three batches over all days with repeated ids, within a batch too: the first one stays."""
    folder = scratch_path(spark, "stream-dedupe")
    n = F.col("transaccionID").cast("bigint") % 3
    tx = V.transactions(spark, d)
    twice = tx.withColumn("TransactionAmt", F.col("TransactionAmt") * 2)
    batches = [_messages(tx.filter(n == 0)), _messages(twice.filter(n == 0)).unionByName(_messages(tx.filter(n == 1), 1)),
               _messages(twice).unionByName(_messages(tx, 1))]
    job = _run(ScoringJob(spark, folder, policy=NEVER), _message_batches(spark, d, folder, batches))
    raw, enriched = (job.table(t).select("transaccionID", "TransactionAmt") for t in (
        "transactions_raw", "transactions_enriched"))
    return raw.withColumnRenamed("TransactionAmt", "raw_amount").join(enriched, "transaccionID", "full")


@query
def stream_dedupe_stateful(spark, d):
    """Ids that come back in later batches under other days or without one: the first message of each stays.

    The state of the stream knows them; the stored days that a batch looks at do not.
    """
    folder = scratch_path(spark, "stream-stateful")
    n = F.col("transaccionID").cast("bigint") % 3
    tx = V.transactions(spark, d)
    moved = tx.withColumns({"TransactionAmt": F.col("TransactionAmt") * 2,
                            "fecha_hora_transaccion": F.expr("fecha_hora_transaccion + interval 3 days")})
    undated = tx.withColumn("fecha_hora_transaccion", F.lit(None).cast("timestamp_ntz"))
    batches = [_messages(tx.filter(n == 0)), _messages(moved.filter(n == 0)).unionByName(_messages(undated.filter(n == 1), 1)),
               _messages(tx.filter(n == 1)).unionByName(_messages(undated.filter(n == 1), 1)).unionByName(_messages(moved, 2))]
    job = _run(ScoringJob(spark, folder, policy=NEVER, feeds=()), _message_batches(spark, d, folder, batches))
    return job.table("transactions_raw").select("transaccionID", "TransactionAmt", "day")


@query
def day_table_compaction(spark, d):
    """A table written in six micro-batches, small files merged meanwhile: rows, keys and files per day."""
    table = DayTable(spark, scratch_path(spark, "day-table"), None, max_files=3, grace_seconds=0)
    tx = written(V.transactions(spark, d, "transaccionID", "TransactionAmt", "fecha_hora_transaccion"), "rows").withColumn(
        "day", F.to_date("fecha_hora_transaccion"))
    for number in range(6):
        table.append(tx.filter(F.col("transaccionID").cast("bigint") % 6 == number), "a writer", number)
    files = table.read().groupBy("day").agg(
        F.count("*").alias("n"), F.countDistinct("transaccionID").alias("keys"), F.round(F.sum("TransactionAmt"), 2).alias("amount"),
        (F.countDistinct("_metadata.file_path") <= 3).alias("few_files"))
    return files


@query
def day_table_lookup(spark, d):
    """Transactions that a table written in three batches does not hold; key filters say which files to open."""
    table = DayTable(spark, scratch_path(spark, "day-table"), "transaccionID")
    number = F.col("transaccionID").cast("bigint")
    tx = written(V.transactions(spark, d, "transaccionID", "usuarioID", "fecha_hora_transaccion"), "rows").withColumn(
        "day", F.to_date("fecha_hora_transaccion"))
    for batch in range(3):
        table.append(tx.filter((number % 4 == 0) & (number % 3 == batch)), "a writer", batch)
    return table.not_stored(tx, "another", 0, batch_days(tx)).drop("day")


@query
def outbox_replay(spark, d):
    """Flagged transactions through an outbox to an append-only sink: batches repeated, marks lost after sending."""
    outbox = Outbox(spark, scratch_path(spark, "outbox"))
    topic = os.path.join(outbox.path, "topic")
    number = F.col("transaccionID").cast("bigint")
    flagged = written(V.transactions(spark, d, "transaccionID", "isFraud", "TransactionAmt").filter("isFraud = 1"), "flagged")

    def send(rows: DataFrame, and_die: bool = False) -> None:
        rows.write.mode("append").parquet(topic)
        if and_die:
            raise InterruptedError

    def sent() -> int | None:
        return spark.read.parquet(topic).agg(F.max("number")).first()[0] if path_exists(spark, topic) else None

    for batch in range(3):
        rows = as_feed(flagged.filter(number % 3 == batch), "transaccionID")
        outbox.put(rows, "a writer", batch)
        try:
            outbox.publish(lambda due: send(due, and_die=True), sent)
        except InterruptedError:
            outbox.put(rows, "a writer", batch)
        outbox.publish(send, sent)
    return spark.read.parquet(topic).select("number", F.col("key").alias("transaccionID"))


@query
def stream_quarantine(spark, d):
    """Unreadable and wrong-typed messages, sent twice and kept once."""
    folder = scratch_path(spark, "stream-quarantine")
    fields = ("transaccionID", "usuarioID", "TransactionAmt", "C1", "isFraud")
    flawed = V.flawed_messages(V.transactions(spark, d, *fields)).filter("value is not null").withColumn(
        "offset", F.pmod(F.xxhash64("value"), F.lit(1 << 40)))
    job = _run(ScoringJob(spark, folder, policy=NEVER), _message_batches(spark, d, folder, [flawed, flawed]))
    return job.table("quarantine").select("transaccionID", "record", "reason")


@query
def stored_key_violations(spark, d):
    """Rows and distinct keys of the five stored tables with a unique key, after repeated input."""
    job, quarters = _training_once(spark, "stored-keys"), _quarters(spark, d)
    _run(job, _message_batches(spark, d, job.folder, [*quarters, quarters[1]]))
    users, cards = user_table(spark, job.path("users")), card_table(spark, job.path("cards"))
    user = F.col("user_id").cast("string")
    events = V.table(spark, d, "events").select(
        F.col("event_id").alias("arrival"), user.alias("usuarioID"), F.concat(F.lit("CRD_"), user).alias("tarjetaID"))
    for table in (users, cards):
        missing = {f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in events.columns}
        for number in range(2):
            table.upsert(events.withColumns(missing), "a session", number)
    return quality.stored_key_violations({
        "user_profiles": users.snapshot(), "cards": cards.snapshot(),
        **{t: job.table(t) for t in ("transactions_raw", "transactions_enriched", "fraud_alerts")}})


@query
def stream_dimension_upsert(spark, d):
    """User messages, one per event, kept as the latest row per user."""
    folder = scratch_path(spark, "stream-users")
    e = V.event_stream(spark, d)
    message = F.struct(
        F.col("user_id").cast("string").alias("usuarioID"), F.col("event_type").alias("usuario"),
        F.col("value").alias("promedio_de_gastos"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fecha_nacimiento"),
        F.when(F.col("event_id") % 2 == 0, F.lit("mail@host.example")).alias("email"))
    table = user_table(spark, os.path.join(folder, "users"))
    messages = e.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
                        F.to_json(message).alias("value"))
    start_upserts(messages, schemas.USER, table,
                  os.path.join(folder, "checkpoint"), ONCE).awaitTermination()
    return table.snapshot().select(
        "usuarioID", "usuario", "promedio_de_gastos", "fecha_nacimiento", "email")


@query
def stream_card_upsert(spark, d):
    """Card messages, one per event, under the card of the user's last digit of the event."""
    folder = scratch_path(spark, "stream-cards")
    e = V.event_stream(spark, d)
    message = F.struct(
        F.concat_ws("-", F.lit("CRD"), "user_id", F.col("event_id") % 2).alias("tarjetaID"),
        F.col("user_id").cast("string").alias("usuarioID"),
        F.col("event_type").alias("card4"), F.col("event_id").cast("int").alias("card1"))
    messages = e.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
                        F.to_json(message).alias("value"))
    table = card_table(spark, os.path.join(folder, "cards"))
    start_upserts(messages, schemas.CARD, table, os.path.join(folder, "checkpoint"), ONCE,
                  compact_every=1).awaitTermination()
    return table.snapshot().select("tarjetaID", "usuarioID", "card4", "card1")


@query
def segment_stream(spark, d):
    """Events as a topic of three partitions, read in bounded batches: each message once, in the order of its partition."""
    folder = scratch_path(spark, "segments").removeprefix("file://")
    events = V.table(spark, d, "events").select("event_id", F.col("user_id"), F.col("event_id").cast("string").alias("value"))
    total = events.count()
    segments.write_segments(events, os.path.join(folder, "topic"), F.col("user_id") % 3, ["event_id"], 1 + total // 10)
    most = 1 + total // 4
    options = {**ev.kafka_options("", "topic", most), "path": folder, "startingOffsets": "earliest",
               "progressFile": os.path.join(folder, "progress.json")}
    stream = ev.read_events(spark, segments.register(spark), options)
    taken = os.path.join(folder, "taken")
    job = stream.writeStream.foreachBatch(lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode(
        "overwrite").parquet(os.path.join(taken, f"batch={number}"))).option(
        "checkpointLocation", os.path.join(folder, "checkpoint")).trigger(processingTime="0 seconds").start()
    try:  # one call waits for one bounded batch
        while job.isActive and sum(p["numInputRows"] for p in job.recentProgress) < total:
            job.processAllAvailable()
            time.sleep(0.05)
    finally:
        job.stop()
    rows = spark.read.parquet(taken)
    sizes = rows.groupBy("batch").agg((F.count("*") <= most).alias("bounded"))
    return rows.join(sizes, "batch").select("partition", "offset", F.col("value").cast("bigint").alias("event_id"), "bounded")


@query
def stream_fraud_rate(spark, d):
    """Fraud rate per day over the stream, the days still open included."""
    folder = scratch_path(spark, "stream-rate")
    tx = V.transactions_from(
        V.event_stream(spark, d), None, ("fecha_hora_transaccion", "isFraud"))
    rates = dashboards.rate_table(spark, os.path.join(folder, "rates"))
    dashboards.start_fraud_rates(tx, "fecha_hora_transaccion", rates, os.path.join(folder, "checkpoint"),
                                 new_session_id(), ONCE).awaitTermination()
    return rates.snapshot()


@query
def lifecycle_run(spark, d):
    """No model in the first batch, then a new version for each of the other three."""
    folder = scratch_path(spark, "lifecycle")
    profiles = written(V.profiles(spark, d), "profiles")
    job = ScoringJob(spark, folder, profiles=lambda: profiles, forest=ForestParams(trees=20, max_samples=256),
                     policy=TrainingPolicy(warmup_size=100, retrain_seconds=0))
    _run(job, _message_batches(spark, d, folder, _quarters(spark, d)))
    return job.table("transactions_enriched").groupBy("model_version", "is_warmed_up").agg(
        F.count("*").alias("n"), F.count("fraud_score").alias("scored"))


@query
def flagship(spark, d):
    tx = V.transactions(spark, d, "transaccionID", "usuarioID", "fecha_hora_transaccion",
                        "TransactionAmt", "C1", "D1", "V314")
    return risk_ranking(tx, V.profiles(spark, d))
