"""Hand-computed rows for null, default and edge rules."""

import pytest
from pyspark.sql import functions as F

from cardwarden.functions import features as X
from cardwarden.functions import scalars as S

ONE = "a double, b double, c1 int, d1 int, s string"


def value(spark, column, row=(None, None, None, None, None)):
    return spark.createDataFrame([row], ONE).select(column.alias("v")).first()["v"]


def test_missing_amount_counts_as_zero(spark):
    assert value(spark, S.zscore_amt(F.col("a"))) == -0.5646
    assert value(spark, S.amt_distance(F.col("a"))) == 0.5646


@pytest.mark.parametrize("days", [None, 0, -3, 1])
def test_velocity_history_is_at_least_a_day(spark, days):
    assert value(spark, S.velocity(F.col("c1"), F.col("d1")), (None, None, 6, days, None)) == 6.0


def test_velocity_without_count(spark):
    assert value(spark, S.velocity(F.col("c1"), F.col("d1")), (None, None, None, 4, None)) == 0.0


def test_no_profile_uses_dataset_constants(spark):
    none = F.lit(None).cast("double")
    amount = F.lit(135.027)
    assert value(spark, S.ratio_vs_user(amount, none)) == 1.0
    assert value(spark, S.zscore_vs_user(amount, none, none)) == 0.0


def test_tiny_mean_and_variance_are_floored(spark):
    assert value(spark, S.ratio_vs_user(F.lit(5.0), F.lit(0.2))) == 5.0
    assert value(spark, S.zscore_vs_user(F.lit(5.0), F.lit(0.2), F.lit(0.0))) == 4.8


def test_category_rates(spark):
    rows = spark.createDataFrame([("W",), ("Z",), (None,)], "ProductCD string")
    got = [r[0] for r in rows.select(X.category_rate("ProductCD")).collect()]
    assert got == [0.031, 0.035, 0.035]


def test_safe_casts(spark):
    assert value(spark, S.safe_double(F.lit("x"), 2.5)) == 2.5
    assert value(spark, S.safe_double(F.lit("3.25"))) == 3.25
    assert value(spark, S.safe_int(F.lit("3.7"), 9)) == 9
    assert value(spark, S.safe_int(F.lit(3.7))) == 3


@pytest.mark.parametrize("score,offset,expected", [
    (-0.5, -0.5, 0.5), (-0.3, 1e-12, 0.5), (-0.5, -0.4, 0.7773), (0.0, -0.4, 0.0067),
])
def test_anomaly_probability(spark, score, offset, expected):
    got = value(spark, F.round(S.anomaly_probability(F.lit(score), F.lit(offset)), 4))
    assert got == expected


def test_probability_stays_in_range_for_huge_exponents(spark):
    assert value(spark, S.anomaly_probability(F.lit(1e9), F.lit(-1e-9))) == 0.0
    assert value(spark, S.anomaly_probability(F.lit(-1e9), F.lit(-1e-9))) == 1.0


@pytest.mark.parametrize("score,expected", [
    (0.5, True), (0.49999, False), (-1.0, False), (1.0, True)])
def test_suspicion(spark, score, expected):
    assert value(spark, S.is_suspicious(F.lit(score))) is expected


def test_suspicion_of_a_missing_score(spark):
    assert value(spark, S.is_suspicious(F.col("a"))) is False
    assert value(spark, S.is_suspicious(F.lit(-1.0), 0.0)) is False


@pytest.mark.parametrize("threshold", [-0.1, 1.1, float("nan")])
def test_threshold_out_of_range(spark, threshold):
    with pytest.raises(ValueError):
        S.is_suspicious(F.lit(0.5), threshold)


def test_stored_score(spark):
    assert value(spark, S.stored_score(F.lit(-1.0))) is None
    assert value(spark, S.stored_score(F.lit(0.499951))) == 0.5


def test_negative_seconds_wrap(spark):
    assert value(spark, S.hour_of_day(F.lit(-1))) == 23
    assert value(spark, S.day_of_week(F.lit(-1))) == 6


def test_expiry_and_mask(spark):
    assert value(spark, S.expiry_text(F.lit("2612"))) == "12/2026"
    assert value(spark, S.expiry_text(F.col("s"))) == "12/2026"
    assert value(spark, S.mask_card(F.lit("4111222233334444"))) == "**** **** **** 4444"
    assert value(spark, S.email_domain(F.lit("a@b@c.example"))) == "c.example"


def test_secret_is_kept_or_encrypted(spark):
    key = F.lit("0123456789abcdef")
    long = "x" * 20
    assert value(spark, S.protect_secret(F.lit(long), key)) == long
    short = spark.createDataFrame([("123",)], "s string").select(
        S.protect_secret(F.col("s"), key).alias("p")).select(
        "p", S.reveal_secret(F.col("p"), key).alias("r")).first()
    assert short["p"] != "123" and short["r"] == "123"


def test_rule_probability_cap_and_boosts(spark):
    p = lambda a, v: round(value(spark, S.rule_probability(F.lit(a), F.lit(v))), 5)
    assert p(0.0, 0.0) == 0.03499
    assert p(1000.0, 0.0) == 0.18499
    assert p(1000.0, 1000.0) == 0.28499


def test_clip(spark):
    assert value(spark, S.inflate_amount(F.lit(10000.0), F.lit(8.0))) == 31937.391
    assert value(spark, S.inflate_amount(F.lit(0.01), F.lit(2.5))) == 0.251
