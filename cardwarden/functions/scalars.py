"""Column expressions: every function takes and returns columns, nothing runs per row in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardwarden import constants as C


def safe_double(c: Column, default: float = 0.0) -> Column:
    """The value as double, or the default when it is missing or not a number."""
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def safe_int(c: Column, default: int = 0) -> Column:
    """The value truncated to int, or the default when it is missing or not a number."""
    return F.coalesce(c.try_cast("int"), F.lit(int(default)))


def zscore(amount: Column, mean: float = C.AMT_MEAN, std: float = C.AMT_STD) -> Column:
    return (amount - F.lit(mean)) / F.lit(std) if std > 0 else F.lit(0.0)


def zscore_amt(amount: Column) -> Column:
    return F.round(zscore(safe_double(amount)), 4)


def amt_distance(amount: Column) -> Column:
    return F.round(F.abs(zscore(safe_double(amount))), 4)


def velocity(count: Column, days: Column) -> Column:
    """Transactions counted per day of account history; history shorter than a day counts as one."""
    history = F.greatest(safe_int(days, 1), F.lit(1)).cast("double")
    return F.round(safe_int(count).cast("double") / history, 4)


def ratio_vs_user(amount: Column, mean: Column) -> Column:
    return safe_double(amount) / F.greatest(safe_double(mean, C.AMT_MEAN), F.lit(1.0))


def zscore_vs_user(amount: Column, mean: Column, variance: Column) -> Column:
    spread = F.greatest(F.sqrt(safe_double(variance, C.AMT_STD ** 2)), F.lit(1.0))
    return (safe_double(amount) - safe_double(mean, C.AMT_MEAN)) / spread


def anomaly_probability(score: Column, offset: Column, k: float = C.SIGMOID_K) -> Column:
    """Logistic map of an anomaly score: the offset maps to one half, lower scores above it."""
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(k) * (score - offset) / F.abs(offset)))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.when(F.abs(offset) < F.lit(1e-10), F.lit(0.5)).otherwise(clamped)


def is_suspicious(score: Column, threshold: float = C.THRESHOLD) -> Column:
    """True at or above the threshold; a negative or missing score is never suspicious."""
    if not 0.0 <= threshold <= 1.0 or math.isnan(threshold):
        raise ValueError(f"threshold must lie in [0, 1], got {threshold}")
    return F.coalesce((score >= F.lit(0.0)) & (score >= F.lit(threshold)), F.lit(False))


def stored_score(score: Column) -> Column:
    """The score as stored: four places, null when no model was active."""
    return F.when(score >= 0, F.round(score, 4))


def anomaly_flag(prediction: Column) -> Column:
    """Outlier labels -1/1 as 1/0."""
    return F.when(prediction == -1, F.lit(1)).otherwise(F.lit(0))


def rule_probability(amount: Column, v314: Column) -> Column:
    """Base rate raised for a large amount and for a large V314, capped."""
    high_amount = amount > F.lit(C.AMT_MEAN + 2 * C.AMT_STD)
    high_v314 = v314 > F.lit(C.V314_MEAN + C.V314_STD)
    total = (
        F.lit(C.RULE_BASE)
        + F.when(high_amount, F.lit(C.RULE_AMT_BOOST)).otherwise(F.lit(0.0))
        + F.when(high_v314, F.lit(C.RULE_V314_BOOST)).otherwise(F.lit(0.0))
    )
    return F.least(total, F.lit(C.RULE_CAP))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def inflate_amount(amount: Column, factor: Column) -> Column:
    """Amount times a factor, kept in the valid amount range."""
    return clip(amount * factor, C.AMT_MIN, C.AMT_MAX)


def hour_of_day(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / F.lit(3600)), F.lit(24)).cast("int")


def day_of_week(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / F.lit(86400)), F.lit(7)).cast("int")


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def mask_card(number: Column) -> Column:
    return F.concat(F.lit("**** **** **** "), F.right(number, F.lit(4)))


def expiry_text(yymm: Column) -> Column:
    """``YYMM`` as ``MM/20YY``; a missing value falls back to the default expiry."""
    return F.coalesce(
        F.concat(F.substr(yymm, F.lit(3)), F.lit("/20"), F.left(yymm, F.lit(2))),
        F.lit("12/2026"),
    )


def protect_secret(secret: Column, key: Column) -> Column:
    """A value of 20 or more characters is already protected; a shorter one is encrypted (AES-GCM)."""
    cipher = F.base64(F.aes_encrypt(secret, key, F.lit("GCM"), F.lit("DEFAULT")))
    return F.when(F.length(secret) >= 20, secret).otherwise(cipher)


def reveal_secret(protected: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(protected), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def _fixed_point(value: Column, places: int) -> Column:
    return value.cast(f"decimal(18,{places})")


def exact_mean(value: Column, places: int = 4) -> Column:
    """Mean of amounts of so many decimal places: summed exactly, divided once.

    The result does not depend on the order in which rows are added up.
    """
    return F.sum(_fixed_point(value, places)).cast("double") / F.nullif(F.count(value), F.lit(0))


def exact_variance(value: Column, places: int = 4) -> Column:
    """Sample variance from exact sums, null for fewer than two values; see ``exact_mean``."""
    fixed = _fixed_point(value, places)
    n, total = F.count(value), F.sum(fixed).cast("double")
    squares = F.sum(fixed * fixed).cast("double")
    spread = n * squares - total * total
    return F.greatest(spread, F.lit(0.0)) / F.nullif(n * (n - 1), F.lit(0))


def secret_key(spark) -> str:
    """The configured encryption key; there is none in the code."""
    key = spark.conf.get("cardwarden.secret.key", None)
    if not key:
        raise ValueError("set cardwarden.secret.key to a key of 16, 24 or 32 bytes")
    return key
