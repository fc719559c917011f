"""The flagship query: transactions to ranked alerts in one native plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwarden.functions import scalars as S
from cardwarden.functions.features import engineered, user_relative
from cardwarden.operators.dashboards import top_alerts
from cardwarden.operators.joins import with_profile


def risk_ranking(tx: DataFrame, profiles: DataFrame, k: int = 100,
                 threshold: float = 0.1) -> DataFrame:
    """Profile join, risk features, rule probability, suspicion, then the k riskiest rows."""
    rated = with_profile(tx, profiles).withColumns({
        **engineered(), **user_relative(),
        "rule_score": S.rule_probability(
            S.safe_double(F.col("TransactionAmt")), S.safe_double(F.col("V314"))),
    })
    suspicious = rated.filter(S.is_suspicious(F.col("rule_score"), threshold))
    return top_alerts(suspicious, k, "rule_score", "fecha_hora_transaccion").select(
        "transaccionID", "usuarioID", "fecha_hora_transaccion", "TransactionAmt", "zscore_amt",
        "velocity", "amt_distance", "ratio_vs_user", "zscore_vs_user", "rule_score")
