"""Message schemas of the three event streams and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from cardwarden import constants as C


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "bigint": T.LongType(),
}


def _fields(**types: str) -> T.StructType:
    return T.StructType(
        [T.StructField(name, _TYPES[kind], True) for name, kind in types.items()]
    )


# fixed values: field names, types and order of the messages and of the enriched rows
TRANSACTION = _fields(
    transaccionID="string", fecha_hora_transaccion="string", usuarioID="string",
    terminalID="string", tarjetaID="string",
    TransactionAmt="double", TransactionDT="bigint", card1="int", addr1="double", addr2="double",
    C1="int", C13="int", D1="int", V314="double", V201="double", V243="double", V257="double",
    C7="int", V242="double", V45="double", V246="double", V200="double", V258="double", C14="int",
    ProductCD="string", card4="string", card6="string", P_emaildomain="string",
    DeviceType="string", DeviceInfo="string", isFraud="int",
)

USER = _fields(
    usuarioID="string", usuario="string", vertexon_customer_number="string",
    fecha_nacimiento="string", email="string", P_emaildomain="string",
    DeviceType="string", DeviceInfo="string", usuario_x="double", usuario_y="double",
    addr1="double", addr2="double", promedio_de_gastos="double", varianza_de_gastos="double",
    promedio_de_gastos_por_dia="double",
)

CARD = _fields(
    tarjetaID="string", usuarioID="string", card_number_masked="string",
    fecha_exp_tarjeta="string", cvv="string", card1="int", card4="string", card6="string",
    ProductCD="string",
)

PROFILE = _fields(usuarioID="string", promedio_de_gastos="double", varianza_de_gastos="double")

ENRICHED_COLUMNS = [
    "transaccionID", "usuarioID", "tarjetaID",
    "TransactionAmt", "TransactionDT", "card1", "card4", "card6", "ProductCD",
    "P_emaildomain", "addr1", "addr2", "DeviceType", "DeviceInfo",
    "C1", "C13", "C7", "C14", "D1",
    "V314", "V201", "V243", "V257", "V242", "V45", "V246", "V200", "V258",
    "zscore_amt", "velocity", "amt_distance",
    "fraud_score", "is_suspicious", "model_ready", "is_warmed_up", "processed_at", "isFraud",
]

FEATURE_NAMES = (
    C.NUMERIC_FEATURES + [f"{name}_rate" for name in C.CATEGORY_RATES] + C.BEHAVIOUR_FEATURES
)
