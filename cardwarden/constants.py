"""Every number, list and name here is part of the data contract."""

# --- fixed values: model input -------------------------------------------------
NUMERIC_FEATURES = [
    "TransactionAmt", "TransactionDT", "card1", "addr1", "addr2",
    "C1", "C13", "D1", "V314",
    "V201", "V243", "V257", "C7", "V242",
    "V45", "V246", "V200", "V258", "C14",
]

CATEGORY_RATES = {
    "ProductCD": {"W": 0.031, "C": 0.028, "R": 0.044, "H": 0.038, "S": 0.052},
    "card4": {"visa": 0.033, "mastercard": 0.038, "american express": 0.021, "discover": 0.029},
    "card6": {"debit": 0.030, "credit": 0.042, "debit or credit": 0.035},
    "P_emaildomain": {
        "gmail.com": 0.030, "yahoo.com": 0.041, "hotmail.com": 0.036,
        "anonymous.com": 0.089, "aol.com": 0.039,
    },
    "DeviceType": {"desktop": 0.031, "mobile": 0.058},
    "DeviceInfo": {
        "Windows": 0.029, "iOS Device": 0.048, "MacOS": 0.033,
        "Trident/7.0": 0.071, "rv:11.0": 0.065,
    },
}
DEFAULT_RATE = 0.035

BEHAVIOUR_FEATURES = ["ratio_vs_user", "zscore_vs_user"]

TOP_15_FEATURES = [
    "TransactionAmt", "TransactionDT", "ProductCD",
    "card1", "card4", "card6", "P_emaildomain",
    "addr1", "addr2", "DeviceType", "DeviceInfo",
    "C1", "C13", "D1", "V314",
]
TOP_25_FEATURES = TOP_15_FEATURES + [
    "V201", "V243", "V257", "C7", "V242", "V45", "V246", "V200", "V258", "C14",
]

# --- fixed values: amount statistics and rule probability ------------------------
AMT_MEAN = 135.027
AMT_STD = 239.163
AMT_MIN = 0.251
AMT_MAX = 31937.391
V314_MEAN = 43.23
V314_STD = 173.44
RULE_BASE = 0.03499
RULE_AMT_BOOST = 0.15
RULE_V314_BOOST = 0.10
RULE_CAP = 0.85

# --- fixed values: scoring and lifecycle -----------------------------------------
CONTAMINATION = 0.035
THRESHOLD = 0.5
SIGMOID_K = 5.0
WARMUP_SIZE = 500
WINDOW_SIZE = 5000
RETRAIN_SECONDS = 300
MIN_EVALUATION_ROWS = 100
MODEL_VERSION = "IsolationForest_Top25_v1.0"

# --- fixed values: imputation defaults of the spending-profile job ----------------
PROFILE_FILL = {
    "card4": "unknown", "card6": "unknown", "ProductCD": "W",
    "P_emaildomain": "unknown.com", "addr1": 999.0, "addr2": 99.0,
    "DeviceType": "unknown", "DeviceInfo": "unknown",
}
PROFILE_KEYS = [
    "card1", "card4", "card6", "ProductCD", "P_emaildomain",
    "addr1", "addr2", "DeviceType", "DeviceInfo",
]
PROFILE_LIMIT = 5000

# --- fixed values: stored tables ---------------------------------------------------
ALERT_STATUSES = ["flagged", "blocked", "confirmed_fraud", "dismissed"]
RETENTION_DAYS = {"transactions_raw": 30, "transactions_enriched": 90, "fraud_alerts": 90}
RETENTION_COLUMN = {
    "transactions_raw": "fecha_hora_transaccion",
    "transactions_enriched": "processed_at",
    "fraud_alerts": "alerted_at",
}
UNIQUE_KEYS = {
    "user_profiles": "usuarioID", "cards": "tarjetaID",
    "transactions_raw": "transaccionID", "transactions_enriched": "transaccionID",
    "fraud_alerts": "transaccionID",
}
REQUIRED_FIELDS = {
    "user_profiles": ["usuarioID"],
    "cards": ["tarjetaID", "usuarioID"],
    "transactions_raw": [
        "transaccionID", "usuarioID", "tarjetaID", "fecha_hora_transaccion", "TransactionAmt",
    ],
    "transactions_enriched": [
        "transaccionID", "usuarioID", "tarjetaID", "processed_at", "fraud_score",
    ],
    "fraud_alerts": ["transaccionID", "alerted_at", "fraud_score"],
    "model_metrics": ["evaluated_at", "model_version"],
}
FIELD_TYPES = {
    "user_profiles": {
        "usuario_x": "double", "usuario_y": "double", "addr1": "double", "addr2": "double",
        "promedio_de_gastos": "double", "varianza_de_gastos": "double",
        "promedio_gastos_por_dia": "double", "promedio_de_gastos_por_dia": "double",
    },
    "cards": {"card1": "int"},
    "transactions_raw": {
        "fecha_hora_transaccion": "timestamp_ntz", "TransactionAmt": "double",
        "TransactionDT": "bigint", "isFraud": "int",
    },
    "transactions_enriched": {
        "TransactionAmt": "double", "TransactionDT": "bigint", "card1": "int",
        "addr1": "double", "addr2": "double",
        "C1": "double", "C13": "double", "C7": "double", "C14": "double", "D1": "double",
        "V314": "double", "V201": "double", "V243": "double", "V257": "double",
        "V242": "double", "V45": "double", "V246": "double", "V200": "double",
        "V258": "double",
        "zscore_amt": "double", "velocity": "double", "amt_distance": "double",
        "fraud_score": "double", "is_suspicious": "boolean", "model_ready": "boolean",
        "processed_at": "timestamp_ntz", "isFraud": "int", "is_warmed_up": "boolean",
    },
    "fraud_alerts": {
        "TransactionAmt": "double", "fraud_score": "double", "zscore_amt": "double",
        "velocity": "double", "isFraud_label": "int", "alerted_at": "timestamp_ntz",
        "reviewed_at": "timestamp_ntz",
    },
    "model_metrics": {
        "evaluated_at": "timestamp_ntz", "samples_evaluated": "int", "threshold": "double",
        "auc_roc": "double", "f1_score": "double", "recall": "double", "precision": "double",
        "true_positives": "int", "false_positives": "int", "true_negatives": "int",
        "false_negatives": "int", "contamination_rate": "double",
    },
}
ALLOWED_VALUES = {
    "transactions_raw": {"isFraud": [0, 1]},
    "transactions_enriched": {"isFraud": [0, 1]},
    "fraud_alerts": {"isFraud_label": [0, 1], "status": ALERT_STATUSES},
}
