"""Fixed names, schemas and constants shared by the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference for compatible models) ---------
# The 29 model inputs, in model order.
FEATURE_COLS = [
    "distance_from_home", "distance_from_last_transaction", "ratio_to_median_purchase_price",
    "repeat_retailer", "used_chip", "used_pin_number", "online_order",
    "ratio_zscore", "ratio_log", "ratio_squared", "ratio_sqrt", "distance_ratio", "distance_sum",
    "chip_and_pin", "online_and_repeat", "high_ratio_flag", "high_distance_flag",
    "rolling_ratio_mean_10", "rolling_ratio_std_10", "rolling_ratio_mean_50", "rolling_ratio_std_50",
    "time_of_day_sin", "time_of_day_cos", "day_of_week_sin", "day_of_week_cos",
    "amt_log", "is_weekend", "amt_zscore_10", "amt_zscore_50",
]
INPUT_DIM = len(FEATURE_COLS)

EARTH_RADIUS_KM = 6371.0
RATIO_CAP = 100.0                 # ratio_to_median clipped above
PLACEHOLDER_FEATURE = 0.1         # ratio_zscore, distance_ratio
HIGH_RATIO = 5.0                  # high_ratio_flag: ratio > 5
HIGH_DISTANCE_KM = 1000.0         # high_distance_flag: last distance > 1000
ZSCORE_EPS = 1e-6
HISTORY_CAP = 50                  # online per-user history length
DEFAULT_THRESHOLD = 0.60          # online decision threshold
AE_SCORE_DIVISOR = 1.5            # autoencoder score = min(mse / 1.5, 1)
OFFLINE_MSE_THRESHOLD = 1.5       # evaluation decision mse > 1.5
SWEEP_THRESHOLDS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0]
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0]
REVIEW_STATUSES = ["CLEARED", "BLOCKED"]
GEO_REASON_KM = 500.0             # reasoning: geographic part when > 500 km
SPEND_REASON_RATIO = 3.0          # reasoning: spend part when ratio > 3
FLAGGED_LIMIT = 200
PAGE_DEFAULT, PAGE_MAX = 20, 100
ALERTS_DEFAULT, ALERTS_MAX = 20, 100
MIN_RETRAIN_ROWS = 100
MODEL_FAILURE_SCORE = 1.0
MODEL_FAILURE_TEXT = "CAUTION: Model inference failed — flagged for manual review."
RISK_TEXT, ANOMALY_TEXT = "XGBoost Risk: ", "% | Autoencoder Anomaly Score: "
GEO_TEXT = (" | Geographic Anomaly: ", "km distance jump.")
SPEND_TEXT = (" | Spend Anomaly: ", "x higher than usual.")
EXPLAIN_UNAVAILABLE = " (AI explanation unavailable)"
DLQ_TOPIC = "transactions-dlq"
SOURCE_TOPIC = "transactions"
MAX_RETRIES = 3
AE_LAYERS = [(29, 16), (16, 8), (8, 16), (16, 29)]   # ReLU after all but the last

# The scaler shipped with the reference model (mean / scale per feature).
REFERENCE_SCALER_MEAN = [
    76.11096923171323, 103.52618125696357, 1.5438591715695302, 0.7138461521764022, 0.0,
    0.2459794990402894, 0.15806761984715179, 0.10000000000000023, 0.7325870119805662,
    11.90130674091229, 1.044554210844164, 0.10000000000000023, 179.63715048867655, 0.0,
    0.10450344947721955, 0.03495875442207622, 0.0, 67.65707891896645, 76.55766138785535,
    67.6554339644994, 97.04631315103337, -0.13719020879892638, -0.018458839361471358,
    -0.07469419803898843, 0.1478511775441217, 3.5210637762134196, 0.32767510173692155,
    0.00013092345344043835, -0.0004574390001086991,
]
REFERENCE_SCALER_SCALE = [
    29.118279288572776, 50.443813640752005, 3.085094098933277, 0.45196219222336165, 1.0,
    0.4306664429604165, 0.3648043960850912, 1.0, 0.5518153793716408, 192.68393491900375,
    0.6728786459513008, 1.0, 66.12857875474104, 1.0, 0.3059125341083326, 0.1836753655538303,
    1.0, 50.418514384388715, 132.31104976577618, 25.921509251357254, 117.23410213131322,
    0.6939639149193959, 0.7065778107532676, 0.6850199032948425, 0.7094424135672,
    1.2779033295623456, 0.46936566708550337, 0.9495535651232785, 0.9886152366164246,
]
# ---------------------------------------------------------------------------

RAW_TRANSACTION_SCHEMA = T.StructType([
    T.StructField("cc_num", T.LongType()),
    T.StructField("trans_date_trans_time", T.TimestampNTZType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
])

INGRESS_FIELDS = ["userId", "amount", "lat", "lon", "distance_from_home",
                  "repeat_retailer", "used_chip", "used_pin_number", "online_order"]
FLAG_FIELDS = ["repeat_retailer", "used_chip", "used_pin_number", "online_order"]

MESSAGE_SCHEMA = T.StructType(
    [T.StructField("_id", T.StringType()), T.StructField("userId", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ["amount", "lat", "lon", "distance_from_home"] + FLAG_FIELDS]
    + [T.StructField("timestamp", T.StringType())]
)

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType(), False),
    T.StructField("userId", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("distance_from_home", T.DoubleType()),
] + [T.StructField(c, T.DoubleType()) for c in FLAG_FIELDS] + [
    T.StructField("fraud_score", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("createdAt", T.TimestampType()),
    T.StructField("updatedAt", T.TimestampType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("transactionId", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("transactionId", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
