"""Table schemas, column views and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column names, views and sizes that define the data contract ---
DISPLAY_NAMES = {
    "user": "User",
    "card": "Card",
    "year": "Year",
    "month": "Month",
    "day": "Day",
    "time": "Time",
    "amount": "Amount",
    "use_chip": "Use Chip",
    "merchant_name": "Merchant Name",
    "merchant_city": "Merchant City",
    "merchant_state": "Merchant State",
    "zip": "Zip",
    "mcc": "MCC",
    "is_fraud": "Is Fraud?",
}
TOKEN_VIEW = ["amount", "merchant_name", "mcc", "year", "month", "day",
              "time", "card", "use_chip", "zip", "merchant_state", "user"]
RAW_VIEW = ["user", "card", "year", "month", "day", "hour", "amount",
            "use_chip", "merchant_name", "merchant_city",
            "merchant_state", "zip", "mcc"]
TEXT_FEATURES = ["use_chip", "merchant_city", "merchant_state"]
LABEL = "is_fraud"
DERIVED = ("hour",)
SPLITS = ["train", "val", "test"]
SEQUENCE_LENGTH = 128
MERCHANT_BUCKETS = 2000
EMBED_DIM = 512
PCA_DIM = 64
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
TRAIN_CAP = 1_000_000
EVAL_ROWS = 100_000
MAP_ROWS = 8_000
HEADS = ["raw", "embed", "combined", "external"]
HEAD_LABELS = {
    "raw": "Raw tabular features",
    "embed": "Foundation-model embeddings",
    "combined": "Combined",
    "external": "External scorer",
}
FLAG_THRESHOLD = 0.5
# --- end of fixed values ---

TXN_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("user", T.LongType()),
    T.StructField("card", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("time", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("use_chip", T.StringType()),
    T.StructField("merchant_name", T.LongType()),
    T.StructField("merchant_city", T.StringType()),
    T.StructField("merchant_state", T.StringType()),
    T.StructField("zip", T.DoubleType()),
    T.StructField("mcc", T.IntegerType()),
    T.StructField("is_fraud", T.StringType()),
])


def source_columns() -> list[str]:
    """Stored columns both views and the label need, without derived ones."""
    wanted = dict.fromkeys([*TOKEN_VIEW, *RAW_VIEW, LABEL])
    return [c for c in wanted if c not in DERIVED]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail before any job starts when a column is missing."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def column_report(df: DataFrame, required: list[str]) -> DataFrame:
    """Per required column: is it there, and in how many rows is it filled."""
    gone = missing_columns(df, required)
    filled = df.agg(*[F.count(F.lit(None) if c in gone else F.col(c)).alias(c) for c in required])
    return filled.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(c not in gone).alias("present"),
                 F.col(c).alias("filled")) for c in required])))


def to_display_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(DISPLAY_NAMES)


def to_canonical_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in DISPLAY_NAMES.items()})


def component_columns(columns: list[str], prefix: str = "pca_") -> list[str]:
    """``pca_*`` columns in order of their numeric suffix."""
    return sorted((c for c in columns if c.startswith(prefix)),
                  key=lambda c: int(c[len(prefix):]))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Guard for an action boundary: an empty input is an error, not a result."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
