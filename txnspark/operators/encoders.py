"""Ordinal encoding of text columns, fitted on train and reused everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions.features import merchant_number, zip_number
from txnspark.operators.ordered import dense_ids
from txnspark.session import materialize

UNSEEN = -1.0
MISSING = -1.0  # what a tree head sees for a NULL

NUMERIC_FEATURES = ["user", "card", "year", "month", "day", "hour", "amount_num",
                    "merchant_name", "zip", "mcc"]


def fit_dictionary(train: DataFrame, columns: list[str] = S.TEXT_FEATURES) -> DataFrame:
    """(feature, value, code): codes follow the sorted values of each column.

    A NULL seen in training is a known value without a code.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                      for c in columns])
    seen = materialize(train.select(F.inline(pairs)).distinct(), "categories")
    known = dense_ids(seen.where(F.col("value").isNotNull()), ["value"], "pos",
                      group_by=["feature"])
    known = known.select("feature", "value", F.col("pos").cast("double").alias("code"))
    missing = seen.where(F.col("value").isNull()).select(
        "feature", "value", F.lit(None).cast("double").alias("code"))
    return materialize(known.unionByName(missing), "dictionary")


def ordinal_encode(df: DataFrame, dictionary: DataFrame,
                   columns: list[str] = S.TEXT_FEATURES) -> DataFrame:
    """Adds ``<column>_code``; a value not seen in training is -1, a known NULL stays NULL."""
    out = df
    for c in columns:
        lookup = dictionary.where(F.col("feature") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"),
            F.lit(True).alias("_hit"))
        out = (out.join(lookup, F.col(c).eqNullSafe(F.col("_value")), "left")
               .withColumn(f"{c}_code", F.when(F.col("_hit"), F.col("_code"))
                           .otherwise(F.lit(UNSEEN)))
               .drop("_value", "_code", "_hit"))
    return out


def raw_feature_names() -> list[str]:
    """Encoded text columns first, then the numeric ones in table order."""
    return [*S.TEXT_FEATURES, *NUMERIC_FEATURES]


def with_raw_features(df: DataFrame, dictionary: DataFrame, out: str = "raw") -> DataFrame:
    """Adds the raw feature array; NULL becomes the sentinel the trees can split off."""
    coded = ordinal_encode(df, dictionary)
    # Request rows carry these as text that may hold no number.
    tolerant = {"merchant_name": merchant_number, "zip": zip_number}
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}

    def number(c: str):
        if c not in text:
            return F.col(c).cast("double")
        return tolerant.get(c, lambda v: v.try_cast("double"))(F.col(c))

    values = [F.col(f"{c}_code") for c in S.TEXT_FEATURES]
    values += [number(c) for c in NUMERIC_FEATURES]
    filled = [F.coalesce(v, F.lit(MISSING)) for v in values]
    return (coded.withColumn(out, F.array(*filled))
            .drop(*[f"{c}_code" for c in S.TEXT_FEATURES]))
