"""Per-row feature expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hour_of(time) -> Column:
    """Hour from ``HH:MM`` text."""
    return F.split_part(time, F.lit(":"), F.lit(1)).cast("int")


def amount_number(amount) -> Column:
    """``$1,234.50`` to a double."""
    return F.regexp_replace(amount, "[$,]", "").cast("double")


def date_key(year, month, day) -> Column:
    return year * 10000 + month * 100 + day


def label_yes(label) -> Column:
    """The ingest rule: the text is ``yes`` in any case."""
    return (F.lower(label) == "yes").cast("int")


def label_positive(label) -> Column:
    """The training rule: exactly ``Yes``, or anything that prints as ``1``."""
    return ((label == "Yes") | (label.cast("string") == "1")).cast("int")


def label_any(label) -> Column:
    """Union of both rules; a missing label counts as negative."""
    return F.coalesce(F.greatest(label_yes(label), label_positive(label)), F.lit(0))


def tolerant_amount(amount) -> Column:
    """Missing, empty or unreadable amounts become 0."""
    text = F.nullif(F.regexp_replace(amount, "[$,]", ""), F.lit(""))
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def tolerant_hour(hour, time) -> Column:
    """A given hour, else the one in the time text, else 0."""
    time = F.coalesce(time, F.lit("0:00"))
    parsed = F.when(time.contains(":"), F.split_part(time, F.lit(":"), F.lit(1)).try_cast("int"))
    return F.coalesce(hour, parsed, F.lit(0))


def merchant_number(merchant) -> Column:
    """Numeric merchant ids pass, names become -1."""
    return F.coalesce(F.trim(merchant).try_cast("double"), F.lit(-1.0))


def zip_number(zip_text) -> Column:
    """Zip for the raw features: empty or unreadable is 0, the text ``nan`` is NaN."""
    text = F.nullif(F.trim(zip_text), F.lit(""))
    number = F.when(F.lower(text) == "nan", F.lit(float("nan"))).otherwise(text.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def zip_token_text(zip_text) -> Column:
    """Zip for tokens: digits only, without a trailing ``.0``, else ``00000``."""
    text = F.regexp_replace(F.trim(zip_text), r"\.0$", "")
    return F.when(text.rlike("^[0-9]+$"), text).otherwise(F.lit("00000"))


def zip_prefix(zip_text) -> Column:
    return F.substring(zip_text, 1, 3)


def finite_or_null(value) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def fold_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_null(F.col(c)) for c in floats})


def money_text(value) -> Column:
    return F.concat(F.lit("$"), value.cast("decimal(18,2)").cast("string"))


def logistic(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clamp(value, low, high) -> Column:
    """The value moved into the box; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def is_clamped(value, low, high) -> Column:
    return clamp(value, low, high) != value


def run_id(index, stamp) -> Column:
    """``r{index}-{UTC stamp}``."""
    return F.concat(F.lit("r"), index.cast("string"), F.lit("-"),
                    F.date_format(stamp, "yyyyMMdd'T'HHmmss"))


def elapsed_seconds(start, end) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6), 1)


def with_basic_features(txn: DataFrame) -> DataFrame:
    """Adds hour, amount_num, d (date key) and y (label) to a transaction table."""
    return txn.withColumns({
        "hour": hour_of(F.col("time")),
        "amount_num": amount_number(F.col("amount")),
        "d": date_key(F.col("year"), F.col("month"), F.col("day")),
        "y": label_any(F.col("is_fraud")),
    })
