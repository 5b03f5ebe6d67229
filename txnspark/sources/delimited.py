"""CSV scans with declared types, matched to the file by cleaned header names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnspark import schema as S


def display_types(columns: list[str] | None = None) -> dict[str, T.DataType]:
    """Stored display name -> type, for the wanted canonical columns."""
    types = {f.name: f.dataType for f in S.TXN_SCHEMA}
    return {S.DISPLAY_NAMES[c]: types[c] for c in (columns or list(S.DISPLAY_NAMES))}


def scan_csv(spark: SparkSession, path: str, wanted: dict[str, T.DataType]) -> DataFrame:
    """Wanted columns of a CSV file set, typed; names are compared after trimming.

    Only the header is read here. The reader gets a full schema, so nothing is
    inferred, and Catalyst hands the parser the wanted columns alone.
    """
    header = spark.read.option("header", True).csv(path).columns
    actual = {c.strip(): c for c in header}
    missing = [c for c in wanted if c not in actual]
    if missing:
        raise ValueError(f"CSV columns missing: {missing}; header is {header}")
    full = T.StructType([T.StructField(c, wanted.get(c.strip(), T.StringType())) for c in header])
    rows = spark.read.schema(full).option("header", True).csv(path)
    return rows.select(*[F.col(f"`{actual[c]}`").alias(c) for c in wanted])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)
