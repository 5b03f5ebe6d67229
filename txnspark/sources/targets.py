"""Where splits live: a catalog table or a Parquet folder behind one interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.session import materialize, path_exists

ROWS_PER_FILE = 250_000
NOT_PARQUET = ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


@dataclass(frozen=True)
class DataTarget:
    """``kind`` is ``path`` (a folder) or ``table`` (a catalog name)."""

    kind: str
    name: str
    location: str | None = None

    def write_splits(self, df: DataFrame) -> None:
        """All splits in one partitioned job.

        Rebalancing gives files of even size: no heavy split in one task, no file
        per split from every task.
        """
        writer = (df.hint("rebalance", "split").write.mode("overwrite").partitionBy("split")
                  .option("compression", "snappy")
                  .option("maxRecordsPerFile", ROWS_PER_FILE))
        if self.kind == "path":
            writer.parquet(self.name)
        else:
            save_table(writer, self.name, self.location)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.name) if self.kind == "path" else spark.table(self.name)

    def exists(self, spark: SparkSession) -> bool:
        if self.kind == "table":
            return spark.catalog.tableExists(self.name)
        return path_exists(spark, self.name)

    def read_split(self, spark: SparkSession, split: str, columns: list[str]) -> DataFrame:
        """One split, pruned to its partition and columns."""
        return self.read(spark).where(F.col("split") == split).select(*columns)


def save_table(writer, name: str, location: str | None) -> None:
    """An external table when a location is given and allowed, else a managed one."""
    spark = SparkSession.active()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if location is not None:
        try:
            writer.option("path", location).saveAsTable(name, format="parquet")
            return
        except AnalysisException:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer.saveAsTable(name, format="parquet")


def split_counts(spark: SparkSession, target: DataTarget) -> DataFrame:
    """(split, rows): counts of what is there."""
    if not target.exists(spark):
        return spark.createDataFrame([], "split string, rows long")
    return target.read(spark).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def readiness(spark: SparkSession, target: DataTarget, expected: list[str] = S.SPLITS) -> DataFrame:
    """Rows per expected split, NULL where it is missing, and whether it is usable."""
    want = spark.createDataFrame([(s,) for s in expected], "split string")
    counts = split_counts(spark, target)
    return (want.join(counts, "split", "left")
            .withColumn("ready", F.coalesce(F.col("rows") > 0, F.lit(False))))


def is_ready(spark: SparkSession, target: DataTarget) -> bool:
    return readiness(spark, target).where(~F.col("ready")).isEmpty()


def ingest_once(df: DataFrame, target: DataTarget, force: bool = False,
                then: Callable[[], None] | None = None) -> bool:
    """Write the splits unless the target is already complete; True when written.

    ``then`` runs after a write, such as ``forget`` of a cache made from the old rows.
    """
    if not force and is_ready(df.sparkSession, target):
        return False
    target.write_splits(df)
    if then is not None:
        then()
    return True


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """Row count answered from Parquet footers; no data page is read.

    A sibling session holds the two settings, so the caller's stay as they are.
    """
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    sibling.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    return sibling.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


def safe_footer_count(spark: SparkSession, path: str) -> int | None:
    """None when nothing is there, 0 when it is not readable Parquet.

    Only what Spark says of the files themselves counts as unreadable; a lost connection or a
    denied folder is an error.
    """
    if not path_exists(spark, path):
        return None
    try:
        return footer_counts(spark, path).first()["n"]
    except (PySparkException, Py4JJavaError) as error:
        if any(sign in str(error) for sign in NOT_PARQUET):
            return 0
        raise


def write_with_manifest(df: DataFrame, target: DataTarget, manifest: str) -> None:
    """Write the splits and append (split, rows, written_at), counted by the same job."""
    seen = Observation("written")
    counted = df.observe(seen, *[
        F.coalesce(F.sum(F.when(F.col("split") == s, 1)), F.lit(0)).alias(s) for s in S.SPLITS])
    target.write_splits(counted)
    rows = [(s, int(seen.get[s])) for s in S.SPLITS]
    (df.sparkSession.createDataFrame(rows, "split string, rows long")
     .withColumn("written_at", F.current_timestamp()).coalesce(1)
     .write.mode("append").parquet(manifest))


def manifest_counts(spark: SparkSession, manifest: str) -> DataFrame:
    """The newest stamp of each split."""
    return (spark.read.parquet(manifest).groupBy("split")
            .agg(F.max_by("rows", "written_at").alias("rows")))


def append_once(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Append whole batches exactly once.

    A batch that is there with the same row count is skipped, one with another
    count stops the append, the rest is written in one partitioned job.
    """
    spark = df.sparkSession
    new = df
    if path_exists(spark, path):
        there = spark.read.parquet(path)
        count = lambda d, name: d.groupBy(batch).agg(F.count(F.lit(1)).alias(name))
        landed = materialize(count(df, "incoming").join(count(there, "landed"), batch), "landed")
        partial = landed.where(F.col("incoming") != F.col("landed"))
        if not partial.isEmpty():
            raise ValueError(f"batch {partial.first()[batch]} has landed only in part")
        new = df.join(landed.select(batch), batch, "left_anti")
    new.hint("rebalance", batch).write.mode("append").partitionBy(batch).parquet(path)
