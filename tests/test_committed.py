"""Appends with commit messages: counts, retries, failures and races."""

import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txnspark.sources import committed as K

SCHEMA = "id long, split string"


def rows(spark, n, parts=3):
    return spark.range(n).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise(
        "train").alias("split")).repartition(parts)


def landed(spark, path):
    return sorted(r["id"] for r in K.read_committed(spark, path, SCHEMA).collect())


def test_counts_come_with_the_write(spark, path):
    K.append_batch(rows(spark, 100), path, "b0", count_by="split")
    K.append_batch(rows(spark, 10), path, "b1", count_by="split")
    assert landed(spark, path) == sorted([*range(100), *range(10)])
    got = {r["value"]: r["rows"] for r in K.committed_counts(spark, path).collect()}
    assert got == {"test": 28, "train": 82}


def test_a_batch_lands_once(spark, path):
    K.append_batch(rows(spark, 50), path, "b0", count_by="split")
    K.append_batch(rows(spark, 50), path, "b0", count_by="split")
    assert landed(spark, path) == list(range(50))
    other = f"{path}-race"
    threads = [threading.Thread(target=K.append_batch, args=(rows(spark, 40), other, "same"))
               for _ in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert landed(spark, other) == list(range(40))


def test_a_task_that_ran_twice_counts_once(spark, path):
    writer = K.BatchWriter({"path": path, "batch": "b", "countby": "split"}, StructType.fromDDL(SCHEMA))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "split": ["train", None]})
    writer.write(iter([batch]))          # the attempt whose result was lost
    writer.commit([writer.write(iter([batch])), writer.write(iter([])), None])
    assert landed(spark, path) == [1, 2]
    got = {r["value"]: r["rows"] for r in K.committed_counts(spark, path).collect()}
    assert got == {"train": 1, "": 1}


def test_a_failed_append_leaves_nothing(spark, path):
    broken = rows(spark, 60).withColumn("id", F.when(F.col("id") == 59, F.raise_error(
        F.lit("injected"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="injected"):
        K.append_batch(broken, path, "b0")
    assert landed(spark, path) == [] and K.manifests(spark, path).collect() == []
    K.append_batch(rows(spark, 60), path, "b0")
    assert landed(spark, path) == list(range(60))
    K.append_batch(rows(spark, 5).limit(0), path, "b1")
    assert K.manifests(spark, path).count() == 2
