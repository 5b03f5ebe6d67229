import numpy as np
import zlib

from helpers import EDGES, documents, edges, empty, sample
from pyspark.sql import functions as F

from txnspark.llm import classifier


def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def auc(score, y):
    good, bad = score[y == 1], score[y == 0]
    return np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))


def test_held_out_accuracy(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = classifier.quality_scores(given, marks).join(marks, "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held["doc_id"]]).all()
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.98
    assert (held["predicted"] == held["quality"]).mean() > 0.96
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_scores_see_nothing_but_the_text(spark):
    given = sample(spark, 300)
    other = given.select((F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang"),
                         F.lit("yy").alias("source"), F.lit(1).alias("n_chars"))
    marks = labels(spark).withColumn("toxic", F.lit(1))
    one = {r["doc_id"]: r["score"] for r in classifier.quality_scores(given, labels(spark)).collect()}
    two = {r["doc_id"]: r["score"] for r in classifier.quality_scores(
        other.repartition(6), marks).collect()}
    assert one == two


def test_held_out_labels_are_never_learned(spark):
    given, marks = sample(spark, 400), labels(spark)
    turned = marks.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2,
        1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in classifier.quality_scores(given, marks).collect()}
    b = {r["doc_id"]: r["score"] for r in classifier.quality_scores(given, turned).collect()}
    assert a == b


def test_bounded_sample_and_edges(spark):
    few = classifier.train(sample(spark, 400), labels(spark), rows=30)
    assert np.isfinite(few.weights).all()
    given = edges(spark)
    rows = classifier.quality_scores(given, labels(spark)).collect()
    assert len(rows) == len(EDGES) and all(0 < r["score"] < 1 for r in rows)
    silent = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(silent) == 1
    assert classifier.quality_scores(empty(spark), labels(spark)).collect() == []
    none = labels(spark).limit(0)
    scores = {round(r["score"], 9) for r in classifier.quality_scores(given, none).collect()}
    assert scores == {0.7}
    odd = documents(spark, [(0, "one two three", "en", "s")])
    assert classifier.quality_scores(odd, labels(spark)).count() == 1


def test_every_label_counts(spark, monkeypatch):
    # Far more rows than a bucket: turning the label of any one of them turns the model.
    given, marks = sample(spark, 400), labels(spark)
    monkeypatch.setattr(classifier, "BUCKET", 16)
    first = classifier.train(given, marks)
    used = [r["doc_id"] for r in marks.join(given, "doc_id").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("doc_id").collect()]
    for doc in (min(used), max(used)):
        turned = marks.withColumn("quality", F.when(
            F.col("doc_id") == doc, 1 - F.col("quality")).otherwise(F.col("quality")))
        assert not np.array_equal(classifier.train(given, turned).weights, first.weights)
    seen = []
    fit = classifier.fit
    monkeypatch.setattr(classifier, "fit", lambda d: seen.append(d.count()) or fit(d))
    twelve = given.crossJoin(spark.range(200)).select(
        (F.col("doc_id") * 1000 + F.col("id")).alias("doc_id"), "text")
    many = marks.crossJoin(spark.range(200)).select(
        (F.col("doc_id") * 1000 + F.col("id")).alias("doc_id"), "quality")
    monkeypatch.setattr(classifier, "BUCKET", 512)
    classifier.train(twelve, many)
    assert seen[0] == twelve.join(many, "doc_id").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).count() > 20_000
