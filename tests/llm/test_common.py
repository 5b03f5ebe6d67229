import pytest
from helpers import documents
from pyspark.sql import functions as F

from txnspark.llm import simhash
from txnspark.llm.common import may_be_among, row_key, without
from txnspark.session import materialize


def shuffled(plan):
    """Rows written by each shuffle of an executed plan."""
    kind, found = plan.getClass().getSimpleName(), []
    if kind == "ShuffleExchangeExec":
        found.append(plan.metrics().get("shuffleRecordsWritten").get().value())
    if kind.startswith("AdaptiveSparkPlan"):
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    return found + [n for p in below for n in shuffled(p)]


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


def test_only_rows_that_may_be_listed_are_shuffled(spark, no_broadcast):
    docs = materialize(documents(spark, [(i, f"text {i}", "en", "a") for i in range(2000)]
                                 + [(None, None, None, None), (7, None, "en", "a")]), "docs")
    keyed = docs.select("doc_id", row_key(docs).alias("row_key"))
    dropped = materialize(keyed.where("doc_id % 100 = 7 or doc_id is null"), "dropped")
    # The hash of another row beside this doc_id drops nothing.
    dropped = materialize(dropped.union(keyed.where("doc_id = 8").select(
        F.lit(9).cast("long"), "row_key")), "dropped")
    left = without(docs, dropped)
    rows = left.collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i in range(2000) if i % 100 != 7]
    assert left.columns == docs.columns
    written = shuffled(left._jdf.queryExecution().executedPlan())
    assert written and max(written) < 200  # of 2,002 documents


def test_a_table_of_no_keys_lets_nothing_through(spark):
    docs = documents(spark, [(i, f"text {i}", "en", "a") for i in range(20)])
    none = materialize(docs.select("doc_id", row_key(docs).alias("row_key")).where("false"), "none")
    assert docs.where(may_be_among(none, "row_key")(row_key(docs))).count() == 0
    assert without(docs, none).count() == 20


def test_more_keys_than_bits_lose_none(spark, monkeypatch):
    from txnspark.llm import common
    monkeypatch.setattr(common, "MAX_BITMAPS", 2)
    keys = materialize(spark.range(100_000).select(F.xxhash64("id").alias("key")), "keys")
    assert keys.where(may_be_among(keys, "key")(F.col("key"))).count() == 100_000


def test_wanted_texts_only(spark, no_broadcast):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, words(i), "en", "a") for i in range(500)]
    rows += [(1000 + i, words(i) + " end", "en", "a") for i in range(5)]
    docs = materialize(documents(spark, rows), "docs")
    left = simhash.drop_similar_documents(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(500))
