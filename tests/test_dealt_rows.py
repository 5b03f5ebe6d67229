from conftest import FOLDER
from test_plans import main_plan

import __spark_entry__ as entry
from txnspark.operators.heads import FIT_PARTS
from txnspark.plans import common as C
from txnspark.plans import queries_models as Q


def test_learned_embedding_reads_events_once(spark):
    plan = main_plan(entry.queries()["mlx_03_learned_embedding"](spark, FOLDER))
    assert "get_json_object" not in plan and "events.parquet" not in plan
    assert "slots-" in plan


def around_the_deal(df):
    """The plan above and below the shuffle that deals the events."""
    plan = main_plan(df).split("== Initial Plan ==")[-1]
    return plan.split("Exchange hashpartitioning(event_id", 1)


def same_rows(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_training_rows_are_dealt_before_they_are_worked_on(spark, monkeypatch):
    monkeypatch.setattr(Q.C, "once", lambda spark, folder, name, build: build())
    monkeypatch.setattr(Q.T, "train_heads", lambda rows, *_, **__: rows)
    rows = Q.trained(spark, FOLDER)
    assert rows.rdd.getNumPartitions() == FIT_PARTS
    above, below = around_the_deal(rows)
    assert "get_json_object" in above and "get_json_object" not in below
    assert same_rows(rows, C.split_features(spark, FOLDER))


def test_scored_rows_are_dealt_before_they_are_worked_on(spark):
    test = Q._test(spark, FOLDER)
    above, below = around_the_deal(test)
    assert "get_json_object" in above and "get_json_object" not in below
    assert "Filter" in below  # only rows of the split are dealt
    assert same_rows(test, C.split_features(spark, FOLDER).where("split = 'test'"))


def test_registered_heads_are_trained_at_full_size(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(Q.C, "once", lambda spark, folder, name, build: build())
    monkeypatch.setattr(Q.T, "train_heads", lambda rows, budget, rounds, depth=None, patience=0:
                        asked.update(budget=budget, rounds=rounds, depth=depth,
                                     patience=patience))
    Q.trained(spark, FOLDER)
    # No depth given: each head has its own.
    assert asked == {"budget": None, "rounds": {"raw": 400, "embed": 435, "combined": 512},
                     "depth": None, "patience": 20}
