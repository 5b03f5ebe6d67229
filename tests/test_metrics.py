"""Ranking metrics and histograms against direct computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnspark.operators import metrics as M


def brute(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, seen, hits, last = 0.0, 0, 0, 0.0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        group = [y for p, y in pairs if p == t]
        seen, hits = seen + len(group), hits + sum(group)
        recall = hits / len(pos)
        ap, last = ap + (recall - last) * hits / seen, recall
    return auc, ap


def scores(spark, pairs, head="h"):
    return spark.createDataFrame([(i, head, float(p), int(y)) for i, (p, y) in enumerate(pairs)],
                                 "row_id long, head string, p double, y int")


@pytest.mark.parametrize("levels", [3, 40, 10 ** 6])
def test_auc_and_ap(spark, levels):
    rnd = random.Random(levels)
    pairs = [(rnd.randrange(levels) / levels, int(rnd.random() < 0.2)) for _ in range(400)]
    got = M.ranking_metrics(scores(spark, pairs), ["head"]).first()
    auc, ap = brute(pairs)
    assert got["auc"] == pytest.approx(auc) and got["ap"] == pytest.approx(ap)


def test_one_score_holding_a_third_of_all_rows(spark):
    pairs = [(0.5 if i % 3 == 0 else i / 900, int(i % 7 == 0)) for i in range(900)]
    got = M.ranking_metrics(scores(spark, pairs), ["head"], ranges=16).first()
    auc, ap = brute(pairs)
    assert got["auc"] == pytest.approx(auc) and got["ap"] == pytest.approx(ap)


def test_single_class_has_no_auc(spark):
    got = M.ranking_metrics(scores(spark, [(0.1, 0), (0.9, 0)]), ["head"]).first()
    assert got["auc"] is None and got["ap"] is None


def test_staged_and_direct_agree(spark):
    rnd = random.Random(5)
    df = scores(spark, [(rnd.random(), rnd.randrange(2)) for _ in range(300)])
    key = lambda d: sorted(map(tuple, d.select("p", "cum_pos", "cum_neg").collect()))
    assert key(M.by_threshold(df, ["head"])) == key(M.by_threshold(df, ["head"], staged=False))


def test_histogram_on_the_edges(spark):
    edges = np.linspace(0, 1, 31)
    values = [*edges, *np.nextafter(edges[1:], 0), *np.nextafter(edges[:-1], 1), 0.5, 0.999]
    df = scores(spark, [(v, i % 2) for i, v in enumerate(values)])
    got = M.score_histogram(df).orderBy("bin").collect()
    for y, name in ((0, "legit"), (1, "fraud")):
        want = np.histogram([v for i, v in enumerate(values) if i % 2 == y], bins=edges)[0]
        assert [r[name] for r in got] == want.tolist()
    assert [r["left_edge"] for r in got][:3] == [0.0, 0.033, 0.067]


def test_empty_class_is_guarded(spark):
    h = M.score_histogram(scores(spark, [(0.2, 0), (0.4, 0)]))
    assert M.normalised_histogram(h).agg(F.sum("fraud_pct")).first()[0] == 0.0


def test_lift_on_a_zero_base(spark):
    m = spark.createDataFrame([("raw", 0.0, 0.5), ("embed", 0.7, 0.6)],
                              "head string, auc double, ap double")
    got = {r["head"]: r for r in M.lift(m).collect()}
    assert got["embed"]["auc_lift_pct"] is None and got["embed"]["ap_lift_pct"] == 20.0


def test_confusion_without_flags(spark):
    got = M.confusion(scores(spark, [(0.1, 1), (0.2, 0)])).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (0, 0, 1, 1)
    assert got["precision"] is None and got["recall"] == 0.0


def test_extent_of_one_point(spark):
    got = M.map_extent(spark.createDataFrame([(2.0, 3.0)], "x double, y double")).first()
    assert tuple(got) == pytest.approx((1.92, 2.08, 2.92, 3.08))
