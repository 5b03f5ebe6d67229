"""The ingest job: label, split by time, sample, report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from txnspark import schema as S
from txnspark.functions.features import with_basic_features
from txnspark.operators.sampling import sample_splits
from txnspark.operators.splits import split_plan, with_split


def split_and_sample(txn: DataFrame, train_cap: int = S.TRAIN_CAP,
                     eval_rows: int | None = None) -> DataFrame:
    """Transactions with features and their split; train thinned to its cap, validation
    and test whole unless ``eval_rows`` is given.

    Two scans: date columns for the cut-offs, then one filtered pass.
    """
    feats = with_basic_features(txn)
    plan = split_plan(feats, train_cap=train_cap, eval_rows=eval_rows)
    return sample_splits(with_split(feats, plan), plan)
