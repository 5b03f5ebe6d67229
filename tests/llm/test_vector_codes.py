"""Vector codes against plain numpy; the registered query has SQL for the given tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnspark.llm import vector_codes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType())])


def brute(rows, rounds=vector_codes.ROUNDS):
    """rows: (vec_id, vector, label) -> [(vec_id, code, error, label_error, digest)]."""
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in x], y) for i, x, y in rows
            if x and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([r[1] for r in kept], dtype=np.int64)
    b = [p * x.shape[1] // 4 for p in range(5)]
    books = [x[:256, b[p]:b[p + 1]].copy() for p in range(4)]

    def assign():
        d = [((x[:, None, b[p]:b[p + 1]] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        return [v.argmin(axis=1) for v in d], sum(v.min(axis=1) for v in d)
    for _ in range(rounds):
        entries, _ = assign()
        for p in range(4):
            for e in set(entries[p].tolist()):
                books[p][e] = x[entries[p] == e, b[p]:b[p + 1]].sum(axis=0) // (entries[p] == e).sum()
    entries, error = assign()
    digest = hashlib.sha256(",".join(str(v) for k in books for v in k.ravel()).encode()).hexdigest()
    label = {}
    for r, e in zip(kept, error):
        label[r[2]] = label.get(r[2], 0) + int(e)
    return [(r[0], "".join(f"{int(entries[p][k]):02x}" for p in range(4)), int(error[k]),
             label[r[2]], digest) for k, r in enumerate(kept)]


def random_rows(n, width=8, seed=3):
    draw = np.random.default_rng(seed)
    return [(int(i), [float(v) for v in draw.normal(0, 0.2, width)], int(i) % 5 if i % 7 else None)
            for i in range(n)]


def report(df):
    return [tuple(r) for r in vector_codes.code_report(df).collect()]


key = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("n,parts,width", [(900, 1, 8), (900, 7, 8), (40, 3, 8), (300, 2, 6), (5, 1, 2)])
def test_same_as_numpy(spark, n, parts, width):
    rows = random_rows(n, width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert key(report(df)) == key(brute(rows))


def test_bad_vectors_go_and_hot_vectors_stay(spark):
    rows = random_rows(300)
    rows += [(10_000 + i, rows[0][1], 1) for i in range(200)]                  # one hot vector
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2), (None, rows[3][1], None)]  # repeated, no id
    bad = [(1000, None, 1), (1001, [], 1), (1002, [1.0] * 7 + [None], 1),
           (1003, [1.0] * 7 + [float("nan")], 1), (1004, [1.0] * 7 + [float("-inf")], 1),
           (1005, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(4)
    got = report(df)
    assert len(got) == len(rows)
    assert key(got) == key(brute(rows))


def test_far_components_are_held(spark):
    rows = random_rows(30, 4) + [(99, [1e30, -1e30, 0.0, 5e4], 1)]
    got = report(spark.createDataFrame(rows, SCHEMA))
    assert len(got) == 31 and all(r[2] >= 0 for r in got)


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame(random_rows(50), SCHEMA)
    odd = df
    for name in ("code", "error", "x", "sizes", "codes", "_label", "part"):
        odd = odd.withColumn(name, F.lit("y"))
    assert key(report(odd)) == key(report(df))
    assert report(df.limit(0)) == []
    assert report(df.withColumn("embedding", F.lit(None).cast("array<float>"))) == []


def test_rounds_lower_the_error(spark):
    df = spark.createDataFrame(random_rows(2000), SCHEMA)
    total = [vector_codes.compress(df, rounds=k)[0].agg(F.sum("error")).first()[0] for k in (0, 4)]
    assert total[1] < total[0]
