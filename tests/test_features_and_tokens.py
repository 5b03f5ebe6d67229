"""Edge cases of feature text handling, requests and tokens."""

import math

import pytest
from pyspark.sql import functions as F

from txnspark.functions import features as X
from txnspark.functions import rules as R
from txnspark.operators import tokens as K
from txnspark.plans import scoring


def apply(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i")
            .collect()]


def test_amounts(spark):
    assert apply(spark, X.amount_number, ["$1,234.50", "$-3.00"]) == [1234.5, -3.0]
    assert apply(spark, X.tolerant_amount, [None, "", "$", "$842.50", "abc"]) == [
        0.0, 0.0, 0.0, 842.5, 0.0]


def test_zip_rules(spark):
    got = apply(spark, X.zip_number, [None, "", " 78758.0 ", "ABC", "nan"])
    assert got[:4] == [0.0, 0.0, 78758.0, 0.0] and math.isnan(got[4])
    assert apply(spark, X.zip_token_text, ["78758.0", " 00501 ", "nan", "", "12-3"]) == [
        "78758", "00501", "00000", "00000", "00000"]


def test_merchant_and_labels(spark):
    assert apply(spark, X.merchant_number, ["AMAZON", " 42 ", None, ""]) == [-1.0, 42.0, -1.0, -1.0]
    assert apply(spark, X.label_yes, ["YES", "yes", "1", "No"]) == [1, 1, 0, 0]
    assert apply(spark, X.label_positive, ["YES", "Yes", "1", "No"]) == [0, 1, 1, 0]
    assert apply(spark, X.label_any, ["YES", "Yes", "1", "No", None]) == [1, 1, 1, 0, 0]


def test_nonfinite_values_fold(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, float("-inf"), 2.0)],
                               "i int, a double, b double")
    assert [tuple(r) for r in X.fold_nonfinite(df).orderBy("i").collect()] == [
        (1, None, 1.0), (2, None, 2.0)]


def test_money_text_rounds_decimal_halves_up(spark):
    assert apply(spark, X.money_text, [2.675, 0.0, 1234.5], "double") == [
        "$2.68", "$0.00", "$1234.50"]


def test_request_defaults(spark):
    form = spark.createDataFrame([("$5.00", None, "x"), (None, "KROGER", "5411")],
                                 "Amount string, `Merchant Name` string, MCC string")
    got = scoring.canonical_request(form).collect()
    assert (got[0]["amount"], got[0]["merchant_name"], got[0]["mcc"]) == ("$5.00", "AMAZON", 0)
    assert (got[1]["amount"], got[1]["merchant_name"], got[1]["mcc"]) == (
        "$120.00", "KROGER", 5411)
    assert (got[0]["time"], got[0]["year"], got[0]["month"], got[0]["zip"]) == (
        "03:14", 2019, 11, "00000")


def test_example_scores(spark):
    rows = [("$842.50", "DIGITAL-GOODS-LLC", "Online Transaction", "03:14", "00000"),
            ("$48.20", "KROGER", "Chip Transaction", "18:02", "78758")]
    form = spark.createDataFrame(
        rows, "amount string, merchant_name string, use_chip string, time string, zip string")
    f = scoring.request_features(scoring.canonical_request(form))
    got = scoring.fallback_reply(f).orderBy(F.desc("amount_num")).collect()
    risky = 0.18 + 0.30 + 0.22 + 842.5 / 6000
    assert got[0]["p_combined"] == pytest.approx(risky + 0.08)
    assert got[1]["p_raw"] == pytest.approx(0.18 + 48.2 / 6000 - 0.07)
    assert got[0]["merchant_num"] == -1.0 and got[1]["zip_num"] == 78758.0


def test_noise_is_repeatable_and_clipped(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.lit("Chip").alias("use_chip"),
                                  F.lit(12).alias("hour"), F.lit(10.0).alias("amount_num"))
    noisy = lambda key: df.select(R.stub_score(
        F.col("use_chip"), F.col("hour"), F.col("amount_num"), key).alias("p"))
    a = [r["p"] for r in noisy(F.crc32(F.col("row_id").cast("string"))).collect()]
    assert a == [r["p"] for r in noisy(F.crc32(F.col("row_id").cast("string"))).collect()]
    assert 0.01 <= min(a) and max(a) <= 0.99 and len(set(a)) > 1900


def test_hash_buckets(spark):
    for device in ("md5", "xxhash64"):
        got = apply(spark, lambda v: K.merchant_token(v, 2048, device),
                    ["AMAZON", "WALMART", "AMAZON"])
        assert got[0] == got[2] and all(0 <= int(t[6:]) < 2048 for t in got)


def test_quantile_bins_and_dictionary(spark):
    df = spark.range(50).select((F.col("id") * 1000 / 49).alias("amount"))
    got = K.quantile_bin(df, "amount", K.quantile_edges(df, "amount", 10), "bin")
    counts = {r["bin"]: r["count"] for r in got.groupBy("bin").count().collect()}
    assert counts == {i: 5 for i in range(10)}


def test_constant_column_has_one_bin(spark):
    df = spark.range(5).select(F.lit(3.0).alias("v"))
    got = K.quantile_bin(df, "v", K.quantile_edges(df, "v", 10), "bin")
    assert {r["bin"] for r in got.collect()} == {0}


def test_digitize(spark):
    assert apply(spark, lambda v: K.digitize(v, [0.0, 1.0]), [0.5, -1.0, 1.0], "double") == [1, 0, 2]


def slotted(spark, rows):
    return spark.createDataFrame(rows, "row_id long, a string, b string")


def test_encode_matches_the_array_form_and_decodes(spark):
    fit = slotted(spark, [(i, f"A{i % 3}", "B") for i in range(30)])
    new = slotted(spark, [(1, "A0", "B"), (2, "A9", "B"), (3, None, "B")])
    v = K.fit_vocabulary(fit, ["a", "b"])
    ids = {r["token"]: r["id"] for r in v.collect()}
    assert ids["B"] == 4 and [ids[t] for t in K.SPECIALS] == [0, 1, 2, 3]
    got = K.encode(new, v, ["a", "b"], length=6)
    by_row = {r["row_id"]: r["ids"] for r in got.collect()}
    assert by_row[1] == [2, ids["A0"], 4, 3, 0, 0] and by_row[2] == by_row[3] == [2, 1, 4, 3, 0, 0]
    arrays = new.where("a IS NOT NULL").select("row_id", K.token_array(["a", "b"]).alias("tokens"))
    again = {r["row_id"]: r["ids"] for r in K.encode_arrays(arrays, v, length=6).collect()}
    assert again == {k: by_row[k] for k in (1, 2)}
    strips = {r["row_id"]: r["strip"] for r in K.decode(got, v).collect()}
    assert strips[2] == ["<bos>", "<unk>", "B", "<eos>"]


def test_decode_keeps_rows_of_padding(spark):
    v = K.fit_vocabulary(slotted(spark, [(i, f"A{i % 5}", f"B{i % 2}") for i in range(40)]),
                         ["a", "b"])
    ids = {r["token"]: r["id"] for r in v.collect()}
    enc = spark.createDataFrame([(1, [0, 0, 0]), (2, [2, ids["A3"], ids["B1"], 3, 0])],
                                "row_id long, ids array<int>")
    got = {r["row_id"]: r["strip"] for r in K.decode(enc, v).collect()}
    assert got == {1: [], 2: ["<bos>", "A3", "B1", "<eos>"]}


def test_missing_values_have_their_own_tokens(spark):
    row = spark.sql("""SELECT CAST(NULL AS DOUBLE) AS amount_num, CAST(NULL AS BIGINT) AS
      merchant_name, CAST(NULL AS INT) AS mcc, CAST(NULL AS INT) AS hour, CAST(NULL AS STRING) AS
      use_chip, CAST(NULL AS STRING) AS merchant_state""")
    got = K.with_slots(row).first()
    assert [got[s] for s in K.SLOTS] == ["AMT_0", "MERCH_NONE", "MCC_NONE", "HOUR_NONE",
                                         "CHIP_NONE", "STATE_NONE"]


def test_long_sequences_are_cut(spark):
    df = spark.createDataFrame([(1, ["x"] * 300)], "row_id long, tokens array<string>")
    v = spark.createDataFrame([("x", 5)], "token string, id int")
    assert K.encode_arrays(df, v).first()["ids"] == [5] * 128
