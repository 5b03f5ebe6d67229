"""Registered scans and sinks: each writes or reads data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.plans import common as C
from txnspark.plans.oracle import events, splits, u
from txnspark.plans.registry import query
from txnspark.session import new_path
from txnspark.sources import committed, delimited, documents, targets
from txnspark.sources.transactions import load_transactions, read_table

STORED = list(S.DISPLAY_NAMES)
DISPLAY_SQL = """SELECT "user" AS "User", card AS "Card", "year" AS "Year", "month" AS "Month",
 "day" AS "Day", "time" AS "Time", amount AS "Amount", use_chip AS "Use Chip",
 merchant_name AS "Merchant Name", merchant_city AS "Merchant City",
 merchant_state AS "Merchant State", zip AS "Zip", mcc AS "MCC", is_fraud AS "Is Fraud?" FROM txn"""
SPLIT_SQL = splits(S.TRAIN_CAP, S.EVAL_ROWS)


def _csv_copy(spark, folder, pad=""):
    """The transaction view as CSV with display names, plus a column nobody reads."""
    path = new_path(spark, "csv")
    txn = S.to_display_names(load_transactions(spark, folder).select(*STORED))
    txn = txn.withColumn("Errors?", F.lit("none"))
    delimited.write_csv(txn.toDF(*[f"{pad}{c}{pad}" for c in txn.columns]), path)
    return path


def _split_target(spark, folder, kind="path", manifest=None):
    path = new_path(spark, "splits")
    name = path if kind == "path" else "splits_" + path[-32:]
    target = targets.DataTarget(kind, name, path if kind == "table" else None)
    rows = C.split_features(spark, folder)
    if manifest:
        targets.write_with_manifest(rows, target, manifest)
    else:
        target.write_splits(rows)
    return target


@query("src_01_csv_scan", events("""SELECT "user" AS "User", amount AS "Amount", mcc AS "MCC",
  zip AS "Zip", is_fraud AS "Is Fraud?" FROM txn"""))
def _(spark, folder):
    return delimited.scan_csv(spark, _csv_copy(spark, folder), delimited.display_types(
        ["user", "amount", "mcc", "zip", "is_fraud"]))


@query("src_02_header_cleanup", events(DISPLAY_SQL))
def _(spark, folder):
    return delimited.scan_csv(spark, _csv_copy(spark, folder, pad=" "), delimited.display_types())


@query("src_03_parquet_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _(spark, folder):
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")


@query("src_04_table_scan", events(
    SPLIT_SQL + " SELECT row_id, amount, y FROM split_rows WHERE split = 'test'"))
def _(spark, folder):
    target = _split_target(spark, folder, "table")
    return target.read_split(spark, "test", ["row_id", "amount", "y"]).orderBy("row_id")


@query("src_05_parquet_sink", events(SPLIT_SQL + ' SELECT row_id, "user", amount, split '
                                     "FROM split_rows"))
def _(spark, folder):
    return _split_target(spark, folder).read(spark).select("row_id", "user", "amount", "split")


@query("src_06_table_sink", events(SPLIT_SQL + ' SELECT row_id, "user", amount, split '
                                   "FROM split_rows"))
def _(spark, folder):
    return (_split_target(spark, folder, "table").read(spark)
            .select("row_id", "user", "amount", "split"))


COUNTS_SQL = SPLIT_SQL + " SELECT split, count(*) AS rows FROM split_rows GROUP BY split"


@query("src_07_write_splits", events(COUNTS_SQL))
def _(spark, folder):
    return targets.split_counts(spark, _split_target(spark, folder))


@query("src_08_interchangeable_targets", events(SPLIT_SQL + """
 SELECT kind, split, count(*) AS rows, round(sum(amount_num), 4) AS amount
 FROM split_rows, (VALUES ('path'), ('table')) k(kind) GROUP BY kind, split"""))
def _(spark, folder):
    def totals(kind):
        rows = _split_target(spark, folder, kind).read(spark)
        return rows.groupBy(F.lit(kind).alias("kind"), "split").agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount_num"), 4).alias("amount"))
    return totals("path").unionByName(totals("table"))


@query("src_09_readiness", events(SPLIT_SQL + """
 SELECT e.split, r.rows, coalesce(r.rows > 0, false) AS ready
 FROM (VALUES ('train'), ('val'), ('test'), ('holdout')) e(split)
 LEFT JOIN (SELECT split, count(*) AS rows FROM split_rows GROUP BY split) r USING (split)"""))
def _(spark, folder):
    return targets.readiness(spark, _split_target(spark, folder), [*S.SPLITS, "holdout"])


@query("src_10_footer_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, folder):
    return targets.footer_counts(spark, f"{folder}/lineitem.parquet")


@query("src_11_manifest", events(COUNTS_SQL))
def _(spark, folder):
    manifest = new_path(spark, "manifest")
    _split_target(spark, folder, manifest=manifest)
    return targets.manifest_counts(spark, manifest)


@query("src_11_committed_counts", events(COUNTS_SQL))
def _(spark, folder):
    # Each split is a batch; the counts come with the commit messages of its tasks.
    path, rows = new_path(spark, "committed"), C.split_features(spark, folder).select(
        "row_id", "amount_num", "y", "split")
    for split in S.SPLITS:
        committed.append_batch(rows.where(F.col("split") == split), path, split, "split")
    return committed.committed_counts(spark, path, "split")


@query("src_13_committed_append", """
SELECT CAST(event_id % 7 AS INTEGER) AS batch_id, count(*) AS rows, sum(event_id)::BIGINT AS ids
FROM events GROUP BY 1""")
def _(spark, folder):
    path = new_path(spark, "committed")
    e = read_table(spark, folder, "events").select("event_id", "event_type", "value", (
        F.col("event_id") % 7).cast("int").alias("batch_id"))
    for batch in (0, 1, 2, 3, 2, 3, 4, 5, 6):  # two of them are retried
        committed.append_batch(e.where(F.col("batch_id") == batch), path, f"b{batch}")
    return committed.read_committed(spark, path, e.schema).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("src_12_column_mapping", events(DISPLAY_SQL))
def _(spark, folder):
    txn = load_transactions(spark, folder).select(*STORED)
    round_trip = S.to_canonical_names(S.to_display_names(txn))
    return S.to_display_names(S.require_columns(round_trip, STORED))


@query("src_13_exactly_once_append", """
SELECT CAST(event_id % 7 AS INTEGER) AS batch_id, count(*) AS rows, sum(event_id)::BIGINT AS ids
FROM events GROUP BY 1""")
def _(spark, folder):
    path = new_path(spark, "batches")
    e = read_table(spark, folder, "events").withColumn(
        "batch_id", (F.col("event_id") % 7).cast("int"))
    targets.append_once(e.where("batch_id < 4"), path)
    targets.append_once(e.where("batch_id >= 2"), path)  # a retry that overlaps
    return spark.read.parquet(path).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


POINTS = """SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
  CAST(label = 0 AS INTEGER) AS fraud FROM embeddings"""


@query("src_16_json_artifacts", POINTS)
def _(spark, folder):
    path = new_path(spark, "points")
    e = read_table(spark, folder, "embeddings")
    documents.write_json(e.select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        (F.col("label") == 0).cast("int").alias("fraud")), path)
    return documents.read_json(spark, path, "vec_id long, x double, y double, fraud int")


@query("src_18_request_rows", events("""
SELECT row_id // 100 AS request_id, row_id, amount, mcc, zip FROM txn"""))
def _(spark, folder):
    txn = load_transactions(spark, folder)
    # Row ids are unique, so a request holds at most 100 rows.
    requests = txn.groupBy(F.floor(F.col("row_id") / 100).alias("request_id")).agg(
        F.to_json(F.struct(F.collect_list(
            F.struct("row_id", "amount", "mcc", "zip")).alias("rows"))).alias("body"))
    return documents.request_rows(requests, "body",
                                  "row_id:bigint, amount:string, mcc:int, zip:double")


# ---- projections ---------------------------------------------------------------------


@query("prj_01_source_columns", events("""SELECT amount, merchant_name, mcc, "year", "month",
 "day", "time", card, use_chip, zip, merchant_state, "user", merchant_city, is_fraud FROM txn"""))
def _(spark, folder):
    return load_transactions(spark, folder).select(*S.source_columns())


@query("prj_02_column_views", events("""SELECT row_id, "user", card, "year", "month", "day",
 "hour", amount, use_chip, merchant_name, merchant_city, merchant_state, zip, mcc, "time"
 FROM feat"""))
def _(spark, folder):
    # Both views come from one scan; they share most columns.
    return C.features(spark, folder).select(
        "row_id", *dict.fromkeys([*S.RAW_VIEW, *S.TOKEN_VIEW]))


@query("prj_03_request_defaults", """
SELECT event_id AS row_id, '$' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount,
  CASE WHEN event_type = 'view' THEN 'AMAZON' ELSE event_type END AS merchant_name,
  'ONLINE' AS merchant_city, 'Online Transaction' AS use_chip,
  coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS mcc,
  '03:14' AS "time", CAST(2019 AS INTEGER) AS "year", CAST(event_id % 5 AS INTEGER) AS card
FROM events""")
def _(spark, folder):
    e = read_table(spark, folder, "events")
    form = e.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("$"), F.col("value").cast("decimal(12,2)").cast("string")).alias("Amount"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("Merchant Name"),
        F.get_json_object("props", "$.k").alias("MCC"),
        (F.col("event_id") % 5).cast("string").alias("Card"))
    from txnspark.plans.scoring import canonical_request
    return canonical_request(form, keep=["row_id"]).select(
        "row_id", "amount", "merchant_name", "merchant_city", "use_chip", "mcc", "time", "year",
        "card")


@query("prj_04_required_columns", events("""
SELECT 'row_id' AS name, true AS present, count(row_id) AS filled FROM txn UNION ALL
SELECT 'zip', true, count(zip) FROM txn UNION ALL
SELECT 'merchant_state', true, count(merchant_state) FROM txn UNION ALL
SELECT 'hour', false, 0"""))
def _(spark, folder):
    return S.column_report(load_transactions(spark, folder),
                           ["row_id", "zip", "merchant_state", "hour"])


@query("prj_05_split_wide_row", """
SELECT vec_id, embedding[1]::DOUBLE AS pca_0, embedding[3]::DOUBLE AS pca_2,
  embedding[11]::DOUBLE AS pca_10, round(list_sum([x::DOUBLE * i FOR x, i IN embedding]), 6)
  AS ordered_sum FROM embeddings""")
def _(spark, folder):
    wide = read_table(spark, folder, "embeddings")
    # Columns arrive in text order (pca_0, pca_1, pca_10, ...).
    names = sorted(f"pca_{i}" for i in range(64))
    wide = wide.select("vec_id", *[F.col("embedding")[int(n[4:])].cast("double").alias(n)
                                   for n in names])
    ordered = S.component_columns(wide.columns)
    total = sum((F.col(c) * F.lit(i + 1) for i, c in enumerate(ordered)), F.lit(0.0))
    return wide.select("vec_id", "pca_0", "pca_2", "pca_10",
                       F.round(total, 6).alias("ordered_sum"))


@query("prj_06_vector_columns", "SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS pca_{i}" for i in range(64)) + " FROM embeddings")
def _(spark, folder):
    from txnspark.operators.vectors import columns_to_vector, vector_to_columns
    e = read_table(spark, folder, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"pca_{i}")
                                for i in range(64)])
    packed = columns_to_vector(wide, S.component_columns(wide.columns), "v")
    return vector_to_columns(packed.select("vec_id", "v"), "v", 64).drop("v")


# ---- filters ---------------------------------------------------------------------------


@query("fil_01_split_predicates", events(SPLIT_SQL + " SELECT row_id, d, split FROM split_rows"))
def _(spark, folder):
    return C.split_features(spark, folder).select("row_id", "d", "split")


@query("fil_02_class_filter", events("SELECT row_id, amount FROM feat WHERE y = 1"))
def _(spark, folder):
    return C.features(spark, folder).where(F.col("y") == 1).select("row_id", "amount")


@query("fil_06_empty_guard", "SELECT count(*) AS n FROM events")
def _(spark, folder):
    txn = S.require_rows(load_transactions(spark, folder), "transactions")
    return txn.agg(F.count(F.lit(1)).alias("n"))
