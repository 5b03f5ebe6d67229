"""Registered key joins, samples, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnspark import schema as S
from txnspark.functions.hashing import choice, uniform
from txnspark.operators import nearest as N
from txnspark.operators import sampling as P
from txnspark.operators import tokens as K
from txnspark.operators import vectors as V
from txnspark.plans import common as C
from txnspark.plans.oracle import events, rnd, rules, splits, u
from txnspark.plans.queries_aggregates import CURVE, EVAL_ROWS, TRAIN_CAP
from txnspark.plans.queries_features import SLOTS_SQL, VOCAB_SQL
from txnspark.plans.registry import query
from txnspark.sources.transactions import load_transactions, order_dates, read_table

# Transactions and the embedding table share a key by position: row_id modulo its size.
EMB_SQL = events(""", e AS (SELECT vec_id, embedding, label FROM embeddings),
 keyed AS (SELECT feat.*, row_id % (SELECT count(*) FROM e) AS vec_id FROM feat)""")


def _with_vec_id(spark, folder):
    n = read_table(spark, folder, "embeddings").agg(F.count(F.lit(1))).scalar()
    return C.features(spark, folder).withColumn("vec_id", F.col("row_id") % n)


@query("joi_01_raw_beside_components", EMB_SQL + " SELECT row_id, amount_num, mcc, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS pca_{i}" for i in range(64)) + " FROM keyed JOIN e USING (vec_id)")
def _(spark, folder):
    emb = read_table(spark, folder, "embeddings")
    return _with_vec_id(spark, folder).join(emb, "vec_id").select(
        "row_id", "amount_num", "mcc",
        *[F.col("embedding")[i].cast("double").alias(f"pca_{i}") for i in range(64)])


def _exact_sql(n, salt, source="feat"):
    return (f"SELECT * FROM {source} QUALIFY row_number() OVER "
            f"(ORDER BY {u('row_id', salt)}, row_id) <= {n}")


@query("joi_02_gather_selection", events(f""", sel AS ({_exact_sql(777, 'gather')})
 SELECT row_id, "user", amount FROM sel"""))
def _(spark, folder):
    f = C.features(spark, folder)
    chosen = P.exact_sample(f.select("row_id"), 777, "gather")
    return f.join(chosen, "row_id", "left_semi").select("row_id", "user", "amount")


@query("joi_03_token_lookup", f"""WITH {SLOTS_SQL}{VOCAB_SQL.format(where="WHERE row_id % 2 = 0")}
 SELECT row_id, t_merchant, coalesce(id, 1) AS id FROM slots
 LEFT JOIN vocab ON token = t_merchant""")
def _(spark, folder):
    slots = K.with_slots(C.features(spark, folder))
    vocabulary = K.fit_vocabulary(slots.where(F.col("row_id") % 2 == 0))
    lookup = vocabulary.select(F.col("token").alias("t_merchant"), "id")
    return slots.join(lookup, "t_merchant", "left").select(
        "row_id", "t_merchant", F.coalesce("id", F.lit(K.UNK_ID)).alias("id"))


@query("joi_04_heads_against_baseline", rules(CURVE.format(by="d, head", src="scores") + f"""
 SELECT m.d, m.head, {rnd('m.auc - b.auc', 6)} AS auc_gain, {rnd('m.ap - b.ap', 6)} AS ap_gain
 FROM met m JOIN met b ON b.d = m.d AND b.head = 'raw' WHERE m.head <> 'raw'"""))
def _(spark, folder):
    m = C.daily_metrics(spark, folder)
    base = m.where(F.col("head") == "raw").select(
        "d", F.col("auc").alias("b_auc"), F.col("ap").alias("b_ap"))
    return m.where(F.col("head") != "raw").join(base, "d").select(
        "d", "head", F.round(F.col("auc") - F.col("b_auc"), 6).alias("auc_gain"),
        F.round(F.col("ap") - F.col("b_ap"), 6).alias("ap_gain"))


@query("joi_06_map_drift", f"""
SELECT vec_id, round(sqrt(pow(embedding[1]::DOUBLE - embedding[3]::DOUBLE, 2)
   + pow(embedding[2]::DOUBLE - embedding[4]::DOUBLE, 2)), 6) AS drift,
  {rnd('list_cosine_similarity(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[])', 6)} AS similarity
FROM embeddings""")
def _(spark, folder):
    e = read_table(spark, folder, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    batch = e.select("vec_id", at(0).alias("x0"), at(1).alias("y0"),
                     F.slice("embedding", 1, 32).alias("v0"))
    live = e.select("vec_id", at(2).alias("x1"), at(3).alias("y1"),
                    F.slice("embedding", 33, 32).alias("v1"))
    drift = V.euclidean(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return batch.join(live, "vec_id").select(
        "vec_id", F.round(drift, 6).alias("drift"),
        F.round(V.cosine("v0", "v1"), 6).alias("similarity"))


@query("joi_07_column_concat", events("SELECT row_id, amount, split_part(\"time\", ':', 1) AS h "
                                      "FROM txn"))
def _(spark, folder):
    txn = load_transactions(spark, folder)
    left = txn.select("row_id", "amount")
    right = txn.select("row_id", F.split_part("time", F.lit(":"), F.lit(1)).alias("h"))
    return left.join(right, "row_id")


@query("joi_08_rows_to_embed", EMB_SQL + f""", cached AS (SELECT * FROM keyed WHERE {u('row_id', 'cache')} < 0.3)
 SELECT split, count(*) AS todo FROM (SELECT row_id, CASE WHEN vec_id < 250 THEN 'a' ELSE 'b' END
 AS split FROM keyed) ANTI JOIN cached USING (row_id) GROUP BY split""")
def _(spark, folder):
    f = _with_vec_id(spark, folder)
    cached = P.bernoulli_sample(f.select("row_id"), 0.3, "cache")
    todo = f.join(cached, "row_id", "left_anti")
    side = F.when(F.col("vec_id") < 250, "a").otherwise("b").alias("split")
    return todo.groupBy(side).agg(F.count(F.lit(1)).alias("todo"))


# ---- samples ---------------------------------------------------------------------------


@query("smp_01_bernoulli", events(
    f"SELECT row_id FROM feat WHERE {u('row_id', 'coin')} < 0.3"))
def _(spark, folder):
    return P.bernoulli_sample(C.features(spark, folder), 0.3, "coin").select("row_id")


@query("smp_02_capped_train", events(splits(TRAIN_CAP, EVAL_ROWS)
       + " SELECT row_id, y FROM sampled WHERE split = 'train'"))
def _(spark, folder):
    from txnspark.plans.ingest import split_and_sample
    kept = split_and_sample(load_transactions(spark, folder), TRAIN_CAP, EVAL_ROWS)
    return kept.where(F.col("split") == "train").select("row_id", "y")


@query("smp_03_evaluation_sample", events(splits(TRAIN_CAP, EVAL_ROWS)
       + " SELECT row_id, split, y FROM sampled WHERE split <> 'train'"))
def _(spark, folder):
    from txnspark.plans.ingest import split_and_sample
    kept = split_and_sample(load_transactions(spark, folder), TRAIN_CAP, EVAL_ROWS)
    return kept.where(F.col("split") != "train").select("row_id", "split", "y")


def _balanced_sql(budget, salt):
    return f""", tot AS (SELECT sum(y) AS f, count(*) - sum(y) AS n, least({budget}, count(*)) AS t
  FROM feat), q AS (SELECT least(f, floor(t * 0.1)) AS qf, least(n, t - least(f, floor(t * 0.1)))
  AS qn FROM tot)
 SELECT row_id, y FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY
  {u('row_id', salt)}, row_id) AS r FROM feat), q WHERE r <= CASE WHEN y = 1 THEN qf ELSE qn END"""


@query("smp_04_balanced_sample", events(_balanced_sql(1000, "balanced")))
def _(spark, folder):
    return P.balanced_sample(C.features(spark, folder), 1000, "balanced").select("row_id", "y")


@query("smp_04_balanced_sample_order_lines", f"""
WITH l AS (SELECT l_orderkey * 10000000 + l_partkey * 100 + l_linenumber AS k0,
   concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS row_id,
   CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
feat AS (SELECT row_id, min(y) AS y FROM l GROUP BY row_id)
{_balanced_sql(9000, 'lines')}""".replace("\n, tot AS", ", tot AS"))
def _(spark, folder):
    lines = read_table(spark, folder, "lineitem").select(
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_shipdate").alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"))
    keyed = lines.groupBy("row_id").agg(F.min("y").alias("y"))
    return P.balanced_sample(keyed, 9000, "lines").select("row_id", "y")


@query("smp_05_natural_sample", events(splits(S.TRAIN_CAP, S.EVAL_ROWS) + f"""
 SELECT row_id, split FROM (
   SELECT row_id, split, row_number() OVER (ORDER BY {u('row_id', 'natural.val')}, row_id) AS r
   FROM split_rows WHERE split = 'val'
   UNION ALL
   SELECT row_id, split, row_number() OVER (ORDER BY {u('row_id', 'natural.test')}, row_id)
   FROM split_rows WHERE split = 'test') WHERE r <= 400"""))
def _(spark, folder):
    rows = C.split_features(spark, folder).select("row_id", "split")
    parts = [P.natural_sample(rows.where(F.col("split") == s), s, 400) for s in ("val", "test")]
    return parts[0].unionByName(parts[1])


@query("smp_06_map_sample", events(_exact_sql(8000, "map").replace("SELECT *", "SELECT row_id, y")))
def _(spark, folder):
    return P.map_sample(C.features(spark, folder)).select("row_id", "y")


@query("smp_07_weighted_choice", events(f"""
SELECT pick, hit, count(*) AS n FROM (SELECT CASE WHEN {u('row_id', 'chip')} < 0.7e0 THEN 'chip'
   ELSE 'swipe' END AS pick, CAST({u('row_id', 'hit')} < 1 / (1 + exp(-(amount_num / 50 - 3)))
   AS INTEGER) AS hit FROM feat) GROUP BY ALL"""))
def _(spark, folder):
    from txnspark.functions.features import logistic
    f = C.features(spark, folder)
    return f.groupBy(
        choice("row_id", "chip", ["chip", "swipe"], [0.7, 0.3]).alias("pick"),
        (uniform("row_id", "hit") < logistic(F.col("amount_num") / 50 - 3)).cast("int")
        .alias("hit")).agg(F.count(F.lit(1)).alias("n"))


# ---- sorts, limits, sets -----------------------------------------------------------------


@query("srt_02_by_row_id", events("SELECT row_id, amount FROM txn ORDER BY row_id"))
def _(spark, folder):
    return load_transactions(spark, folder).select("row_id", "amount").orderBy("row_id")


@query("srt_03_dates", """SELECT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100
  + day(o_orderdate) AS INTEGER) AS d, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1""")
def _(spark, folder):
    from txnspark.operators.splits import date_counts
    return date_counts(order_dates(read_table(spark, folder, "orders"))).orderBy("d")


@query("srt_06_shuffled_train", events(_balanced_sql(2000, "balanced").replace(
    "SELECT row_id, y FROM (", f"SELECT row_id, y, {u('row_id', 'order')} AS draw FROM (")))
def _(spark, folder):
    rows = P.balanced_sample(C.features(spark, folder), 2000, "balanced")
    return rows.select("row_id", "y", uniform("row_id", "order").alias("draw")).orderBy(
        "draw", "row_id")


@query("srt_07_first_rows", events(splits(S.TRAIN_CAP, S.EVAL_ROWS) + """
 SELECT row_id, amount FROM split_rows WHERE split = 'train' ORDER BY row_id LIMIT 2000"""))
def _(spark, folder):
    rows = C.split_features(spark, folder).where(F.col("split") == "train")
    return P.first_rows(rows.select("row_id", "amount"), 2000).orderBy("row_id")


@query("set_01_union", events(splits(S.TRAIN_CAP, S.EVAL_ROWS) + """
 SELECT row_id, y, split FROM split_rows WHERE split = 'train' AND y = 1
 UNION ALL SELECT row_id, y, split FROM split_rows WHERE split = 'val'"""))
def _(spark, folder):
    rows = C.split_features(spark, folder).select("row_id", "y", "split")
    frauds = rows.where((F.col("split") == "train") & (F.col("y") == 1))
    return frauds.unionByName(rows.where(F.col("split") == "val"))


@query("set_02_difference", """SELECT DISTINCT c_custkey AS "user" FROM customer
 EXCEPT SELECT user_id FROM events""")
def _(spark, folder):
    known = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("user"))
    seen = read_table(spark, folder, "events").select(F.col("user_id").alias("user"))
    return known.join(seen, "user", "left_anti").distinct()


@query("set_03_intersection", """SELECT DISTINCT user_id AS "user" FROM events
 INTERSECT SELECT o_custkey FROM orders""")
def _(spark, folder):
    a = read_table(spark, folder, "events").select(F.col("user_id").alias("user"))
    b = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("user"))
    return a.intersect(b)


@query("set_04_unique_sorted", events("""SELECT DISTINCT CAST(floor(row_id * 99e0 /
 (SELECT max(row_id) FROM feat)) AS BIGINT) AS pos FROM feat ORDER BY pos"""))
def _(spark, folder):
    f = load_transactions(spark, folder).select("row_id")
    top = f.agg(F.max("row_id")).scalar()
    return f.select(F.floor(F.col("row_id") * 99.0 / top).alias("pos")).distinct().orderBy("pos")


# ---- vectors ---------------------------------------------------------------------------


@query("vec_01_cosine", """
WITH
m AS (""" + "SELECT label, [" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65))
       + f"""] AS centre FROM embeddings GROUP BY label)
SELECT e.vec_id, {rnd('list_cosine_similarity(e.embedding::DOUBLE[], m.centre)', 6)} AS cosine
FROM embeddings e JOIN m USING (label)""")
def _(spark, folder):
    e = read_table(spark, folder, "embeddings")
    centres = e.groupBy("label").agg(F.array(*[
        F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("centre"))
    return e.join(centres, "label").select(
        "vec_id", F.round(V.cosine("embedding", "centre"), 6).alias("cosine"))


@query("vec_01_nearest_rows")
def _(spark, folder):
    return N.nearest_rows(read_table(spark, folder, "embeddings"), k=10)


@query("vec_01_nearest_rows_are_complete", """
SELECT vec_id AS id, CAST(10 AS BIGINT) AS found, true AS falling, true AS exact
FROM embeddings""")
def _(spark, folder):
    # Ten others for each row, in falling order, with the cosine of the two vectors.
    e = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    near = N.nearest_rows(e, k=10)
    a = e.select(F.col("vec_id").alias("_a"), F.col("embedding").alias("_va"))
    b = e.select(F.col("vec_id").alias("_b"), F.col("embedding").alias("_vb"))
    both = (near.where("id <> neighbour").join(a, F.col("id") == F.col("_a"))
            .join(b, F.col("neighbour") == F.col("_b")))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cosine"))),
                         lambda r: -r["cosine"])
    return both.groupBy("id").agg(
        F.count_distinct("neighbour").alias("found"), (ranked == F.array_sort(ranked)).alias("falling"),
        F.bool_and(F.abs(V.cosine("_va", "_vb") - F.col("cosine")) < 1e-6).alias("exact"))


@query("vec_01_nearest_recall", """
SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, true AS recalled FROM embeddings""")
def _(spark, folder):
    # Every hundredth row against all rows, in blocks, is the truth.
    e = read_table(spark, folder, "embeddings")
    rows = e.select(F.col("vec_id").alias("entry"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.where("entry % 100 = 0")
    truth = N.exact_nearest(rows, asked, 11).where("query <> entry")
    found = N.nearest_rows(e, k=10).select("id", "neighbour", F.lit(1).alias("hit"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "entry"))
    top = truth.withColumn("_rank", rank).where("_rank <= 10")
    share = top.join(found, (F.col("query") == F.col("id")) & (
        F.col("entry") == F.col("neighbour")), "left")
    return share.agg(F.count_distinct("query").alias("queries"),
                     (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recalled"))


def _normal(key, salt):
    return (f"sqrt(-2e0 * ln(1e0 - {u(key, salt + '.r')})) * "
            f"cos({2 * 3.141592653589793!r}::DOUBLE * {u(key, salt + '.a')})")


SIGNALS = ["mcc / 5000e0", "\"day\" / 31e0", "user_share", "amount_num / 100e0"]
NOISE = 0.15


@query("vec_02_linear_map", events(f""",
w AS (SELECT i.range AS i, j.range AS j, {_normal("(i.range || '.' || j.range)", "projection")} AS w
  FROM range({len(SIGNALS)}) i, range(512) j),
src AS (SELECT *, ("user" % 7) / 7e0 AS user_share FROM feat),
s AS ({" UNION ALL ".join(f"SELECT row_id, {i} AS i, {x} AS v FROM src"
                          for i, x in enumerate(SIGNALS))}),
e AS (SELECT row_id, j, sum(v * w) AS x FROM s JOIN w USING (i) GROUP BY row_id, j),
n AS (SELECT row_id, {", ".join(f"{u('row_id', 'projection.noise.' + c)} AS {c}" for c in "abcd")}
  FROM feat),
noisy AS (SELECT row_id, j, x + {NOISE}e0 * sqrt(-2e0 * ln(1e0 - (a + j * b) % 1))
  * cos({2 * 3.141592653589793!r}::DOUBLE * ((c + j * d) % 1)) AS x FROM e JOIN n USING (row_id))
SELECT row_id, count(*)::INT AS dims, {rnd("sum(x)", 5)} AS total, {rnd("sum(x * x)", 4)} AS energy,
  {rnd("sum(x * (j + 1))", 3)} AS weighted FROM noisy GROUP BY row_id"""))
def _(spark, folder):
    f = C.features(spark, folder)
    signals = [F.col("mcc") / 5000.0, F.col("day") / 31.0, (F.col("user") % 7) / 7.0,
               F.col("amount_num") / 100.0]
    mapped = V.linear_map(signals, 512, noise=NOISE, key=F.col("row_id"))
    # Three sums over all 512 components stand for them, in one pass over the vector.
    return f.select("row_id", V.component_sums(mapped).alias("s")).select(
        "row_id", "s.dims", F.round("s.total", 5).alias("total"),
        F.round("s.energy", 4).alias("energy"), F.round("s.weighted", 3).alias("weighted"))


@query("agg_19_mean_and_covariance", f"""
WITH x AS (SELECT embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT i.range AS i, j.range AS j FROM range(64) i, range(64) j WHERE i.range <= j.range)
SELECT i, j, {rnd("avg(v[i + 1])", 9)} AS mean_i, {rnd("avg(v[j + 1])", 9)} AS mean_j,
  {rnd("covar_samp(v[i + 1], v[j + 1])", 9)} AS cov FROM x, p GROUP BY i, j""")
def _(spark, folder):
    m = V.mean_and_covariance(read_table(spark, folder, "embeddings"))
    return m.select("i", "j", *[F.round(c, 9).alias(c) for c in ("mean_i", "mean_j", "cov")])
