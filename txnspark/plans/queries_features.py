"""Registered scalar features, rule scores, tokens and JSON replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnspark.functions import features as X
from txnspark.functions import rules as R
from txnspark.operators import tokens as K
from txnspark.operators.ordered import time_gap
from txnspark.plans import common as C
from txnspark.plans import scoring
from txnspark.plans.oracle import EVENTS, events, rules, u
from txnspark.plans.registry import query
from txnspark.sources import documents
from txnspark.sources.transactions import load_transactions, read_table


def feature(name, sql_expr, column, source="feat"):
    """Registers (row_id, value) of one expression over every transaction."""
    @query(name, f"WITH {C_SQL[source]} SELECT row_id, {sql_expr} AS value "
                 f"FROM {source}")
    def _(spark, folder):
        rows = C.features(spark, folder) if source == "feat" else odd_text(spark, folder)
        return rows.select("row_id", column().alias("value"))


# Text as a form or a foreign system sends it, derived from every event.
ODD_SQL = """odd AS (SELECT event_id AS row_id,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN ''
       WHEN event_id % 5 = 2 THEN '$1,' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)
       ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS amount,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 24 AS INTEGER) END AS "hour",
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'noon'
       ELSE strftime(ts, '%H:%M') END AS "time",
  CASE WHEN event_id % 2 = 0 THEN ' ' || CAST(event_id * 7919 AS VARCHAR) || ' '
       ELSE upper(event_type) END AS merchant,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'ABC' WHEN 3 THEN NULL
       WHEN 4 THEN ' ' || (10000 + event_id % 80000) || '.0 '
       ELSE CAST(10000 + event_id % 80000 AS VARCHAR) END AS zip,
  CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'infinity'::DOUBLE
       WHEN 2 THEN '-infinity'::DOUBLE ELSE value END AS reading,
  CASE event_id % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'Yes' WHEN 2 THEN '1' ELSE 'No' END AS label,
  value, ts FROM events)"""


def odd_text(spark, folder):
    e = read_table(spark, folder, "events")
    k = F.col("event_id")
    money = F.col("value").cast("decimal(12,2)").cast("string")
    zips = (F.lit(10000) + k % 80000).cast("string")
    return e.select(
        k.alias("row_id"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "")
        .when(k % 5 == 2, F.concat(F.lit("$1,"), money)).otherwise(money).alias("amount"),
        F.when(k % 3 != 0, (k % 24).cast("int")).alias("hour"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "noon")
        .otherwise(F.date_format("ts", "HH:mm")).alias("time"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), (k * 7919).cast("string"), F.lit(" ")))
        .otherwise(F.upper("event_type")).alias("merchant"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "nan").when(k % 6 == 2, "ABC")
        .when(k % 6 == 3, F.lit(None)).when(k % 6 == 4, F.concat(F.lit(" "), zips, F.lit(".0 ")))
        .otherwise(zips).alias("zip"),
        F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf"))
        .when(k % 4 == 2, float("-inf")).otherwise(F.col("value")).alias("reading"),
        F.when(k % 4 == 0, "YES").when(k % 4 == 1, "Yes").when(k % 4 == 2, "1")
        .otherwise("No").alias("label"), "value", "ts")


C_SQL = {"feat": EVENTS, "odd": ODD_SQL}

feature("fe_01_hour", "CAST(split_part(\"time\", ':', 1) AS INTEGER)",
        lambda: X.hour_of(F.col("time")))
feature("fe_02_amount", "CAST(regexp_replace(amount, '[$,]', '', 'g') AS DOUBLE)",
        lambda: X.amount_number(F.col("amount")))
feature("fe_03_date_key", '"year" * 10000 + "month" * 100 + "day"',
        lambda: X.date_key(F.col("year"), F.col("month"), F.col("day")))
feature("fe_04_label_yes", "CAST(lower(label) = 'yes' AS INTEGER)",
        lambda: X.label_yes(F.col("label")), "odd")
feature("fe_05_label_positive", "CAST(label = 'Yes' OR label = '1' AS INTEGER)",
        lambda: X.label_positive(F.col("label")), "odd")
feature("fe_06_tolerant_amount",
        "coalesce(TRY_CAST(nullif(regexp_replace(amount, '[$,]', '', 'g'), '') AS DOUBLE), 0)",
        lambda: X.tolerant_amount(F.col("amount")), "odd")
feature("fe_07_hour_default", """coalesce("hour", CASE WHEN coalesce("time", '0:00') LIKE '%:%'
        THEN TRY_CAST(split_part(coalesce("time", '0:00'), ':', 1) AS INTEGER) END, 0)""",
        lambda: X.tolerant_hour(F.col("hour"), F.col("time")), "odd")
feature("fe_08_merchant_number", "coalesce(TRY_CAST(trim(merchant) AS DOUBLE), -1)",
        lambda: X.merchant_number(F.col("merchant")), "odd")
feature("fe_09_zip_number", """coalesce(CASE WHEN lower(nullif(trim(zip), '')) = 'nan'
        THEN 'nan'::DOUBLE ELSE TRY_CAST(nullif(trim(zip), '') AS DOUBLE) END, 0)""",
        lambda: X.zip_number(F.col("zip")), "odd")
feature("fe_10_zip_token", r"""CASE WHEN regexp_matches(regexp_replace(trim(zip), '\.0$', ''),
        '^[0-9]+$') THEN regexp_replace(trim(zip), '\.0$', '') ELSE '00000' END""",
        lambda: X.zip_token_text(F.col("zip")), "odd")
feature("fe_11_zip_prefix", r"""substr(CASE WHEN regexp_matches(regexp_replace(trim(zip),
        '\.0$', ''), '^[0-9]+$') THEN regexp_replace(trim(zip), '\.0$', '') ELSE '00000' END, 1, 3)""",
        lambda: X.zip_prefix(X.zip_token_text(F.col("zip"))), "odd")
feature("fe_12_null_folding", "CASE WHEN isfinite(reading) THEN reading END",
        lambda: X.finite_or_null(F.col("reading")), "odd")
feature("fe_13_money_text", "'$' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)",
        lambda: X.money_text(F.col("value")), "odd")
feature("fe_14_rounding", "round(value / 7, 3)",
        lambda: F.round(F.col("value") / 7, 3), "odd")
feature("fe_15_log_amount", "round(ln(1 + amount_num), 9)",
        lambda: F.round(F.log1p("amount_num"), 9))
feature("fe_16_logistic", "round(1 / (1 + exp(-(amount_num / 100 - 2))), 9)",
        lambda: F.round(X.logistic(F.col("amount_num") / 100 - 2), 9))


@query("fe_17_clamp", events("""SELECT row_id, greatest(least(amount_num, 200), 10) AS value,
  greatest(least(amount_num, 200), 10) <> amount_num AS clamped FROM feat"""))
def _(spark, folder):
    box = (F.col("amount_num"), F.lit(10.0), F.lit(200.0))
    return C.features(spark, folder).select(
        "row_id", X.clamp(*box).alias("value"), X.is_clamped(*box).alias("clamped"))


@query("fe_18_run_stamp", """
SELECT event_id AS row_id, 'r' || event_id || '-' || strftime(ts, '%Y%m%dT%H%M%S') AS run_id,
  round((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1e6, 1) AS elapsed_s FROM events""")
def _(spark, folder):
    ts = F.col("ts").cast("timestamp")
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), X.run_id(F.col("event_id"), ts).alias("run_id"),
        X.elapsed_seconds(F.date_trunc("hour", ts), ts).alias("elapsed_s"))


@query("fe_19_time_delta", events("""
SELECT "user", card, count(*) AS n, min(delta) AS shortest_s, round(sum(delta), 3) AS total_s FROM
 (SELECT "user", card, (epoch_us(ts) - lag(epoch_us(ts)) OVER
   (PARTITION BY "user", card ORDER BY ts, row_id)) / 1e6 AS delta FROM txn) GROUP BY "user", card"""))
def _(spark, folder):
    gaps = time_gap(load_transactions(spark, folder))
    return gaps.groupBy("user", "card").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_delta_s").alias("shortest_s"),
        F.round(F.sum("time_delta_s"), 3).alias("total_s"))


@query("rul_01_fallback_score", rules("""SELECT row_id,
  round(base, 9) AS base, round(greatest(least(base + -0.07e0, 0.99), 0.01), 9) AS raw,
  round(greatest(least(base + 0.05e0, 0.99), 0.01), 9) AS embed,
  round(greatest(least(base + 0.08e0, 0.99), 0.01), 9) AS combined FROM rule"""))
def _(spark, folder):
    base = R.fallback_score(F.col("use_chip"), F.col("hour"), F.col("amount_num"))
    heads = R.fallback_heads(base)
    return C.features(spark, folder).select(
        "row_id", F.round(base, 9).alias("base"),
        *[F.round(p, 9).alias(h) for h, p in heads.items()])


@query("rul_02_stub_score", rules("SELECT row_id, round(stub, 9) AS p FROM rule"))
def _(spark, folder):
    p = R.stub_score(F.col("use_chip"), F.col("hour"), F.col("amount_num"))
    return C.features(spark, folder).select("row_id", F.round(p, 9).alias("p"))


# ---- tokens --------------------------------------------------------------------------

MERCH = f"'MERCH_' || CAST(floor({u('merchant_name', 'bucket')} * 2000e0) AS INTEGER)"
AMT = "'AMT_' || CAST(floor(ln(1 + greatest(amount_num, 0)) * 2) AS BIGINT)"
SLOTS_SQL = f"""{EVENTS}, slots AS (SELECT *, {AMT} AS t_amount, {MERCH} AS t_merchant,
  'MCC_' || mcc AS t_mcc, 'HOUR_' || "hour" AS t_hour,
  'CHIP_' || upper(split_part(use_chip, ' ', 1)) AS t_chip,
  'STATE_' || coalesce(merchant_state, 'NONE') AS t_state FROM feat)"""
VOCAB_SQL = """, tok AS (SELECT unnest([t_amount, t_merchant, t_mcc, t_hour, t_chip, t_state])
   AS token FROM slots {where}),
cnt AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id, n
  FROM cnt)"""


def _slots(spark, folder):
    return K.with_slots(C.features(spark, folder))


@query("tok_01_merchant_bucket", events(f"SELECT row_id, {MERCH} AS token FROM feat"))
def _(spark, folder):
    return C.features(spark, folder).select(
        "row_id", K.merchant_token("merchant_name").alias("token"))


@query("tok_02_amount_bucket", events(f"SELECT row_id, {AMT} AS token FROM feat"))
def _(spark, folder):
    return C.features(spark, folder).select(
        "row_id", K.amount_token(F.col("amount_num")).alias("token"))


@query("tok_03_quantile_bins", events(
    ", q AS (SELECT " + ", ".join(f"quantile_cont(amount_num, {i / 10}) AS q{i}"
                                  for i in range(1, 10)) + """ FROM feat)
SELECT row_id, 'AMT_' || (""" + " + ".join(f"(amount_num >= q{i})::INT" for i in range(1, 10))
    + ") AS token FROM feat, q"))
def _(spark, folder):
    f = C.features(spark, folder)
    binned = K.quantile_bin(f, "amount_num", K.quantile_edges(f, "amount_num", 10), "bin")
    return binned.select("row_id", F.concat(F.lit("AMT_"), F.col("bin").cast("string"))
                         .alias("token"))


@query("tok_04_fixed_bins", events("""SELECT row_id, (amount_num >= 0)::INT + (amount_num >= 1)::INT
  + (amount_num >= 50)::INT + (amount_num >= 100)::INT + (amount_num >= 250)::INT AS bin FROM feat"""))
def _(spark, folder):
    return C.features(spark, folder).select(
        "row_id", K.digitize(F.col("amount_num"), [0.0, 1.0, 50.0, 100.0, 250.0]).alias("bin"))


@query("tok_05_token_array", f"""WITH {SLOTS_SQL} SELECT row_id, array_to_string(['<bos>', t_amount,
  t_merchant, t_mcc, t_hour, t_chip, t_state, '<eos>'], ' ') AS tokens FROM slots""")
def _(spark, folder):
    return _slots(spark, folder).select(
        "row_id", F.array_join(K.token_array(), " ").alias("tokens"))


@query("tok_06_temporal_tokens", events("""
, g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY "user", card
    ORDER BY ts, row_id)) / 1e6 AS gap FROM feat)
SELECT row_id, 'HOUR_' || "hour" AS t_hour, 'DOW_' || (isodow(ts) - 1) AS t_dow,
  'DT_' || CASE WHEN gap IS NULL THEN 'FIRST' WHEN gap < 60 THEN 'MINUTE' WHEN gap < 3600
  THEN 'HOUR' WHEN gap < 86400 THEN 'DAY' WHEN gap < 604800 THEN 'WEEK' ELSE 'LONG' END AS t_gap,
  'MCCG_' || (mcc // 100) AS t_mcc_group FROM g"""))
def _(spark, folder):
    gaps = time_gap(C.features(spark, folder))
    return K.with_slots(gaps, extra=True).select(
        "row_id", "t_hour", "t_dow", "t_gap", "t_mcc_group")


@query("tok_07_vocabulary", f"WITH {SLOTS_SQL}{VOCAB_SQL.format(where='')} "
       "SELECT token, id, n FROM vocab UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), "
       "('<unk>', 1, 0), ('<bos>', 2, 0), ('<eos>', 3, 0))")
def _(spark, folder):
    return K.fit_vocabulary(_slots(spark, folder))


LOOKUP = " ".join(f"LEFT JOIN vocab v{i} ON v{i}.token = {s}" for i, s in enumerate(K.SLOTS))
ID_LIST = ", ".join(f"coalesce(v{i}.id, 1)" for i in range(len(K.SLOTS)))


@query("tok_08_encode", f"""WITH {SLOTS_SQL}{VOCAB_SQL.format(where="WHERE row_id % 2 = 0")}
 SELECT row_id, array_to_string(list_concat([2, {ID_LIST}, 3], [0 FOR i IN range(120)]), ' ') AS ids
 FROM slots {LOOKUP}""")
def _(spark, folder):
    # Fitted on the even rows, applied to all: the odd rows show unknown tokens.
    slots = _slots(spark, folder)
    vocabulary = K.fit_vocabulary(slots.where(F.col("row_id") % 2 == 0))
    return K.encode(slots, vocabulary).select(
        "row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


STRIP = ", ".join(f"CASE WHEN v{i}.id IS NULL THEN '<unk>' ELSE {s} END"
                  for i, s in enumerate(K.SLOTS))


@query("tok_09_decode", f"""WITH {SLOTS_SQL}{VOCAB_SQL.format(where="WHERE row_id % 2 = 0")}
 SELECT row_id, array_to_string(['<bos>', {STRIP}, '<eos>'], ' ') AS strip,
   CAST(2 + {' + '.join(f'(v{i}.id IS NULL)::INT' for i in range(6))} AS INTEGER) AS specials
 FROM slots {LOOKUP}""")
def _(spark, folder):
    slots = _slots(spark, folder)
    vocabulary = K.fit_vocabulary(slots.where(F.col("row_id") % 2 == 0))
    strips = K.decode(K.encode(slots, vocabulary).select("row_id", "ids"), vocabulary)
    return strips.select("row_id", F.array_join("strip", " ").alias("strip"), F.size(
        F.filter("strip", lambda t: t.startswith("<"))).alias("specials"))


@query("tok_10_vocabulary_check", f"""WITH {SLOTS_SQL}{VOCAB_SQL.format(where="WHERE row_id % 2 = 0")},
 seen AS (SELECT unnest([t_amount, t_merchant, t_mcc, t_hour, t_chip, t_state]) AS token FROM slots)
 SELECT 'all' AS fitted_on, count(*) AS unknown FROM seen WHERE token IS NULL
 UNION ALL SELECT 'even rows', count(DISTINCT token) FROM seen ANTI JOIN vocab USING (token)""")
def _(spark, folder):
    slots = _slots(spark, folder)

    def unknown(fitted_on, rows):
        missing = K.unknown_tokens(slots, K.fit_vocabulary(rows))
        return missing.agg(F.count(F.lit(1)).alias("unknown")).select(
            F.lit(fitted_on).alias("fitted_on"), "unknown")
    return unknown("all", slots).unionByName(
        unknown("even rows", slots.where(F.col("row_id") % 2 == 0)))


@query("jsn_01_score_reply", rules("""SELECT row_id, round(greatest(least(base + 0.08e0, 0.99),
  0.01), 9) AS combined, 512 AS embedding_dim, 'fallback' AS mode, amount AS first_token FROM rule"""))
def _(spark, folder):
    scored = scoring.fallback_reply(C.features(spark, folder))
    heads = {h: F.col(f"p_{h}") for h in ("raw", "embed", "combined")}
    reply = documents.score_reply("fallback", F.array("amount"), 512, heads,
                                  F.lit(0.0), F.lit(0.0))
    parsed = F.from_json(F.col("reply"), "mode string, tokens array<string>, embedding_dim int, "
                         "scores struct<raw:double, embed:double, combined:double>")
    r = scored.select("row_id", reply.alias("reply")).select("row_id", parsed.alias("r"))
    return r.select("row_id", F.round("r.scores.combined", 9).alias("combined"),
                    "r.embedding_dim", "r.mode", F.col("r.tokens")[0].alias("first_token"))


@query("fil_05_decision", rules("""SELECT row_id, head,
  CASE WHEN p >= 0.5 THEN 'FLAG · REVIEW' ELSE 'CLEAR' END AS verdict FROM scores
  WHERE head = 'combined'"""))
def _(spark, folder):
    s = C.scores(spark, folder).where(F.col("head") == "combined")
    return s.select("row_id", "head", scoring.verdict(F.col("p")).alias("verdict"))


@query("fil_03_known_heads", rules("""SELECT CASE head WHEN 'raw' THEN 0 WHEN 'embed' THEN 1
  ELSE 2 END AS ordinal, head, count(*) AS n FROM scores
  WHERE head IN ('raw', 'embed', 'combined') GROUP BY head"""))
def _(spark, folder):
    known = ["raw", "embed", "combined"]
    ordinal = F.array_position(F.array(*map(F.lit, known)), F.col("head")).cast("int") - 1
    return (C.scores(spark, folder).where(F.col("head").isin(known))
            .groupBy("head").agg(F.count(F.lit(1)).alias("n")).withColumn("ordinal", ordinal))
