"""SQL fragments shared by the DuckDB checks."""

from __future__ import annotations


def u(key: str, salt: str) -> str:
    return (f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT)"
            " / 4294967296e0)")


def rnd(expr: str, digits: int) -> str:
    """round() without a negative zero."""
    r = f"round({expr}, {digits})"
    return f"(CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END)"


EVENTS = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_type IN ('click', 'error') AS online, {u('event_id', 'label')} AS u_label
  FROM events),
txn AS (
  SELECT event_id AS row_id, user_id AS "user", event_id % 5 AS card,
         CAST(year(ts) AS INTEGER) AS "year", CAST(month(ts) AS INTEGER) AS "month",
         CAST(day(ts) AS INTEGER) AS "day", strftime(ts, '%H:%M') AS "time",
         '$' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount,
         CASE WHEN online THEN 'Online Transaction' WHEN event_type = 'view'
              THEN 'Swipe Transaction' ELSE 'Chip Transaction' END AS use_chip,
         CAST(k AS BIGINT) * 7919 - 400000 AS merchant_name,
         CASE WHEN online THEN 'ONLINE' ELSE 'CITY_' || (k % 7) END AS merchant_city,
         CASE WHEN NOT online THEN 'S' || (k % 5) END AS merchant_state,
         CASE WHEN NOT online THEN 10000e0 + k * 37 END AS zip,
         CAST(5000 + (k % 20) * 10 AS INTEGER) AS mcc,
         CASE WHEN u_label < 0.003e0 + 0.02e0 * (event_type = 'error')::INT::DOUBLE
                  + 0.05e0 * (value >= 150)::INT::DOUBLE
                  + 0.01e0 * (hour(ts) BETWEEN 1 AND 4)::INT::DOUBLE
              THEN 'Yes' ELSE 'No' END AS is_fraud, ts
  FROM ev),
feat AS (
  SELECT *, CAST(split_part("time", ':', 1) AS INTEGER) AS "hour",
         CAST(regexp_replace(amount, '[$,]', '', 'g') AS DOUBLE) AS amount_num,
         CAST("year" * 10000 + "month" * 100 + "day" AS INTEGER) AS d,
         CAST(lower(is_fraud) = 'yes' AS INTEGER) AS y
  FROM txn)"""

RULES = EVENTS + """,
sig AS (
  SELECT *, 0.30e0 * (use_chip = 'Online Transaction')::INT::DOUBLE AS s_on,
         0.22e0 * ("hour" BETWEEN 1 AND 4)::INT::DOUBLE AS s_odd,
         least(amount_num / 6000e0, 0.35e0) AS s_amt FROM feat),
rule AS (
  SELECT *, greatest(least(0.18e0 + s_on + s_odd + s_amt, 0.98e0), 0.01e0) AS base,
         greatest(least(0.24e0 + s_on + s_odd + s_amt, 0.99e0), 0.01e0) AS stub FROM sig),
scores AS (
  SELECT row_id, y, d, 'raw' AS head, greatest(least(base + -0.07e0, 0.99e0), 0.01e0) AS p FROM rule
  UNION ALL
  SELECT row_id, y, d, 'embed', greatest(least(base + 0.05e0, 0.99e0), 0.01e0) FROM rule
  UNION ALL
  SELECT row_id, y, d, 'combined', greatest(least(base + 0.08e0, 0.99e0), 0.01e0) FROM rule
  UNION ALL
  SELECT row_id, y, d, 'external', stub FROM rule)"""


def events(body: str) -> str:
    return f"WITH {EVENTS}\n{body}"


def rules(body: str) -> str:
    return f"WITH {RULES}\n{body}"


def splits(train_cap: int, eval_rows: int) -> str:
    """Cut-offs, sizes and rates (``plan``) and the labelled split (``split_rows``)."""
    return f""",
dc AS (SELECT d, count(*) AS n FROM feat GROUP BY d),
cum AS (SELECT d, n, sum(n) OVER (ORDER BY d) AS cum, sum(n) OVER () AS total FROM dc),
cuts AS (SELECT min(CASE WHEN cum >= 0.8e0 * total THEN d END) AS train_cut,
                min(CASE WHEN cum >= 0.9e0 * total THEN d END) AS test_cut,
                CAST(max(total) AS BIGINT) AS total FROM cum),
sizes AS (SELECT train_cut, test_cut, any_value(cuts.total) AS total,
   CAST(coalesce(sum(n) FILTER (d < train_cut), 0) AS BIGINT) AS n_train,
   CAST(coalesce(sum(n) FILTER (d >= train_cut AND d < test_cut), 0) AS BIGINT) AS n_val,
   CAST(coalesce(sum(n) FILTER (d >= test_cut), 0) AS BIGINT) AS n_test
   FROM cum, cuts GROUP BY ALL),
plan AS (SELECT *, least(1e0, {train_cap}e0 / greatest(1, n_train)) AS keep_train,
   least(1e0, {eval_rows}e0 / greatest(1, n_val)) AS keep_val,
   least(1e0, {eval_rows}e0 / greatest(1, n_test)) AS keep_test FROM sizes),
split_rows AS (SELECT feat.*, CASE WHEN d < train_cut THEN 'train' WHEN d < test_cut THEN 'val'
   ELSE 'test' END AS split, keep_train, keep_val, keep_test FROM feat, plan),
sampled AS (SELECT * FROM split_rows WHERE CASE
   WHEN split = 'train' THEN y = 1 OR {u('row_id', 'ingest')} < keep_train
   WHEN split = 'val' THEN {u('row_id', 'ingest')} < keep_val
   ELSE {u('row_id', 'ingest')} < keep_test END)"""
