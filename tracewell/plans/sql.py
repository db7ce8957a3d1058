"""Shared DuckDB CTEs that rebuild the log, labels and prefix of `plans.tables`."""

L1_LOG = """
raw AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
log AS (
  SELECT user_id * 10 + least(9, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3) AS case_id,
    CASE WHEN event_type = 'purchase' AND value >= 60 THEN 'purchase_hi'
         WHEN event_type = 'error' AND value >= 100 THEN 'error_hi' ELSE event_type END AS activity,
    ts, event_id AS order_key, event_type, value,
    'S' || CAST(user_id % 4 AS VARCHAR) AS segment,
    CAST((user_id * 37 % 500) * 10 AS DOUBLE) AS credit_limit,
    'R' || lpad(CAST(k % 12 AS VARCHAR), 2, '0') AS resource,
    'K' || CAST(k // 20 AS VARCHAR) AS k_bucket,
    CASE WHEN event_type = 'purchase' THEN value END AS amount,
    CASE WHEN event_type = 'click' THEN CAST(k AS DOUBLE) END AS rating,
    CASE WHEN event_type IN ('click','view','signup') THEN 'I' || CAST(k % 3 AS VARCHAR) END AS item_id,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS accepted,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'yes' ELSE 'no' END END AS selected
  FROM raw)"""

L1_CASES = L1_LOG + """,
ord AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, order_key) AS event_pos FROM log),
base AS (
  SELECT case_id, min(ts) AS case_start_time, count(*) AS n_events,
    count(*) FILTER (activity IN ('purchase_hi','error_hi')) AS outcome_event_count,
    count(DISTINCT activity) FILTER (activity IN ('purchase_hi','error_hi')) AS distinct_outcome_count,
    min(activity) FILTER (activity IN ('purchase_hi','error_hi')) AS any_outcome,
    min(event_pos) FILTER (activity IN ('purchase_hi','error_hi')) AS first_pos
  FROM ord GROUP BY case_id),
cases AS (
  SELECT case_id, case_start_time, n_events, outcome_event_count, distinct_outcome_count,
    CASE WHEN distinct_outcome_count = 1 THEN any_outcome END AS outcome_activity,
    CASE WHEN distinct_outcome_count = 1 THEN first_pos END AS outcome_position,
    distinct_outcome_count = 1 AS valid_target,
    CASE WHEN distinct_outcome_count = 1 THEN CASE any_outcome WHEN 'purchase_hi' THEN 1 ELSE 0 END END AS target,
    n_events >= 3 AS has_k_events,
    coalesce(CASE WHEN distinct_outcome_count = 1 THEN first_pos > 3 END, false) AS outcome_after_k,
    distinct_outcome_count = 1 AND n_events >= 3 AND first_pos > 3 AS eligible
  FROM base),
prefix AS (SELECT o.* FROM ord o JOIN cases c USING (case_id) WHERE c.eligible AND o.event_pos <= 3),
elog AS (SELECT o.* FROM ord o JOIN cases c USING (case_id) WHERE c.eligible)"""

L2_LOG = """
log AS (
  SELECT o_custkey AS case_id, o_orderstatus AS activity, o_orderdate AS ts, o_orderkey AS order_key,
    c_mktsegment, c_acctbal, o_orderpriority, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

L2_CASES = L2_LOG + """,
cases AS (
  SELECT case_id, arg_min(c_mktsegment, order_key) AS c_mktsegment, arg_min(c_acctbal, order_key) AS c_acctbal
  FROM log GROUP BY case_id)"""


def l1_log(body: str) -> str:
    return f"WITH {L1_LOG}\n{body}"


def l1(body: str) -> str:
    return f"WITH {L1_CASES}\n{body}"


def l2(body: str) -> str:
    return f"WITH {L2_CASES}\n{body}"
