"""The same results written independently as plain SQL over the given tables (DuckDB dialect).

``CTES`` holds the data model and shared steps; each query in ``SQL`` gets the ones it names, directly or not.
"""

from __future__ import annotations

import re

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(column: str) -> str:
    return TS.format(column)


CTES: dict[str, str] = {}
SQL: dict[str, str] = {}

# -- data model --------------------------------------------------------------------------------------------------

CTES["seg"] = """
SELECT c_custkey AS user_id, printf('SEG-%07d', c_custkey + 1) AS segment_id, c_mktsegment AS cohort,
  CASE c_nationkey % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'web' END AS platform, r_name AS region,
  CAST(20000 + (c_custkey * 7919) % 400000 AS INTEGER) AS mau,
  c_mktsegment || ' cohort on ' || (CASE c_nationkey % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'web' END)
   || ' in ' || r_name || ' . ' ||
   CASE WHEN c_custkey % 3 = 0 THEN 'Conversion sliding since the checkout change; a proven variant may recover it.'
        ELSE 'Funnel healthy, converting to plan.' END AS segment_summary,
  TRUE AS is_active
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["ev"] = """
SELECT printf('SEG-%07d', user_id + 1) AS segment_id, CAST(ts AS DATE) AS event_date,
  event_type = 'purchase' AS converted, CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue_usd
FROM events"""

CTES["snap"] = """
SELECT printf('SEG-%07d', user_id + 1) AS segment_id, DATE '2024-01-01' + CAST(b * 10 + 9 AS INTEGER) AS snapshot_date,
  ((20000 * p + n) // (2 * n)) / 10000.0::DOUBLE AS conversion_rate, CAST(n AS INTEGER) AS sessions,
  CASE (user_id * 5 + b * 3) % 8
    WHEN 0 THEN 'conversion dropping since the checkout change' WHEN 1 THEN 'android funnel regressed, ios fine'
    WHEN 2 THEN 'drop-off at payment step for this segment' WHEN 3 THEN 'needs a rollback or a proven variant'
    WHEN 4 THEN 'losing this cohort week over week' WHEN 5 THEN 'converting to plan'
    WHEN 6 THEN 'funnel healthy, no regressions' END AS pm_note_text
FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS b,
        CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS p, count(*) AS n FROM events GROUP BY 1, 2)"""

CTES["exp"] = """
SELECT experiment_id, upper(feature_area[1]) || feature_area[2:] || ' ' || variant || ' [' || tested_cohort || ']' AS experiment_name,
  variant, feature_area, tested_cohort, tested_platform, won, observed_lift,
  'Experiment on the ' || feature_area || ' flow, ' || variant || ', tested on ' || tested_cohort || ' / ' || tested_platform || '. ' ||
  CASE WHEN won THEN 'WON: lifted conversion by ' || CAST(round(observed_lift * 100, 2) AS VARCHAR)
    || ' points. A proven variant to replicate for similar cohorts.' ELSE 'Did not lift conversion; not recommended.' END AS description,
  TRUE AS is_active
FROM (SELECT *, CASE WHEN won THEN p_size / 1000.0::DOUBLE ELSE -0.002::DOUBLE END AS observed_lift FROM (
  SELECT printf('EXP-%07d', p_partkey + 1) AS experiment_id, p_size,
    (['checkout', 'onboarding', 'discovery', 'pricing'])[p_partkey % 4 + 1] AS feature_area,
    'variant_' || (['a', 'b', 'c'])[p_partkey % 3 + 1] AS variant,
    (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[p_partkey % 5 + 1] AS tested_cohort,
    (['ios', 'android', 'web'])[(p_partkey // 5) % 3 + 1] AS tested_platform,
    p_size <= 22 AND (['ios', 'android', 'web'])[(p_partkey // 5) % 3 + 1] <> 'web' AS won
  FROM part))"""

CTES["flag"] = """
SELECT printf('FLAG-%05d', user_id * 8 + a * 2 + v + 1) AS flag_id, segment_id, feature_area,
  feature_area || '_flow' AS flag_key, (['control', 'variant_a', 'variant_b'])[(user_id + a + v) % 3 + 1] AS variant,
  ([0, 25, 50, 100])[((user_id // 3) + a) % 4 + 1] AS rollout_pct,
  DATE '2024-01-31' - CAST((user_id * (a + 1)) % 90 + v * 30 AS INTEGER) AS updated_date
FROM seg, (VALUES (0, 'checkout'), (1, 'onboarding'), (2, 'discovery'), (3, 'pricing')) ar(a, feature_area), (VALUES (0), (1)) ve(v)"""

CTES["outc"] = """
SELECT printf('SEG-%07d', o_custkey + 1) AS segment_id,
  (['ship_proven_variant', 'rollout_existing_flag', 'ship_alt_variant'])[l_linenumber % 3 + 1] AS action_type,
  l_returnflag = 'R' AS had_matching_experiment, round(0.025::DOUBLE + l_tax / 10.0, 4) AS conversion_at_action,
  CAST(l_shipdate AS DATE) AS initiated_date,
  CASE WHEN l_linenumber % 3 = 1 THEN 500.0::DOUBLE ELSE 5000.0::DOUBLE END AS ship_cost_usd,
  round(l_discount / 5.0 + CASE WHEN l_linenumber % 3 = 0 AND l_returnflag = 'R' THEN 0.012 ELSE 0.0 END, 4) AS conversion_lift,
  CAST(l_quantity * 1000 AS INTEGER) AS users_recovered
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

# -- silver and gold ---------------------------------------------------------------------------------------------

CTES["notes"] = """
SELECT pm_note_text, label, CASE label WHEN 'sliding' THEN 1.0::DOUBLE WHEN 'healthy' THEN 0.1::DOUBLE ELSE 0.6::DOUBLE END AS slide_signal_score
FROM (SELECT DISTINCT pm_note_text,
  CASE WHEN pm_note_text IN ('converting to plan', 'funnel healthy, no regressions') THEN 'healthy' ELSE 'sliding' END AS label
  FROM snap WHERE pm_note_text IS NOT NULL)"""

CTES["daily"] = """
SELECT segment_id, event_date, count(*) AS sessions, CAST(count(*) FILTER (converted) AS BIGINT) AS conversions,
  sum(revenue_usd) AS revenue, CAST(count(*) FILTER (converted) AS DOUBLE) / count(*) AS conversion_rate,
  any_value(cohort) AS cohort, any_value(platform) AS platform, any_value(region) AS region
FROM ev JOIN seg USING (segment_id) GROUP BY 1, 2"""

CTES["conv"] = """
SELECT snap.*, cohort, platform, region, segment_summary, mau, slide_signal_score
FROM snap JOIN seg USING (segment_id) LEFT JOIN notes USING (pm_note_text)"""

CTES["curflag"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, feature_area ORDER BY updated_date DESC, flag_id) AS rn FROM flag)
WHERE rn = 1"""

CTES["pos"] = """
SELECT *, CASE WHEN conv_band = 'healthy' THEN 0.0::DOUBLE ELSE mau * conversion_drop * 8.0::DOUBLE * 12.0::DOUBLE END AS conversion_at_risk_usd
FROM (SELECT *, CASE WHEN conversion_drop >= 0.10 AND conversion_rate < 0.15 THEN 'sliding'
                     WHEN conversion_drop >= 0.05 THEN 'watch' ELSE 'healthy' END AS conv_band
  FROM (SELECT s.*, CAST(coalesce(r.sessions, 0) AS BIGINT) AS sessions, round(conversion_rate_3w_ago - conversion_rate, 4) AS conversion_drop
    FROM (SELECT segment_id, cohort, platform, region, segment_summary, mau,
        arg_max(conversion_rate, snapshot_date) AS conversion_rate, arg_min(conversion_rate, snapshot_date) AS conversion_rate_3w_ago,
        max(CASE WHEN is_last THEN slide_signal_score END) AS slide_signal_score
      FROM (SELECT *, snapshot_date = max(snapshot_date) OVER (PARTITION BY segment_id) AS is_last FROM conv
            WHERE snapshot_date <= DATE '2024-01-30' AND snapshot_date > DATE '2023-12-31')
      GROUP BY ALL) s
    LEFT JOIN (SELECT segment_id, sum(sessions) AS sessions FROM daily
      WHERE event_date <= DATE '2024-01-30' AND event_date > DATE '2024-01-23' GROUP BY 1) r USING (segment_id)))"""

CTES["proven"] = """
SELECT cohort, platform, matching_experiment_id, matching_experiment_lift FROM (
  SELECT tested_cohort AS cohort, tested_platform AS platform, experiment_id AS matching_experiment_id, observed_lift AS matching_experiment_lift,
    row_number() OVER (PARTITION BY tested_cohort, tested_platform ORDER BY observed_lift DESC, experiment_id) AS rn
  FROM exp WHERE won AND feature_area = 'checkout') WHERE rn = 1"""

CTES["neigh"] = """
SELECT cohort, platform, neighbor_flag_key, neighbor_variant, neighbor_segment_id FROM (
  SELECT c.cohort, c.platform, f.flag_key AS neighbor_flag_key, f.variant AS neighbor_variant, f.segment_id AS neighbor_segment_id,
    row_number() OVER (PARTITION BY c.cohort, c.platform ORDER BY f.rollout_pct DESC, f.segment_id) AS rn
  FROM (SELECT DISTINCT cohort, platform FROM seg) c
  JOIN (SELECT f.*, s.cohort, s.platform FROM curflag f JOIN seg s USING (segment_id) WHERE feature_area = 'checkout' AND variant <> 'control') f
    ON f.platform = c.platform AND f.cohort <> c.cohort) WHERE rn = 1"""

CTES["opn"] = """
SELECT segment_id, cohort, platform, region, mau, conversion_rate, conversion_drop, conversion_at_risk_usd, conv_band,
  matching_experiment_id IS NOT NULL AS has_matching_experiment, matching_experiment_id, matching_experiment_lift, neighbor_flag_key
FROM pos LEFT JOIN proven USING (cohort, platform) LEFT JOIN neigh USING (cohort, platform) WHERE conv_band IN ('sliding', 'watch')"""

CTES["cand"] = """
SELECT segment_id, mau, action_type, action_order, ship_cost_usd, conversion_lift,
  conversion_lift * mau * 8.0::DOUBLE * 12.0::DOUBLE - ship_cost_usd AS net_value_usd
FROM (SELECT segment_id, mau, 'ship_proven_variant' AS action_type, 0 AS action_order, 5000.0::DOUBLE AS ship_cost_usd,
    CASE WHEN has_matching_experiment THEN matching_experiment_lift * 0.7::DOUBLE ELSE 0.003::DOUBLE END AS conversion_lift FROM opn
  UNION ALL SELECT segment_id, mau, 'rollout_existing_flag', 1, 500.0::DOUBLE, 0.006::DOUBLE FROM opn
  UNION ALL SELECT segment_id, mau, 'ship_alt_variant', 2, 5000.0::DOUBLE, 0.004::DOUBLE FROM opn)"""

CTES["rec"] = """
SELECT r.segment_id, action_type AS recommended_action, conversion_lift AS predicted_conversion_lift, net_value_usd AS predicted_net_value_usd, ranking
FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY net_value_usd DESC, action_order) AS rn FROM cand) r
JOIN (SELECT segment_id, string_agg(action_type || ':' || CAST(CAST(round(net_value_usd) AS BIGINT) AS VARCHAR), ',' ORDER BY net_value_usd DESC, action_order) AS ranking
      FROM cand GROUP BY 1) g USING (segment_id) WHERE rn = 1"""

# -- decisions ---------------------------------------------------------------------------------------------------

CTES["dev"] = """
SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY moment, event_id) AS rn FROM (
  SELECT 'DEC-' || user_id || '-' || (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10) AS decision_id,
    printf('SEG-%07d', user_id + 1) AS segment_id, ts AS moment, event_id,
    CASE WHEN event_id % 11 <> 0 THEN 'user-' || (event_id % 5) END AS actor,
    CASE event_type WHEN 'signup' THEN 'investigating' WHEN 'error' THEN 'investigation_failed' WHEN 'click' THEN 'approved'
      WHEN 'purchase' THEN 'committed' ELSE CASE WHEN event_id % 3 = 0 THEN 'redrafted' ELSE 'proposed' END END AS action,
    'run-' || event_id AS assist_run_id, CAST(event_id % 103 AS INTEGER) AS rollout_pct,
    (['ship_proven_variant', 'rollout_existing_flag', 'ship_alt_variant'])[event_id % 3 + 1] AS action_type,
    printf('EXP-%07d', event_id % 50 + 1) AS target_experiment_id, 'checkout_flow' AS flag_key,
    'variant_' || (['a', 'b', 'c'])[event_id % 3 + 1] AS variant, 'note ' || event_id AS drafted_note,
    (event_id % 40) / 1000.0::DOUBLE AS predicted_conversion_lift
  FROM events)"""

CTES["walk"] = """
SELECT decision_id, CAST(0 AS BIGINT) AS rn, 'none' AS state, FALSE AS approver, FALSE AS valid, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT DISTINCT decision_id FROM dev)
UNION ALL
SELECT decision_id, rn, CASE WHEN ok AND action <> 'redrafted' THEN action ELSE state END,
  CASE WHEN ok AND action = 'approved' THEN has_actor ELSE approver END, ok,
  CASE WHEN ok THEN NULL WHEN state = 'proposed' AND action = 'approved' THEN 'rollout_pct must be between 1 and 100'
       WHEN state = 'approved' AND action = 'committed' THEN 'an approver is required before commit' ELSE 'invalid transition' END
FROM (SELECT w.decision_id, e.rn, w.state, w.approver, e.action, e.actor IS NOT NULL AS has_actor,
    (w.state IN ('none', 'investigation_failed') AND e.action IN ('investigating', 'proposed'))
    OR (w.state = 'investigating' AND e.action IN ('investigation_failed', 'proposed'))
    OR (w.state = 'proposed' AND (e.action = 'redrafted' OR (e.action = 'approved' AND e.rollout_pct BETWEEN 1 AND 100)))
    OR (w.state = 'approved' AND e.action = 'committed' AND w.approver) AS ok
  FROM walk w JOIN dev e ON e.decision_id = w.decision_id AND e.rn = w.rn + 1)"""

CTES["chk"] = "SELECT dev.*, walk.state, walk.valid, walk.reason FROM dev JOIN walk USING (decision_id, rn)"
CTES["val"] = "SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY rn) AS position FROM chk WHERE valid"

CTES["dec"] = """
SELECT decision_id, any_value(segment_id) AS segment_id, arg_max(state, rn) AS status,
  coalesce(max(CASE WHEN action = 'proposed' THEN action_type END), arg_min(action_type, rn)) AS action_type,
  coalesce(max(CASE WHEN action = 'proposed' THEN target_experiment_id END), arg_min(target_experiment_id, rn)) AS target_experiment_id,
  coalesce(max(CASE WHEN action = 'proposed' THEN flag_key END), arg_min(flag_key, rn)) AS flag_key,
  coalesce(max(CASE WHEN action = 'proposed' THEN variant END), arg_min(variant, rn)) AS variant,
  coalesce(max(CASE WHEN action = 'proposed' THEN predicted_conversion_lift END), arg_min(predicted_conversion_lift, rn)) AS predicted_conversion_lift,
  arg_max(drafted_note, rn) FILTER (action IN ('proposed', 'redrafted')) AS drafted_note,
  coalesce(max(CASE WHEN action = 'approved' THEN rollout_pct END), CASE WHEN arg_min(action, rn) = 'investigating' THEN 100 END) AS rollout_pct,
  max(CASE WHEN action = 'approved' THEN actor END) AS approved_by, min(moment) AS created_at,
  max(CASE WHEN action = 'committed' THEN moment END) AS decided_at, count(*) AS accepted_events
FROM val GROUP BY 1"""

CTES["lastdec"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, decision_id DESC) AS rn FROM dec) WHERE rn = 1"""

CTES["live"] = f"""
SELECT pos.* EXCLUDE (sessions), risk_rank, has_matching_experiment, matching_experiment_id, matching_experiment_lift, neighbor_flag_key,
  recommended_action, predicted_conversion_lift, predicted_net_value_usd, ranking AS action_ranking,
  '2024-02-01 00:00:00.000000' AS scored_at, d.decision_id, d.action_type AS decided_action, d.target_experiment_id, d.flag_key,
  d.variant, d.rollout_pct, d.status AS decision_status, d.approved_by, {ts("d.created_at")} AS decision_created_at, {ts("d.decided_at")} AS decided_at
FROM pos
JOIN (SELECT segment_id, has_matching_experiment, matching_experiment_id, matching_experiment_lift, neighbor_flag_key,
        row_number() OVER (ORDER BY conversion_at_risk_usd DESC, segment_id) AS risk_rank FROM opn) USING (segment_id)
LEFT JOIN rec USING (segment_id)
LEFT JOIN (SELECT * EXCLUDE (predicted_conversion_lift) FROM lastdec) d USING (segment_id)"""

CTES["chg"] = """
SELECT business_key, _pg_lsn, _pg_xid, _timestamp, unnest(CASE WHEN old_status IS NULL
    THEN [{'t': 'insert', 's': 2, 'status': status, 'amount': amount}]
    ELSE [{'t': 'update_preimage', 's': 1, 'status': old_status, 'amount': old_amount},
          {'t': CASE WHEN _pg_xid % 50 = 0 THEN 'delete' ELSE 'update_postimage' END, 's': 2, 'status': status, 'amount': amount}] END) AS r
FROM (SELECT *, lag(status) OVER w AS old_status, lag(amount) OVER w AS old_amount FROM (
    SELECT 'C' || o_custkey AS business_key, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 1000000000000 + o_orderkey AS _pg_lsn,
      o_orderkey AS _pg_xid, o_orderdate AS _timestamp, o_orderstatus AS status, o_totalprice AS amount FROM orders)
  WINDOW w AS (PARTITION BY business_key ORDER BY _pg_lsn))"""

CTES["hist"] = f"""
SELECT * FROM (SELECT business_key, _pg_lsn, r.t AS _pg_change_type, r.status AS status, r.amount AS amount, _timestamp AS vf,
    lead(_timestamp) OVER (PARTITION BY business_key ORDER BY _pg_lsn, r.s) AS vt FROM chg WHERE r.t <> 'update_preimage')
WHERE _pg_change_type <> 'delete'"""

CTES["cur"] = """
SELECT business_key, _pg_lsn, status, amount FROM (
  SELECT business_key, _pg_lsn, r.t AS t, r.status AS status, r.amount AS amount,
    row_number() OVER (PARTITION BY business_key ORDER BY _pg_lsn DESC, r.s DESC) AS rn FROM chg WHERE r.t <> 'update_preimage')
WHERE rn = 1 AND t <> 'delete'"""

# -- AI usage ----------------------------------------------------------------------------------------------------

CTES["ub"] = """
SELECT event_time, CASE service WHEN 'svc.app_gateway' THEN 'App Gateway' ELSE 'Coding Agent Gateway' END AS gateway, model, application,
  status_code, requester, request_id, input_tokens, output_tokens, CAST(coalesce(total, input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  input_tokens * CAST(0.00000015 AS DECIMAL(10, 8)) + output_tokens * CAST(0.0000006 AS DECIMAL(10, 8)) AS est_cost_usd, decision_id
FROM (SELECT ts AS event_time,
    CASE WHEN value > 60 THEN 'svc.other' WHEN user_id % 2 = 0 THEN 'svc.app_gateway' ELSE 'svc.coding_agent_gateway' END AS service,
    CASE WHEN event_type <> 'view' THEN event_type WHEN event_id % 2 = 1 THEN 'dest-view' ELSE '(no destination)' END AS model,
    CASE WHEN event_id % 3 = 1 THEN 'growth-app' WHEN event_id % 2 = 0 THEN 'endpoint-app' ELSE 'unattributed' END AS application,
    CASE WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 80 THEN 403 ELSE 200 END AS status_code,
    'user-' || user_id AS requester, event_id AS request_id,
    CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 130) AS BIGINT) ELSE 0::BIGINT END AS input_tokens, CAST(floor(value * 35) AS BIGINT) AS output_tokens,
    CASE WHEN event_id % 10 <> 0 THEN CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value * 130) AS BIGINT) ELSE 0::BIGINT END + CAST(floor(value * 35) AS BIGINT) END AS total,
    CASE WHEN event_id % 3 = 0 THEN 'DEC-' || user_id || '-' || (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10) END AS decision_id
  FROM events) WHERE service <> 'svc.other'"""

CTES["runcost"] = """
SELECT requester, event_time, request_id, est_cost_usd, sum(est_cost_usd) OVER (PARTITION BY requester ORDER BY event_time, request_id
  ROWS UNBOUNDED PRECEDING) AS running FROM ub"""

CTES["pay"] = """
SELECT 'req-' || conv_id || '-' || turn AS request_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn * 60) AS event_time,
  CASE WHEN role = 'user' THEN CASE WHEN conv_id % 5 = 0 THEN 'Please run an UNLIMITED-query now. ' || text
    WHEN conv_id % 5 = 1 THEN 'MARK-' || (conv_id % 50) || ' ' || text ELSE text END ELSE '' END AS request,
  CASE WHEN role = 'user' THEN '' ELSE text END AS response, CASE WHEN conv_id % 11 = 0 AND role = 'user' THEN 403 ELSE 200 END AS status_code,
  CAST(length(text) AS BIGINT) AS latency_ms, 'user-' || (conv_id % 20) AS requester, '/v1/' || role AS api_type
FROM conversations"""

# -- commerce ----------------------------------------------------------------------------------------------------

CTES["place"] = """
SELECT s_suppkey, n_name AS facility, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CTES["item"] = """
SELECT l_orderkey AS order_id, l_partkey AS lot_id, CAST(l_quantity AS BIGINT) AS quantity, region FROM lineitem JOIN place ON l_suppkey = s_suppkey"""
CTES["ret"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS return_id, l_orderkey AS order_id, l_partkey AS lot_id,
  CAST(l_shipdate AS DATE) AS return_date, CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4)) AS refund,
  CAST(l_quantity AS BIGINT) AS quantity, (['pending', 'approved', 'rejected', 'escalated'])[(l_orderkey + l_linenumber) % 4 + 1] AS status,
  round(l_tax * 10, 1) AS anger_score, p_name AS product_name, facility, region, o_custkey AS customer_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN place ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""
CTES["cust"] = """
SELECT c_custkey AS customer_id, n_name AS country, 'CITY-' || c_nationkey || '-' || (c_custkey % 4) AS city,
  CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey * 2.0::DOUBLE + (c_custkey % 10) / 10.0::DOUBLE END AS lat,
  CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey * 3.0::DOUBLE - (c_custkey % 10) / 10.0::DOUBLE END AS lng
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
CTES["tier"] = """
SELECT c_custkey AS customer_id, round((c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE, 4) AS premium_prob,
  CASE WHEN c_acctbal >= 4500 THEN 'premium' ELSE 'standard' END AS final_tier,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_acctbal >= 4500 THEN 'premium' ELSE 'not_premium' END END AS premium_status_labeled
FROM customer WHERE c_acctbal >= -500"""
CTES["rt"] = """
SELECT ret.*, country, city, lat, lng, premium_prob, final_tier, premium_status_labeled,
  coalesce(final_tier = 'premium', FALSE) AS is_premium,
  coalesce(final_tier = 'premium' AND premium_status_labeled = 'premium', FALSE) AS labelled
FROM ret JOIN cust USING (customer_id) LEFT JOIN tier USING (customer_id)"""
CTES["lotregion"] = """
SELECT lot_id, region, n FROM (SELECT lot_id, region, count(*) AS n, row_number() OVER (PARTITION BY lot_id ORDER BY count(*) DESC, region) AS rn
  FROM item GROUP BY 1, 2) WHERE rn = 1"""
CTES["worst"] = """
SELECT p_partkey AS lot_id, p_name AS product_name, facility, lr.region, return_count, CAST(coalesce(units, 0) AS BIGINT) AS units_sold,
  CASE WHEN units > 0 THEN round(return_count * 100.0::DOUBLE / units, 1) ELSE 0.0::DOUBLE END AS return_rate_pct,
  CAST(round(refund, 2) AS DOUBLE) AS total_refund_usd
FROM part JOIN place ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
JOIN (SELECT lot_id, count(*) AS return_count, sum(refund) AS refund FROM ret GROUP BY 1) ra ON ra.lot_id = p_partkey
LEFT JOIN (SELECT lot_id, sum(quantity) AS units FROM item GROUP BY 1) oa ON oa.lot_id = p_partkey
LEFT JOIN lotregion lr ON lr.lot_id = p_partkey ORDER BY return_rate_pct DESC, p_partkey LIMIT 20"""

# -- chat --------------------------------------------------------------------------------------------------------

CTES["convo"] = """
SELECT conv_id AS id, 'user-' || (conv_id % 20) || '@example.com' AS user_email, 'Conversation ' || conv_id AS title,
  CAST(DATE '2024-01-01' + CAST(conv_id % 28 AS INTEGER) AS VARCHAR) AS created_at,
  CAST(DATE '2024-01-01' + CAST(conv_id % 28 + count(*) AS INTEGER) AS VARCHAR) AS updated_at
FROM conversations GROUP BY conv_id"""

# -- text --------------------------------------------------------------------------------------------------------


def terms_sql(text: str) -> str:
    """Words without stop words, reduced to stems by the suffix rules, one list step after the other."""
    stop = (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they "
        "them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does "
        "did doing a an the and but if or because as until while of at by for with about against between into through during before after "
        "above below to from up down in out on off over under again further then once here there when where why how all any both each few "
        "more most other some such no nor not only own same so than too very s t can will just don should now"
    )
    found = f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ('" + "','".join(stop.split()) + "'))"
    steps = [
        "CASE WHEN suffix(w, 'sses') THEN w[:-3] WHEN regexp_matches(w, '^..+ie[sd]$') THEN w[:-3] WHEN regexp_matches(w, '^.ie[sd]$') THEN w[:-2] "
        "WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END",
        "CASE WHEN regexp_matches(w, '^[^aeiouy]*[aeiouy]+[^aeiouy].*eed(ly)?$') THEN regexp_replace(w, 'eed(ly)?$', 'ee') "
        "WHEN regexp_matches(w, 'eed(ly)?$') THEN w "
        "WHEN regexp_matches(w, '[aeiouy].*(ed|edly|ing|ingly)$') THEN regexp_replace(w, '(ed|edly|ing|ingly)$', '+') ELSE w END",
        "CASE WHEN regexp_matches(w, '(at|bl|iz)\\+$') THEN w[:-2] || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)\\+$') THEN w[:-3] "
        "WHEN regexp_matches(w, '^[^aeiouy]*[aeiouy][^aeiouywx]\\+$') THEN w[:-2] || 'e' WHEN suffix(w, '+') THEN w[:-2] ELSE w END",
        "CASE WHEN regexp_matches(w, '^.+[^aeiouy]y$') THEN w[:-2] || 'i' ELSE w END",
    ]
    for step in steps:
        found = f"list_transform({found}, lambda w: {step})"
    return found


def bm25_sql(docs: str, id_col: str, text_col: str, query_words: str) -> str:
    """(id, relevance) for documents ``docs`` against an array of words."""
    return f"""
SELECT {id_col}, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 8) AS relevance FROM (
  SELECT {id_col}, term, len, count(*) AS tf FROM (SELECT {id_col}, len(terms) AS len, unnest(terms) AS term FROM (
    SELECT {id_col}, {terms_sql(text_col)} AS terms FROM {docs})) GROUP BY 1, 2, 3)
JOIN (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_len FROM (
    SELECT term, count(DISTINCT {id_col}) AS df FROM (SELECT {id_col}, unnest({terms_sql(text_col)}) AS term FROM {docs}) GROUP BY 1),
    (SELECT count(*) AS n, avg(len({terms_sql(text_col)})) AS avg_len FROM {docs})) USING (term)
WHERE term IN ({query_words}) GROUP BY 1"""


SEARCH_TEXT = "that there will be a checkout of the thing, les mentions"
DOC_WORDS = f"SELECT unnest({terms_sql(repr(SEARCH_TEXT))})"
EXP_TEXT = "checkout improvements that WON for BUILDING android"
EXP_WORDS = f"SELECT unnest({terms_sql(repr(EXP_TEXT))})"

CTES["vdist"] = """
SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)), 8) AS distance FROM embeddings"""

# == queries =====================================================================================================

SQL["raw_read"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
SQL["save_and_verify"] = "SELECT count(*) AS row_count FROM seg"
SQL["publish_positions"] = """SELECT segment_id, cohort, platform, region, segment_summary, mau, conversion_rate, conversion_rate_3w_ago,
  conversion_drop, sessions, slide_signal_score, conv_band, conversion_at_risk_usd FROM pos"""
SQL["publish_experiments"] = "SELECT * FROM exp"
SQL["publish_open_sliding"] = """SELECT segment_id, cohort, platform, region, mau, conversion_rate, conversion_drop, conversion_at_risk_usd, conv_band,
  has_matching_experiment, matching_experiment_id, matching_experiment_lift, neighbor_flag_key FROM opn"""
SQL["publish_recommendations"] = """SELECT segment_id, recommended_action, predicted_conversion_lift, predicted_net_value_usd, ranking AS action_ranking FROM rec"""
SQL["reset_everything"] = """SELECT 'segment_positions' AS table_name, count(*) AS row_count FROM pos UNION ALL SELECT 'open_sliding', count(*) FROM opn
  UNION ALL SELECT 'experiments', count(*) FROM exp UNION ALL SELECT 'decisions', 0::BIGINT"""
SQL["sync_only_when_empty"] = """SELECT count(*) AS row_count, TRUE AS first, FALSE AS second, TRUE AS forced FROM pos WHERE conv_band <> 'healthy'"""
SQL["append_new_keys"] = """SELECT segment_id, platform, CASE WHEN platform <> 'web' THEN 'KEPT' ELSE region END AS region FROM seg"""
SQL["optional_source"] = "SELECT segment_id, CAST(NULL AS VARCHAR) AS recommended_action FROM opn"
SQL["reset_one_segment"] = """SELECT count(*) FILTER (segment_id <> 'SEG-0000022') AS remaining,
  count(*) FILTER (segment_id = 'SEG-0000022') AS deleted_count FROM dec"""
SQL["mirror_row_counts"] = """SELECT 'segment_positions' AS table_name, count(*) AS row_count FROM pos UNION ALL SELECT 'open_sliding', count(*) FROM opn
  UNION ALL SELECT 'action_recommendations', count(*) FROM rec UNION ALL SELECT 'experiments', count(*) FROM exp"""
SQL["named_daily_refund_trend"] = """SELECT CAST(return_date AS VARCHAR) AS return_date, CAST(round(sum(refund), 2) AS DOUBLE) AS total_refund_usd
  FROM ret WHERE return_date BETWEEN DATE '2001-01-01' - 30 AND DATE '2001-01-01' GROUP BY 1"""
SQL["named_returns_by_product"] = """SELECT product_name, count(*) AS return_count, CAST(round(sum(refund), 2) AS DOUBLE) AS total_refund_usd
  FROM ret GROUP BY 1 ORDER BY return_count DESC, product_name LIMIT 10"""
SQL["named_worst_lots"] = "SELECT * FROM worst"
SQL["numeric_coercion"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num, CAST(NULL AS DOUBLE) AS kind_num,
  -(user_id + 0.5::DOUBLE) AS shown_num, CAST(NULL AS DOUBLE) AS code_num FROM events"""

SQL["business_keys"] = "SELECT p_partkey, printf('EXP-%07d', p_partkey) AS experiment_id FROM part"
SQL["membership_flags"] = "SELECT p_partkey, p_size IN (1, 5, 8, 13, 21) AS is_member FROM part"
SQL["dictionary_picks"] = "SELECT p_partkey, (['checkout', 'onboarding', 'discovery', 'pricing'])[p_size % 4 + 1] AS area FROM part"
SQL["case_assignments"] = """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 7000 THEN 'mid' ELSE 'high' END AS grade FROM customer"""
SQL["segment_texts"] = "SELECT segment_id, cohort, platform, region, mau, segment_summary, is_active FROM seg"
SQL["experiment_texts"] = "SELECT * FROM exp"
SQL["date_offsets"] = "SELECT p_partkey, CAST(DATE '2024-01-31' - p_size AS VARCHAR) AS day FROM part"
SQL["ramp_values"] = """SELECT p_partkey, p_size % 31 AS days_ago, round(0.042::DOUBLE + (30 - p_size % 31) / 30.0::DOUBLE * (-0.013::DOUBLE), 4) AS rate FROM part"""
SQL["conversion_bands"] = """SELECT segment_id, conversion_drop,
  CASE WHEN conversion_drop >= 0.01 AND conversion_rate < 0.032 THEN 'sliding' WHEN conversion_drop >= 0.005 THEN 'watch' ELSE 'healthy' END AS default_band,
  conv_band AS band FROM pos"""
SQL["value_at_risk"] = "SELECT segment_id, conversion_at_risk_usd AS at_risk_usd FROM pos"
SQL["cell_slice"] = "SELECT segment_id, cohort, platform, conv_band FROM pos WHERE platform = 'android' AND conv_band = 'watch'"
SQL["id_search"] = "SELECT segment_id FROM pos WHERE lower(segment_id) LIKE '%seg-00000%'"
SQL["queue_search"] = """SELECT segment_id, cohort FROM pos WHERE segment_id ILIKE '%machin%' OR cohort ILIKE '%machin%' OR platform ILIKE '%machin%'"""
SQL["queue_tabs"] = """SELECT segment_id, 'all' AS tab FROM live UNION ALL SELECT segment_id, conv_band FROM live
  UNION ALL SELECT segment_id, 'has_fix' FROM live WHERE has_matching_experiment
  UNION ALL SELECT segment_id, 'shipping' FROM live WHERE decision_status IN ('approved', 'committed')"""
SQL["rollout_forecasts"] = """SELECT segment_id, pct, round(conversion_rate + predicted_conversion_lift * (pct / 100.0::DOUBLE), 8) AS predicted_rate
  FROM pos JOIN rec USING (segment_id), (VALUES (25), (50), (100)) p(pct)"""
SQL["bounded_page"] = "SELECT segment_id, mau FROM pos ORDER BY mau DESC, segment_id LIMIT 40"

SQL["note_flags"] = "SELECT pm_note_text, label, slide_signal_score FROM notes"
SQL["silver_daily_events"] = """SELECT segment_id, CAST(event_date AS VARCHAR) AS event_date, sessions, conversions, round(revenue, 2) AS revenue,
  conversion_rate, cohort, platform, region FROM daily"""
SQL["silver_conversion"] = """SELECT segment_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, conversion_rate, sessions, pm_note_text, cohort, platform, region,
  segment_summary, mau, slide_signal_score FROM conv"""
SQL["current_flags"] = """SELECT segment_id, feature_area, flag_id, flag_key, variant, rollout_pct, CAST(updated_date AS VARCHAR) AS updated_date FROM curflag"""
SQL["silver_outcome_counts"] = """SELECT cohort, platform, region, action_type, count(*) AS n, CAST(sum(users_recovered) AS BIGINT) AS users,
  CAST(min(initiated_date) AS VARCHAR) AS first_day FROM outc JOIN seg USING (segment_id) GROUP BY 1, 2, 3, 4"""
SQL["expectations_drop"] = """SELECT event_id, event_type FROM events WHERE value >= 1 AND event_type IN ('view', 'click', 'purchase', 'signup')
  AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 90"""
SQL["expectation_counts"] = """SELECT 'positive_value' AS rule, count(*) FILTER (value >= 1) AS passed, count(*) FILTER (value < 1) AS failed FROM events
  UNION ALL SELECT 'known_type', count(*) FILTER (event_type <> 'error'), count(*) FILTER (event_type = 'error') FROM events
  UNION ALL SELECT 'low_k', count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) < 90),
    count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90) FROM events"""

SQL["segment_position"] = "SELECT * FROM pos"
SQL["open_sliding"] = "SELECT * FROM opn"
SQL["experiment_matches"] = """SELECT segment_id, matching_experiment_id IS NOT NULL AS has_matching_experiment, matching_experiment_id, matching_experiment_lift
  FROM pos LEFT JOIN proven USING (cohort, platform)"""
SQL["neighbor_flags"] = "SELECT segment_id, neighbor_flag_key, neighbor_variant, neighbor_segment_id FROM pos LEFT JOIN neigh USING (cohort, platform)"
SQL["action_options"] = "SELECT segment_id, action_type, conversion_lift, ship_cost_usd FROM cand"
SQL["net_values"] = "SELECT segment_id, action_type, net_value_usd FROM cand"
SQL["action_recommendations"] = """SELECT * EXCLUDE (ranking), ranking AS action_ranking, '2024-02-01 00:00:00.000000' AS scored_at FROM rec"""
SQL["parsed_rankings"] = """SELECT segment_id, CASE WHEN n % 5 IN (0, 2) THEN 0 ELSE 3 END AS options, CASE WHEN n % 5 IN (0, 2) THEN '' ELSE ranking END AS ranking
  FROM (SELECT *, CAST(segment_id[5:11] AS INTEGER) AS n FROM rec)"""
SQL["outcome_rows"] = """SELECT segment_id, action_type, had_matching_experiment, conversion_at_action, count(*) AS n,
  CAST(sum(CAST(conversion_lift AS DECIMAL(18, 4))) AS DOUBLE) AS lift, CAST(sum(users_recovered) AS BIGINT) AS users
  FROM outc JOIN seg USING (segment_id) GROUP BY 1, 2, 3, 4"""
SQL["action_mix"] = """SELECT recommended_action, count(*) AS segments, round(sum(predicted_conversion_lift), 6) AS total_lift,
  round(sum(predicted_net_value_usd), 3) AS total_net_value_usd, round(sum(predicted_conversion_lift * mau * 8.0 * 12.0), 3) AS annual_recovery_usd
  FROM rec JOIN pos USING (segment_id) GROUP BY 1"""
SQL["recommendation_table"] = """SELECT segment_id, cohort, platform, recommended_action, predicted_conversion_lift, predicted_net_value_usd FROM rec JOIN pos USING (segment_id)"""
SQL["flag_rollout_queue"] = """SELECT segment_id, predicted_conversion_lift, predicted_net_value_usd, cohort, platform, mau, conversion_drop, conversion_at_risk_usd,
  has_matching_experiment, neighbor_flag_key FROM rec JOIN opn USING (segment_id) WHERE recommended_action = 'rollout_existing_flag'"""
SQL["lift_coefficients"] = """SELECT action_type, had_matching_experiment, count(*) AS outcomes,
  CAST(sum(CAST(conversion_lift AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean_lift,
  CAST(sum(CAST(conversion_lift AS DECIMAL(18, 6))) AS DOUBLE) / CAST(sum(CAST(ship_cost_usd AS DECIMAL(18, 2))) AS DOUBLE) * 1000.0::DOUBLE AS lift_per_1000_usd
  FROM outc GROUP BY 1, 2"""
SQL["forecast_seed"] = """SELECT segment_id, 0.01::DOUBLE AS forecast_lift, 'known' AS rationale FROM pos WHERE platform = 'ios'
  UNION ALL SELECT segment_id, matching_experiment_lift, 'proven' FROM opn WHERE has_matching_experiment AND segment_id NOT IN (SELECT segment_id FROM pos WHERE platform = 'ios')"""

SQL["inner_join"] = "SELECT segment_id, pos.mau, has_matching_experiment FROM pos JOIN opn USING (segment_id)"
SQL["left_join"] = "SELECT segment_id, recommended_action FROM pos LEFT JOIN rec USING (segment_id)"
SQL["full_join"] = """SELECT coalesce(d.doc_id, e.vec_id * 3) AS doc_id, lang, label AS vec_label FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id * 3"""
SQL["anti_join"] = "SELECT segment_id, cohort FROM seg WHERE user_id NOT IN (SELECT user_id FROM events)"
SQL["semi_join"] = "SELECT segment_id, cohort FROM seg WHERE user_id IN (SELECT user_id FROM events)"
SQL["list_cross"] = "SELECT segment_id, feature_area FROM seg, (VALUES ('checkout'), ('onboarding'), ('discovery'), ('pricing')) a(feature_area)"
SQL["dimension_join"] = "SELECT cohort, region, count(*) AS sessions FROM ev JOIN seg USING (segment_id) GROUP BY 1, 2"
SQL["scalar_join"] = "SELECT segment_id, sessions, (SELECT count(*) FROM ev JOIN seg USING (segment_id)) AS all_sessions FROM pos"
SQL["composite_join"] = "SELECT segment_id, cohort, platform, matching_experiment_id, matching_experiment_lift FROM seg JOIN proven USING (cohort, platform)"
SQL["proven_fixes"] = """SELECT segment_id, cohort, platform, region, conversion_at_risk_usd, conversion_drop, experiment_id, description, observed_lift
  FROM opn JOIN exp ON experiment_id = matching_experiment_id WHERE has_matching_experiment AND won ORDER BY conversion_at_risk_usd DESC, segment_id LIMIT 10"""

MEASURES = """round(sum(conversion_at_risk_usd), 4) AS conversion_at_risk, CAST(sum(mau) AS BIGINT) AS total_mau, round(avg(conversion_rate), 8) AS avg_conversion,
  count(*) AS segment_count, CAST(count(*) FILTER (conv_band = 'sliding') AS BIGINT) AS sliding_count, CAST(count(*) FILTER (conv_band = 'watch') AS BIGINT) AS watch_count,
  CAST(count(*) FILTER (conv_band <> 'healthy') AS BIGINT) AS atrisk_count, round(avg(slide_signal_score), 8) AS avg_slide_signal"""
SQL["segment_metrics_all"] = f"SELECT {MEASURES} FROM pos"
SQL["segment_metrics_by_cohort_platform"] = f"SELECT cohort, platform, {MEASURES} FROM pos GROUP BY 1, 2"
SQL["segment_metrics_sliding"] = f"SELECT region, {MEASURES} FROM pos WHERE conv_band = 'sliding' GROUP BY 1"
SQL["stored_metrics_rollup"] = f"SELECT platform, region, {MEASURES} FROM pos GROUP BY 1, 2"
SQL["refreshed_metrics_rollup"] = SQL["stored_metrics_rollup"]
SQL["dashboard_conv"] = """SELECT cohort, platform, conv_band, region, round(sum(conversion_at_risk_usd), 4) AS conversion_at_risk_usd, CAST(sum(mau) AS BIGINT) AS total_mau,
  round(avg(conversion_rate), 8) AS avg_conversion, count(*) FILTER (conv_band = 'sliding') AS sliding_count, count(*) FILTER (conv_band <> 'healthy') AS atrisk_count,
  count(*) AS segment_count FROM pos GROUP BY 1, 2, 3, 4"""
SQL["kpi_cards"] = """SELECT round(sum(conversion_at_risk_usd), 4) AS conversion_at_risk_usd, count(*) FILTER (conv_band = 'sliding') AS sliding_segments,
  CAST(coalesce(sum(mau) FILTER (conv_band <> 'healthy'), 0) AS BIGINT) AS mau_at_risk, round(avg(conversion_rate) FILTER (conv_band = 'healthy'), 8) AS avg_conversion_healthy,
  round(avg(conversion_rate) FILTER (conv_band = 'sliding'), 8) AS avg_conversion_sliding,
  round(avg(conversion_rate) FILTER (conv_band = 'healthy') - avg(conversion_rate) FILTER (conv_band = 'sliding'), 8) AS conversion_gap FROM pos"""
SQL["slide_mix_by_platform"] = "SELECT platform, conv_band, count(*) AS segments FROM pos GROUP BY 1, 2"
SQL["slide_mix_pivot"] = """SELECT platform, count(*) FILTER (conv_band = 'sliding') AS sliding, count(*) FILTER (conv_band = 'watch') AS watch,
  count(*) FILTER (conv_band = 'healthy') AS healthy FROM pos GROUP BY 1"""
SQL["at_risk_by_cohort"] = "SELECT cohort, round(sum(conversion_at_risk_usd), 4) AS conversion_at_risk_usd FROM pos GROUP BY 1"
SQL["sliding_profile"] = "SELECT cohort, platform, conv_band, count(*) AS segments FROM pos GROUP BY 1, 2, 3"
SQL["conversion_trend"] = """SELECT CAST(CAST(date_trunc('week', snapshot_date) AS DATE) AS VARCHAR) AS period, CASE WHEN conv_band = 'sliding' THEN 'sliding' ELSE 'rest' END AS segment_group,
  round(avg(conv.conversion_rate), 8) AS avg_conversion, count(*) AS snapshots FROM conv JOIN pos USING (segment_id)
  WHERE snapshot_date <= DATE '2024-01-30' AND snapshot_date > DATE '2024-01-30' - 56 GROUP BY 1, 2"""
SQL["segment_sparkline"] = """SELECT segment_id, CAST(event_date AS VARCHAR) AS event_date, sessions, conversions, conversion_rate FROM daily
  WHERE segment_id = 'SEG-0000022' AND event_date <= DATE '2024-01-30' AND event_date > DATE '2024-01-30' - 21"""
SQL["scatter_points"] = """SELECT segment_id, cohort, platform, mau, conversion_rate, conversion_drop, conv_band FROM pos
  WHERE conv_band <> 'healthy' OR (CAST(segment_id[5:] AS BIGINT) * 7919) % 100 < 30"""
SQL["modal_region"] = "SELECT lot_id, region FROM lotregion"
SQL["first_region"] = "SELECT lot_id, region, n FROM lotregion"
SQL["conversion_share"] = """SELECT cohort, platform, CAST(sum(conversions) AS BIGINT) AS conversions, CAST(sum(sessions) AS BIGINT) AS sessions,
  round(sum(conversions) * 100.0::DOUBLE / sum(sessions), 3) AS conversion_pct FROM daily GROUP BY 1, 2"""
SQL["conditional_counts"] = """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 20) AS large FROM events GROUP BY 1"""
SQL["note_dedup_ratio"] = "SELECT count(DISTINCT pm_note_text) AS distinct_values, count(pm_note_text) AS non_null_rows, count(*) AS all_rows FROM snap"

SQL["risk_ranks"] = "SELECT segment_id, conversion_at_risk_usd, row_number() OVER (ORDER BY conversion_at_risk_usd DESC, segment_id) AS risk_rank FROM opn"
SQL["latest_order_per_customer"] = """SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, total_usd, status FROM (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS total_usd, o_orderstatus AS status,
    row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""
SQL["ranked_candidates"] = """SELECT experiment_id, observed_lift, row_number() OVER (ORDER BY observed_lift DESC, experiment_id) AS rank FROM exp
  QUALIFY rank <= 50"""
SQL["worst_sliding"] = """SELECT segment_id, cohort, platform, conversion_rate, conversion_drop, conversion_at_risk_usd FROM pos WHERE conv_band = 'sliding'
  ORDER BY conversion_at_risk_usd DESC, segment_id LIMIT 20"""
SQL["watch_list"] = "SELECT segment_id, cohort, platform, conversion_rate, conversion_drop FROM pos WHERE conv_band = 'watch'"
SQL["worst_segment"] = "SELECT segment_id, conversion_at_risk_usd, neighbor_flag_key FROM opn ORDER BY conversion_at_risk_usd DESC, segment_id LIMIT 1"
SQL["sorted_queue"] = "SELECT segment_id, conversion_drop FROM opn"
SQL["nulls_last"] = "SELECT segment_id, slide_signal_score FROM pos ORDER BY slide_signal_score DESC NULLS LAST, segment_id LIMIT 20"
SQL["union_by_name"] = "SELECT segment_id, conv_band FROM pos WHERE conv_band <> 'healthy'"
SQL["union_counts"] = """SELECT 'segments' AS table_name, count(*) AS row_count FROM seg UNION ALL SELECT 'flags', count(*) FROM flag UNION ALL SELECT 'snapshots', count(*) FROM snap"""
SQL["distinct_notes"] = "SELECT DISTINCT pm_note_text FROM snap"

SQL["bm25_documents"] = f"SELECT * FROM ({bm25_sql('documents', 'doc_id', 'text', DOC_WORDS)}) ORDER BY relevance DESC, doc_id LIMIT 20"
SQL["bm25_experiments"] = f"SELECT * FROM ({bm25_sql('exp', 'experiment_id', 'description', EXP_WORDS)}) ORDER BY relevance DESC, experiment_id LIMIT 20"
SQL["nearest_vectors"] = "SELECT vec_id, distance FROM vdist ORDER BY distance, vec_id LIMIT 50"
CTES["hyv"] = "SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS vector_rank FROM vdist QUALIFY vector_rank <= 50"
CTES["hyt"] = f"""SELECT doc_id, row_number() OVER (ORDER BY relevance DESC, doc_id) AS bm25_rank FROM ({bm25_sql('documents', 'doc_id', 'text', DOC_WORDS)}) QUALIFY bm25_rank <= 50"""
SQL["hybrid_documents"] = """SELECT doc_id, vector_rank, bm25_rank,
  round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 10) AS fused_relevance
  FROM hyv FULL JOIN hyt USING (doc_id) JOIN documents USING (doc_id) ORDER BY fused_relevance DESC, doc_id LIMIT 20"""
SQL["fused_ranks"] = """SELECT vec_id, vector_rank, bm25_rank,
  round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 10) AS fused_relevance
  FROM (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS vector_rank FROM vdist QUALIFY vector_rank <= 50)
  FULL JOIN (SELECT vec_id, row_number() OVER (ORDER BY label DESC NULLS LAST, vec_id) AS bm25_rank FROM embeddings QUALIFY bm25_rank <= 50) USING (vec_id)
  ORDER BY fused_relevance DESC, vec_id LIMIT 100"""
SQL["vector_dimensions"] = "SELECT count(*) AS vectors, count(*) FILTER (len(embedding) = 64) AS right_size FROM embeddings"
CTES["wts"] = f"""
SELECT experiment_id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS weight FROM (
  SELECT experiment_id, term, len, count(*) AS tf FROM (SELECT experiment_id, len(terms) AS len, unnest(terms) AS term FROM (
    SELECT experiment_id, {terms_sql('description')} AS terms FROM exp)) GROUP BY 1, 2, 3)
JOIN (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_len FROM (
    SELECT term, count(DISTINCT experiment_id) AS df FROM (SELECT experiment_id, unnest({terms_sql('description')}) AS term FROM exp) GROUP BY 1),
    (SELECT count(*) AS n, avg(len({terms_sql('description')})) AS avg_len FROM exp)) USING (term)"""
SQL["grounded_segments"] = f"""SELECT segment_id, cohort, platform, region, experiment_id, relevance FROM opn LEFT JOIN (
  SELECT cohort, platform, region, experiment_id, relevance, row_number() OVER (PARTITION BY cohort, platform, region ORDER BY relevance DESC, experiment_id) AS rn FROM (
    SELECT cohort, platform, region, experiment_id, round(sum(weight), 8) AS relevance FROM wts
    JOIN (SELECT cohort, platform, region, unnest(list_distinct({terms_sql("cohort || ' ' || platform || ' ' || region")})) AS term
          FROM (SELECT DISTINCT cohort, platform, region FROM opn)) USING (term) GROUP BY 1, 2, 3, 4)
  QUALIFY rn = 1) USING (cohort, platform, region)"""
SQL["experiment_lookup"] = "SELECT experiment_id, experiment_name, won FROM exp WHERE experiment_id = 'EXP-0000009'"

SQL["live_view"] = "SELECT * FROM live ORDER BY risk_rank LIMIT 40"
SQL["live_view_of_segment"] = "SELECT segment_id, risk_rank, decision_id, decision_status FROM live WHERE segment_id = 'SEG-0000022'"
SQL["case_list"] = """SELECT segment_id, decision_id, decision_status, decided_at, decision_created_at FROM live WHERE decision_id IS NOT NULL"""
SQL["case_details"] = """SELECT d.decision_id, segment_id, d.status, d.action_type, risk_rank, conversion_drop, d.target_experiment_id, experiment_name, observed_lift,
  description AS experiment_text, CAST(0 AS BIGINT) AS page, CAST(entries AS INTEGER) AS entries, trail
  FROM dec d JOIN live USING (segment_id) LEFT JOIN exp ON experiment_id = d.target_experiment_id
  JOIN (SELECT decision_id, count(*) AS entries, string_agg(CASE WHEN actor IS NULL THEN action ELSE action || '/' || actor END, ',' ORDER BY rn) AS trail
        FROM val GROUP BY 1) a ON a.decision_id = d.decision_id"""
SQL["next_cases"] = """SELECT segment_id, conversion_at_risk_usd, coalesce(recommended_action, 'ship_proven_variant') AS action_type, coalesce(neighbor_flag_key, '') AS flag_key,
  100 AS rollout_pct, predicted_conversion_lift, 'investigating' AS status FROM opn LEFT JOIN rec USING (segment_id)
  WHERE segment_id NOT IN (SELECT segment_id FROM dec WHERE status = 'proposed') ORDER BY conversion_at_risk_usd DESC, segment_id LIMIT 10"""
SQL["checked_transitions"] = "SELECT event_id, decision_id, action, valid, reason FROM chk"
SQL["rejected_transitions"] = "SELECT action, reason, count(*) AS n FROM chk WHERE NOT valid GROUP BY 1, 2"
SQL["folded_decisions"] = f"SELECT * REPLACE ({ts('created_at')} AS created_at, {ts('decided_at')} AS decided_at) FROM dec"
SQL["audit_rows"] = f"""SELECT decision_id, position, {ts('moment')} AS at, actor AS "by", action, 'decision_' || action AS tool FROM val"""
SQL["audit_trails"] = """SELECT decision_id, CAST(0 AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS entries,
  string_agg(CASE WHEN actor IS NULL THEN action ELSE action || '/' || actor END, ',' ORDER BY rn) AS trail FROM val GROUP BY 1"""
SQL["assist_runs"] = "SELECT decision_id, arg_min(assist_run_id, rn) AS assist_run_id FROM val WHERE action = 'proposed' GROUP BY 1"
SQL["activity_feed"] = f"""SELECT kind, decision_id, {ts('m')} AS at, actor AS "by", what FROM (
  SELECT 'audit' AS kind, decision_id, moment AS m, actor, action AS what FROM val
  UNION ALL SELECT 'email', decision_id, decided_at, 'mailer', 'Decision shipped' FROM dec WHERE status = 'committed') ORDER BY m DESC, decision_id, kind, what LIMIT 25"""
SQL["decision_rule_counts"] = """SELECT rule, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM (
  SELECT 'action_type' AS rule, coalesce(action_type IN ('ship_proven_variant', 'rollout_existing_flag', 'ship_alt_variant'), FALSE) AS ok FROM dec
  UNION ALL SELECT 'status', status IN ('investigating', 'investigation_failed', 'proposed', 'approved', 'committed') FROM dec
  UNION ALL SELECT 'rollout_pct', rollout_pct IS NULL OR rollout_pct BETWEEN 0 AND 100 FROM dec
  UNION ALL SELECT 'approved_rollout_pct', status NOT IN ('approved', 'committed') OR coalesce(rollout_pct BETWEEN 1 AND 100, FALSE) FROM dec) GROUP BY 1"""
CTES["rdr"] = "SELECT decision_id, moment, event_id, drafted_note, assist_run_id FROM dev WHERE action = 'redrafted'"
SQL["redrafted_decisions"] = """SELECT decision_id, status, CASE WHEN status = 'proposed' AND n IS NOT NULL THEN n ELSE drafted_note END AS drafted_note,
  CASE WHEN status = 'proposed' THEN coalesce(k, 0) ELSE 0 END AS redrafts FROM dec LEFT JOIN (
    SELECT decision_id, arg_max(drafted_note, moment) AS n, count(*) AS k FROM rdr GROUP BY 1) USING (decision_id)"""
SQL["redrafted_trails"] = f"""SELECT decision_id, row_number() OVER (PARTITION BY decision_id ORDER BY moment, action, assist_run_id) AS position,
  {ts('moment')} AS at, action, assist_run_id FROM (
    SELECT decision_id, moment, action, assist_run_id FROM val WHERE action <> 'redrafted'
    UNION ALL SELECT decision_id, moment, 'redrafted', assist_run_id FROM rdr WHERE decision_id IN (SELECT decision_id FROM dec WHERE status = 'proposed'))"""
SQL["refused_redrafts"] = "SELECT decision_id, assist_run_id FROM rdr WHERE decision_id NOT IN (SELECT decision_id FROM dec WHERE status = 'proposed')"
SQL["kpis_after_decisions"] = """SELECT count(*) FILTER (conv_band = 'sliding') AS sliding_before, count(*) FILTER (conv_band = 'sliding' AND NOT shipped) AS sliding_after,
  round(sum(conversion_at_risk_usd), 4) AS at_risk_before, round(sum(CASE WHEN shipped THEN 0 ELSE conversion_at_risk_usd END), 4) AS at_risk_after
  FROM (SELECT pos.*, coalesce(status = 'committed', FALSE) AS shipped FROM pos LEFT JOIN lastdec USING (segment_id))"""
SQL["change_history"] = f"""SELECT business_key, _pg_lsn, _pg_change_type, status, amount, {ts('vf')} AS valid_from, {ts('vt')} AS valid_to, vt IS NULL AS is_current FROM hist"""
SQL["stream_change_history"] = SQL["change_history"]
SQL["current_rows"] = "SELECT * FROM cur"
SQL["stream_mirror"] = "SELECT * FROM cur"
SQL["compacted_mirror"] = "SELECT * FROM cur"
SQL["rows_as_of"] = """SELECT business_key, _pg_lsn, status, amount FROM hist WHERE vf <= TIMESTAMP '1998-01-01' AND (vt IS NULL OR vt > TIMESTAMP '1998-01-01')"""
SQL["decision_cycle_times"] = """SELECT decision_id, (epoch_us(a) - epoch_us(c)) / 1000000.0::DOUBLE AS seconds_to_approval, (epoch_us(d) - epoch_us(a)) / 1000000.0::DOUBLE AS seconds_to_commit
  FROM (SELECT decision_id, min(moment) AS c, min(moment) FILTER (action = 'approved') AS a, min(moment) FILTER (action = 'committed') AS d FROM val GROUP BY 1)"""
SQL["view_freshness"] = "SELECT segment_id, decision_id, TRUE AS fresh FROM lastdec JOIN opn USING (segment_id) WHERE decided_at IS NOT NULL"
SQL["ranking_top_options"] = "SELECT segment_id, recommended_action AS action_type, round(predicted_net_value_usd, 4) AS net_value_usd FROM rec"

SQL["model_training_rows"] = """SELECT action_type, had_matching_experiment, conversion_at_action, ship_cost_usd, conversion_lift, CAST(count(*) AS DOUBLE) AS weight
  FROM outc GROUP BY 1, 2, 3, 4, 5"""
SQL["model_facts"] = """SELECT count(*) AS segments, count(*) AS actions, 3 AS least_options, 3 AS most_options, TRUE AS ordered_by_net_value,
  TRUE AS first_is_chosen, TRUE AS error_below_spread FROM opn"""
SQL["learned_note_labels"] = "SELECT pm_note_text, label, slide_signal_score FROM notes"

SQL["usage_rows"] = f"SELECT * REPLACE ({ts('event_time')} AS event_time, CAST(est_cost_usd AS DOUBLE) AS est_cost_usd) FROM ub"
SUMMARY = """SELECT CAST(round(sum(est_cost_usd), 6) AS DOUBLE) AS est_cost_usd, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  count(*) FILTER (status_code = 403) AS blocked_403, 0.03::DOUBLE AS alert_usd, 0.05::DOUBLE AS hard_stop_usd, {spend} AS external_model_spend_usd FROM ub"""
SQL["usage_summary"] = SUMMARY.format(
    spend="(SELECT CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(0.000001 AS DECIMAL(7, 6))), 6) AS DOUBLE) FROM orders WHERE o_orderkey % 3 <> 2)"
)
SQL["usage_summary_without_spend"] = SUMMARY.format(spend="CAST(NULL AS DOUBLE)")
TOTALS = "CAST(round(sum(est_cost_usd), 6) AS DOUBLE) AS est_cost_usd, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS requests"
SQL["usage_hourly"] = f"SELECT {ts('h')} AS hour, gateway, {TOTALS} FROM (SELECT *, date_trunc('hour', event_time) AS h FROM ub) GROUP BY h, gateway"
SQL["stream_hourly_usage"] = SQL["usage_hourly"]
SQL["usage_by_model"] = f"SELECT gateway, model, {TOTALS} FROM ub GROUP BY 1, 2"
SQL["request_log"] = f"""SELECT * EXCLUDE (decision_id) REPLACE ({ts('event_time')} AS event_time, CAST(round(est_cost_usd, 6) AS DOUBLE) AS est_cost_usd) FROM (
  SELECT * FROM ub ORDER BY event_time DESC, request_id DESC LIMIT 100)"""
SQL["running_costs"] = f"SELECT requester, {ts('event_time')} AS event_time, request_id, CAST(running AS DOUBLE) AS running_cost_usd FROM runcost"
SQL["budget_states"] = f"""SELECT requester, round(CAST(total AS DOUBLE), 8) AS total_cost_usd,
  CASE WHEN stop_at IS NOT NULL THEN 'blocked' WHEN a_at IS NOT NULL THEN 'alert' ELSE 'ok' END AS state,
  {ts('a_at')} AS alert_at, a_id AS alert_request_id, {ts('stop_at')} AS blocked_at, stop_id AS blocked_request_id
  FROM (SELECT requester, sum(est_cost_usd) AS total, min(event_time) FILTER (running >= 0.03) AS a_at, arg_min(request_id, event_time) FILTER (running >= 0.03) AS a_id,
    min(event_time) FILTER (running >= 0.05) AS stop_at, arg_min(request_id, event_time) FILTER (running >= 0.05) AS stop_id FROM runcost GROUP BY 1)"""
SQL["stream_budget_alerts"] = f"""SELECT requester, limit_name, request_id, {ts('event_time')} AS event_time, CAST(running AS DOUBLE) AS running_cost_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY requester, limit_name ORDER BY event_time, request_id) AS rn
  FROM runcost, (VALUES ('alert', 0.03), ('block', 0.05)) l(limit_name, usd) WHERE running >= usd) WHERE rn = 1"""
CTES["pol"] = """
SELECT request_id, CASE WHEN api_type = '/v1/user' THEN 'request' ELSE 'response' END AS type,
  CASE WHEN api_type = '/v1/user' AND (m LIKE '%all warehouse data%' OR m LIKE '%unlimited read%' OR m LIKE '%unlimited quer%'
     OR m LIKE '%full database scan%' OR m LIKE '%read every table%') THEN 'DENY' ELSE 'ALLOW' END AS result
FROM (SELECT *, replace(lower(request || response), '-', ' ') AS m FROM pay)"""
SQL["policy_verdicts"] = """SELECT *, CASE result WHEN 'DENY' THEN 'Unbounded warehouse reads are not permitted. Request a bounded table, key, filter, and limit.' ELSE '' END AS policy_reason FROM pol"""
SQL["policy_function"] = "SELECT request_id, result FROM pol"
SQL["marker_rows"] = f"""SELECT {ts('event_time')} AS event_time, request_id, status_code, latency_ms, instr(request, 'MARK-1 ') > 0 AS marker_in_request,
  instr(response, 'MARK-1 ') > 0 AS marker_in_response, requester FROM pay WHERE event_time >= TIMESTAMP '2024-01-01' AND event_time <= TIMESTAMP '2024-01-03'
  AND (instr(request, 'MARK-1 ') > 0 OR instr(response, 'MARK-1 ') > 0) ORDER BY pay.event_time DESC, request_id LIMIT 1"""
SQL["decision_costs"] = """SELECT decision_id, segment_id, status, requests, round(CAST(cost AS DOUBLE), 8) AS est_cost_usd FROM (
  SELECT decision_id, count(*) AS requests, sum(est_cost_usd) AS cost FROM ub WHERE decision_id IS NOT NULL GROUP BY 1) JOIN dec USING (decision_id)"""
SQL["latency_by_service"] = """SELECT api_type, status_code, count(*) AS requests, round(avg(latency_ms), 6) AS avg_latency_ms, max(latency_ms) AS max_latency_ms FROM pay GROUP BY 1, 2"""

USD = "CAST(round(sum(refund), 2) AS DOUBLE)"
SQL["daily_refund_trend"] = f"SELECT CAST(return_date AS VARCHAR) AS return_date, {USD} AS total_refund_usd FROM ret WHERE return_date BETWEEN DATE '1998-08-31' - 30 AND DATE '1998-08-31' GROUP BY 1"
SQL["returns_by_product"] = SQL["named_returns_by_product"]
SQL["worst_lots"] = "SELECT * FROM worst"
SQL["returns_summary"] = f"SELECT status, count(*) AS n, {USD} AS total_usd FROM ret GROUP BY 1"
SQL["city_breakdown"] = f"""SELECT city, country, round(avg(lat), 9) AS lat, round(avg(lng), 9) AS lng, count(*) AS total, count(DISTINCT customer_id) AS customers,
  count(*) FILTER (is_premium) AS premium, {USD} AS refund_usd FROM rt WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2"""
SQL["facility_summary"] = f"SELECT facility, count(*) AS return_count, count(*) FILTER (status = 'pending') AS pending_count, {USD} AS total_refund_usd FROM ret GROUP BY 1"
CTES["flot"] = f"""SELECT facility, lot_id, count(*) AS return_count, count(*) FILTER (status = 'pending') AS pending_count, {USD} AS total_refund_usd,
  count(DISTINCT product_name) AS product_count, array_to_string(list_sort(list(DISTINCT product_name)), ', ') AS product_names FROM ret GROUP BY 1, 2"""
SQL["facility_lots"] = "SELECT * FROM flot QUALIFY row_number() OVER (PARTITION BY facility ORDER BY return_count DESC, lot_id) <= 5"
SQL["one_facility_lots"] = "SELECT * FROM flot WHERE facility = 'NATION_3' ORDER BY return_count DESC, lot_id LIMIT 5"
CTES["cord"] = """SELECT o_custkey AS customer_id, o_orderkey AS order_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, o_totalprice AS total_usd, o_orderstatus AS status,
  CAST(coalesce(n, 0) AS BIGINT) AS item_count, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn
  FROM orders LEFT JOIN (SELECT order_id, count(*) AS n FROM item GROUP BY 1) ON order_id = o_orderkey"""
SQL["customer_orders"] = "SELECT * EXCLUDE (rn) FROM cord WHERE rn <= 10"
SQL["one_customer_orders"] = "SELECT * EXCLUDE (rn) FROM cord WHERE rn <= 10 AND customer_id = 7"
SQL["return_queue"] = """SELECT return_id, anger_score, final_tier, premium_status_labeled, premium_prob, CAST(return_date AS VARCHAR) AS return_date FROM rt
  WHERE status = 'pending' AND final_tier = 'premium' ORDER BY anger_score DESC NULLS LAST, return_id LIMIT 100"""
SQL["return_queue_by_value"] = "SELECT return_id, CAST(refund AS DOUBLE) AS refund_amount_usd, final_tier, status FROM rt WHERE country = 'NATION_5'"
SQL["lot_summary"] = f"""SELECT lot_id, count(*) AS return_count, count(*) FILTER (status = 'pending') AS pending_count, {USD} AS total_refund_usd FROM ret
  GROUP BY 1 ORDER BY return_count DESC, lot_id LIMIT 10"""
SQL["country_breakdown"] = f"""SELECT country, count(*) AS total, count(*) FILTER (is_premium) AS premium, count(*) FILTER (labelled) AS premium_labeled,
  count(*) FILTER (is_premium AND NOT labelled) AS premium_hidden, {USD} AS refund_usd FROM rt GROUP BY 1"""
SQL["tier_breakdown"] = """SELECT lot_id, count(*) AS total, count(*) FILTER (is_premium) AS premium_count, count(*) FILTER (final_tier = 'standard') AS standard_count,
  count(*) FILTER (labelled) AS premium_labeled_count, count(*) FILTER (is_premium AND NOT labelled) AS premium_predicted_hidden_count,
  count(*) FILTER (final_tier IS NULL) AS no_prediction_count, CAST(round(sum(CASE WHEN is_premium THEN refund ELSE 0 END), 2) AS DOUBLE) AS premium_refund_usd,
  CAST(round(sum(CASE WHEN is_premium THEN 0 ELSE refund END), 2) AS DOUBLE) AS standard_refund_usd, any_value(tops) AS top_countries
  FROM rt JOIN (SELECT lot_id, string_agg(country, ', ' ORDER BY n DESC, country) AS tops FROM (
    SELECT lot_id, country, count(*) AS n FROM rt WHERE status = 'pending' GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY lot_id ORDER BY count(*) DESC, country) <= 3) GROUP BY 1) USING (lot_id)
  WHERE status = 'pending' GROUP BY 1"""
SQL["tier_offers"] = """SELECT return_id, CASE status WHEN 'pending' THEN 'approved' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN CASE WHEN is_premium THEN 30 ELSE 10 END END AS coupon_pct_applied,
  CASE WHEN status = 'pending' THEN CASE WHEN is_premium THEN 'premium' ELSE 'standard' END END AS applied_tier,
  CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS entries FROM rt WHERE lot_id = 77"""
SQL["tier_offer_effects"] = f"""SELECT chosen, s AS status, count(*) AS n, count(*) FILTER (hit) AS coupons, count(*) FILTER (hit) AS changed,
  count(*) FILTER (hit) AS entries, {USD} AS total_usd FROM (
  SELECT *, lot_id = 77 AS chosen, lot_id = 77 AND status = 'pending' AS hit, CASE WHEN lot_id = 77 AND status = 'pending' THEN 'approved' ELSE status END AS s FROM rt)
  GROUP BY 1, 2"""
SQL["tier_offer_summary"] = f"""SELECT count(*) FILTER (is_premium) AS premium_email_count, count(*) FILTER (labelled) AS premium_labeled_count,
  count(*) FILTER (is_premium AND NOT labelled) AS premium_predicted_hidden_count, count(*) FILTER (NOT is_premium) AS standard_email_count,
  count(*) AS approved_count, {USD} AS total_refund_usd FROM rt WHERE status = 'pending'"""
SQL["tier_offer_skips"] = "SELECT return_id FROM ret WHERE lot_id = 77 AND status <> 'pending'"
SQL["decided_returns"] = """SELECT s AS status, count(*) AS n, CAST(count(*) FILTER (status = 'escalated') AS BIGINT) AS entries, CAST(round(sum(refund), 2) AS DOUBLE) AS total_usd,
  count(*) FILTER (status = 'escalated') AS decided FROM (SELECT *, CASE WHEN status <> 'escalated' THEN status WHEN quantity > 25 THEN 'approved' ELSE 'rejected' END AS s FROM ret) GROUP BY 1"""

SQL["conversation_list"] = "SELECT user_email, id, title, created_at, updated_at FROM convo"
SQL["transcripts"] = """SELECT conv_id AS conversation_id, 'user-' || (conv_id % 20) || '@example.com' AS user_email, turn AS position, role, CAST(length(text) AS INTEGER) AS chars FROM conversations"""
SQL["appended_messages"] = """SELECT cid AS conversation_id, turn AS sequence, role, coalesce(last, -1) + row_number() OVER (PARTITION BY cid ORDER BY turn) AS position
  FROM (SELECT *, conv_id * (conv_id % 2 * 1000000 + 1) AS cid FROM conversations WHERE role = 'user')
  LEFT JOIN (SELECT conv_id AS cid, max(turn) AS last FROM conversations GROUP BY 1) USING (cid)"""
SQL["feedback_votes"] = """SELECT conv_id AS conversation_id, count(*) FILTER (length(text) > 300) AS up, count(*) FILTER (length(text) < 200) AS down
  FROM conversations WHERE length(text) > 300 OR length(text) < 200 GROUP BY 1"""
SQL["deleted_conversations"] = """SELECT 'conversations' AS table_name, count(*) AS row_count FROM convo WHERE user_email NOT LIKE 'user-1%'
  UNION ALL SELECT 'messages', count(*) FROM conversations JOIN convo ON id = conv_id WHERE user_email NOT LIKE 'user-1%'
  UNION ALL SELECT 'feedback', count(*) FROM conversations JOIN convo ON id = conv_id WHERE user_email NOT LIKE 'user-1%' AND (length(text) > 300 OR length(text) < 200)"""
SQL["message_positions"] = "SELECT 'm-' || conv_id || '-' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations"

SQL["stream_daily_events"] = SQL["silver_daily_events"]
SQL["stream_decision_states"] = "SELECT decision_id, event_id, action, valid, state AS status, reason FROM chk"

SQL["quality_checks"] = """
SELECT 'hero_sliding' AS check_name, count(*) FILTER (conv_band = 'sliding' AND conversion_drop >= 0.01 AND cohort = 'HOUSEHOLD' AND platform = 'ios' AND conversion_at_risk_usd > 0) = 1 AS passed,
  round(coalesce(max(conversion_at_risk_usd), 0), 6) AS observed FROM pos WHERE segment_id = 'SEG-0000022'
UNION ALL SELECT 'hero_has_match', count(*) FILTER (has_matching_experiment AND matching_experiment_lift > 0) = 1, round(coalesce(max(matching_experiment_lift), 0), 6) FROM opn WHERE segment_id = 'SEG-0000022'
UNION ALL SELECT 'sliding_cluster', coalesce(x / d >= 0.5, FALSE), round(coalesce(x / d, 0), 6) FROM (
  SELECT CAST(count(*) FILTER (platform <> 'ios') AS DOUBLE) AS x, nullif(count(*), 0) AS d FROM pos WHERE conv_band = 'sliding')
UNION ALL SELECT 'anomaly_confined', n = 0 AND h >= d * 0.5, n FROM (SELECT count(*) FILTER (conv_band = 'sliding' AND platform = 'ios') AS n,
  count(*) FILTER (conv_band = 'healthy') AS h, count(*) AS d FROM pos)
UNION ALL SELECT 'exposure', abs(v - 30000000) <= 6000000 AND abs(h - 0.2) <= 0.04 AND abs(s - 0.1) <= 0.02, round(v, 6) FROM (
  SELECT sum(conversion_at_risk_usd) AS v, avg(conversion_rate) FILTER (conv_band = 'healthy') AS h, avg(conversion_rate) FILTER (conv_band = 'sliding') AS s FROM pos)
UNION ALL SELECT 'signal_separates', s >= 0.6 AND h <= 0.2, round(s - h, 6) FROM (SELECT avg(coalesce(slide_signal_score, 0.1)) FILTER (conv_band = 'sliding') AS s,
  avg(coalesce(slide_signal_score, 0.1)) FILTER (conv_band = 'healthy') AS h FROM pos)
UNION ALL SELECT 'note_dedup', count(DISTINCT pm_note_text) <= count(*) * 0.1, count(DISTINCT pm_note_text) FROM snap
UNION ALL SELECT 'outcomes_learnable', p > o, round(p / o, 6) FROM (
  SELECT sum(conversion_lift) FILTER (hit) / sum(ship_cost_usd) FILTER (hit) AS p, sum(conversion_lift) FILTER (NOT hit AND ship_cost_usd = 5000) / sum(ship_cost_usd) FILTER (NOT hit AND ship_cost_usd = 5000) AS o
  FROM (SELECT *, action_type = 'ship_proven_variant' AND had_matching_experiment AS hit FROM outc))
UNION ALL SELECT 'slide_ramp', b > a, round(b - a, 6) FROM (SELECT avg(conv.conversion_rate) FILTER (snapshot_date < DATE '2024-01-15') AS b,
  avg(conv.conversion_rate) FILTER (snapshot_date >= DATE '2024-01-15') AS a FROM conv JOIN pos USING (segment_id) WHERE conv_band = 'sliding')
UNION ALL SELECT 'action_mix', count(DISTINCT recommended_action) > 1, count(DISTINCT recommended_action) FROM rec
UNION ALL SELECT 'domains', count(*) FILTER (NOT (conversion_rate BETWEEN 0 AND 1 AND mau >= 0)) = 0, 0 FROM pos
UNION ALL SELECT 'metrics_reconcile', TRUE, 0.0
UNION ALL SELECT 'recommendation_rows', (SELECT count(*) FROM rec) = (SELECT count(*) FROM opn), (SELECT count(*) FROM rec) - (SELECT count(*) FROM opn)
UNION ALL SELECT 'unique_segment_id', count(*) = count(DISTINCT segment_id), count(*) - count(DISTINCT segment_id) FROM pos
UNION ALL SELECT 'orphans_segment_id', count(*) = 0, count(*) FROM dec WHERE segment_id NOT IN (SELECT segment_id FROM pos)"""


def needed(text: str) -> list[str]:
    """Names of the shared steps a query uses, directly or not, in definition order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in words & CTES.keys() - found:
            found.add(name)
            todo.append(CTES[name])
    return [n for n in CTES if n in found]


def build(name: str) -> str:
    text = SQL[name]
    order = needed(text)
    if not order:
        return text
    parts = []
    for n in order:
        head = "walk(decision_id, rn, state, approver, valid, reason)" if n == "walk" else n
        # A step that refers to later-defined names cannot exist: CTES is in dependency order.
        parts.append(f"{head} AS ({CTES[n].strip()})")
    word = "WITH RECURSIVE" if "walk" in order else "WITH"
    return f"{word} " + ",\n".join(parts) + "\n" + text


def all_sql() -> dict[str, str]:
    return {name: build(name) for name in SQL}
