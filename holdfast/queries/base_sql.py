"""The logical tables in SQL, for the counterparts of the registered queries.

``raw`` customers, ``scored`` prepared and enriched customers, ``pred``, ``seg``
and ``rec`` result tables, ``facts`` their left join, ``jobs`` the scoring jobs;
``pred_d``, ``seg_d`` and ``rec_d`` are the tables that have drifted.
"""

BASE = """WITH usage AS (
  SELECT o_custkey AS k,
         count(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent,
         count(o_totalprice) FILTER (o_orderstatus = 'F') AS n_day,
         count(o_totalprice) FILTER (o_orderstatus = 'O') AS n_eve,
         count(o_totalprice) FILTER (o_orderstatus = 'P') AS n_night,
         count(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS n_intl,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') AS s_day,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') AS s_eve,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'P') AS s_night,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderpriority = '5-LOW') AS s_intl,
         max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey
), tenths AS (
  SELECT c_custkey AS k, n_name, c_mktsegment, last_order,
         coalesce(urgent, 0) AS urgent, coalesce(n_intl, 0) AS n_intl,
         CAST(floor(coalesce(s_day, 0) / (greatest(coalesce(n_day, 0), 1) * 15000)) AS BIGINT) AS day_t,
         CAST(floor(coalesce(s_eve, 0) / (greatest(coalesce(n_eve, 0), 1) * 12500)) AS BIGINT) AS eve_t,
         CAST(floor(coalesce(s_night, 0) / (greatest(coalesce(n_night, 0), 1) * 12500)) AS BIGINT) AS night_t,
         CAST(floor(coalesce(s_intl, 0) / (greatest(coalesce(n_intl, 0), 1) * 400000)) AS BIGINT) AS intl_t
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN usage ON usage.k = c_custkey
), priced AS (
  SELECT *, CAST(floor((day_t * 170 + 50) / 100) AS BIGINT) AS day_c,
         CAST(floor((eve_t * 85 + 50) / 100) AS BIGINT) AS eve_c,
         CAST(floor((night_t * 45 + 50) / 100) AS BIGINT) AS night_c,
         CAST(floor((intl_t * 270 + 50) / 100) AS BIGINT) AS intl_c
  FROM tenths
), ranked AS (
  SELECT *, least(9900, greatest(100, 300 + 1400 * least(urgent, 5)
           + CASE WHEN day_c >= 4000 THEN 2600 ELSE 0 END
           + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1500 ELSE 0 END
           + (k * 7919) % 1000)) AS score_bp,
         row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS total_count
  FROM priced
), raw AS (
  SELECT CAST(k + 1 AS BIGINT) AS id,
         'C' || CASE WHEN k + 1 < 100000 THEN lpad(CAST(k + 1 AS VARCHAR), 5, '0')
                     ELSE CAST(k + 1 AS VARCHAR) END AS customer_id,
         CASE WHEN rn <= total_count * 0.60 THEN 'train'
              WHEN rn <= total_count * 0.75 THEN 'validation'
              WHEN rn <= total_count * 0.90 THEN 'test' ELSE 'scoring_batch' END AS dataset_split,
         n_name AS state,
         CAST(1 + (k * 37) % 240 AS INTEGER) AS account_length,
         CAST(CASE k % 3 WHEN 0 THEN 408 WHEN 1 THEN 415 ELSE 510 END AS INTEGER) AS area_code,
         CASE WHEN c_mktsegment = 'MACHINERY'
              THEN CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'TRUE' ELSE '1' END
              ELSE CASE k % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'False' ELSE '0' END
         END AS international_plan,
         CASE WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END AS voice_mail_plan,
         CAST(CASE WHEN k % 4 = 0 THEN 1 + k % 50 ELSE 0 END AS INTEGER) AS number_vmail_messages,
         day_t / 10 AS total_day_minutes, CAST(60 + k % 80 AS INTEGER) AS total_day_calls,
         day_c / 100 AS total_day_charge,
         eve_t / 10 AS total_eve_minutes, CAST(60 + (k * 3) % 80 AS INTEGER) AS total_eve_calls,
         eve_c / 100 AS total_eve_charge,
         night_t / 10 AS total_night_minutes, CAST(60 + (k * 7) % 80 AS INTEGER) AS total_night_calls,
         night_c / 100 AS total_night_charge,
         intl_t / 10 AS total_intl_minutes, CAST(n_intl AS INTEGER) AS total_intl_calls,
         intl_c / 100 AS total_intl_charge,
         CAST(urgent AS INTEGER) AS customer_service_calls,
         CAST(CASE WHEN (k * 7907) % 10000 < score_bp THEN 1 ELSE 0 END AS INTEGER) AS churn,
         score_bp / 10000 AS churn_probability, last_order AS scoring_date
  FROM ranked
), prepared AS (
  SELECT raw.* REPLACE (
           CASE WHEN lower(international_plan) IN ('yes', 'true', '1') THEN 'yes' ELSE 'no' END
             AS international_plan,
           CASE WHEN lower(voice_mail_plan) IN ('yes', 'true', '1') THEN 'yes' ELSE 'no' END
             AS voice_mail_plan),
         total_day_charge + total_eve_charge + total_night_charge + total_intl_charge
           AS estimated_total_charge
  FROM raw
), scored AS (
  SELECT *,
         CASE WHEN churn_probability < 0.35 THEN 'Low' WHEN churn_probability < 0.7 THEN 'Medium'
              ELSE 'High' END AS risk_group,
         CASE WHEN customer_service_calls >= 3 THEN 'Customer service calls >= 3'
              WHEN total_day_charge >= 40 THEN 'High day charge'
              WHEN international_plan = 'yes' THEN 'International plan'
              WHEN voice_mail_plan = 'no' THEN 'No voice mail plan'
              ELSE 'Stable customer profile' END AS main_risk_factor
  FROM prepared
), segmented AS (
  SELECT *, CAST(CASE WHEN customer_service_calls >= 3 THEN 1
                 WHEN total_day_minutes >= 230 OR total_day_charge >= 40 OR estimated_total_charge >= 65 THEN 2
                 WHEN international_plan = 'yes' OR total_intl_minutes >= 10 OR total_intl_charge >= 3 THEN 3
                 ELSE 4 END AS INTEGER) AS rule_segment_id,
         CASE WHEN risk_group = 'Low' THEN 'No Action'
              ELSE CASE main_risk_factor
                WHEN 'Customer service calls >= 3' THEN 'Service Recovery Call'
                WHEN 'High day charge' THEN 'Tariff Optimization'
                WHEN 'International plan' THEN 'International Plan Review'
                WHEN 'No voice mail plan' THEN 'Voice Mail Offer'
                ELSE 'Retention Discount' END END AS rule_type,
         CASE WHEN risk_group = 'High' OR churn_probability * estimated_total_charge >= 50 THEN 'High'
              WHEN risk_group = 'Medium' OR churn_probability * estimated_total_charge >= 25 THEN 'Medium'
              ELSE 'Low' END AS base_priority
  FROM scored
), ruled AS (
  SELECT *, CASE rule_segment_id WHEN 1 THEN 'Service Issue Segment'
              WHEN 2 THEN 'Tariff Optimization Segment'
              WHEN 3 THEN 'International Usage Segment'
              ELSE 'Stable Customer Segment' END AS rule_segment_name,
         CASE rule_type
           WHEN 'No Action' THEN 'Customer has low churn probability; no retention action is required.'
           WHEN 'Service Recovery Call'
             THEN 'Customer has many service calls; contact the customer to resolve issues.'
           WHEN 'Tariff Optimization' THEN 'Customer has high day usage; offer a more suitable tariff plan.'
           WHEN 'International Plan Review'
             THEN 'Customer uses an international plan; review international tariff conditions.'
           WHEN 'Voice Mail Offer'
             THEN 'Customer has no voice mail plan; offer voice mail plan as a retention action.'
           ELSE 'Customer has elevated churn probability; offer a retention discount.' END AS rule_reason,
         CASE WHEN risk_group = 'Low' THEN 'Low' ELSE base_priority END AS rule_priority
  FROM segmented
), pred AS (
  SELECT customer_id, churn_probability, risk_group, main_risk_factor, estimated_total_charge, scoring_date
  FROM ruled
), seg AS (
  SELECT customer_id, rule_segment_id AS segment_id, rule_segment_name AS segment_name
  FROM ruled WHERE id % 41 <> 0
), rec AS (
  SELECT customer_id, rule_type AS recommendation_type, rule_reason AS recommendation_reason,
         rule_priority AS priority
  FROM ruled WHERE id % 37 <> 0
), facts AS (
  SELECT * FROM pred LEFT JOIN seg USING (customer_id) LEFT JOIN rec USING (customer_id)
), jobs AS (
  SELECT CAST(o_orderkey AS INTEGER) AS id, 'Churn prediction model' AS model_name,
         o_orderpriority AS model_version, 'Gradient Boosting' AS algorithm,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (o_orderkey % 10000) / 10000 END AS roc_auc,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (o_orderkey * 7 % 10000) / 10000 END AS f1_score,
         CASE WHEN o_orderpriority = '1-URGENT' THEN (o_orderkey * 13 % 10000) / 10000 END AS recall,
         CAST(CASE WHEN o_orderpriority <> '5-LOW' THEN 0.65 END AS DOUBLE) AS high_risk_threshold,
         CAST(CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 0.3 END AS DOUBLE) AS medium_risk_threshold,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
         o_orderdate AS scoring_date
  FROM orders
), pred_d AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(customer_id, 2) AS BIGINT) % 29 = 0 THEN 'High day charge'
                         ELSE main_risk_factor END AS main_risk_factor) FROM pred
), seg_d AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(customer_id, 2) AS BIGINT) % 31 = 0 THEN CAST(4 AS INTEGER)
                         ELSE segment_id END AS segment_id) FROM seg
), rec_d AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(customer_id, 2) AS BIGINT) % 23 <> 0 THEN priority END AS priority,
                    CASE WHEN CAST(substr(customer_id, 2) AS BIGINT) % 43 = 0 THEN 'No Action'
                         ELSE recommendation_type END AS recommendation_type) FROM rec
)"""
