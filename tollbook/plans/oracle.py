"""The expected result of every registered query as DuckDB SQL over the sample tables.

Written from the definition of each report, in DuckDB's own idioms, so that it shares no
code with the operators. Sums are taken as decimals and turned into doubles at the end.
"""

from __future__ import annotations

from tollbook.operators import kpis
from tollbook.schemas import SEED_OFFERS, SEED_OPERATION_TYPES

EVENTS_NOW = "TIMESTAMP '2024-01-30 23:30:00'"
LINEITEM_NOW = "TIMESTAMP '2001-07-01 00:00:00'"


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(row) for row in rows)


LOOKUPS = f"""
offer_slots AS (SELECT * FROM (VALUES {_values([(i, *o) for i, o in enumerate(SEED_OFFERS)])})
                AS t(slot, offer_id, offer_name)),
offers AS (SELECT offer_id, offer_name FROM offer_slots),
object_types AS (SELECT * FROM (VALUES (1, 'F', 'Free Resource'), (2, 'B', 'Main Balance'),
                 (3, 'C', 'Credit Balance'), (4, 'X', 'Unused'))
                 AS t(object_type_id, object_type_code, description)),
operation_types AS (SELECT id::SMALLINT AS operation_type_id, description
                    FROM (VALUES {_values(SEED_OPERATION_TYPES)}, (9, 'Unused'))
                    AS t(id, description)),
customers AS (SELECT c_custkey AS cust_num,
                     if(c_mktsegment IN ('BUILDING', 'MACHINERY'), 'A', 'S') AS cust_type
              FROM customer WHERE c_custkey % 50 <> 7)
"""

EVENTS_STAR = f"""
WITH {LOOKUPS},
numbered AS (
  SELECT event_id, ts, user_id, json_extract_string(props, '$.k')::INT AS k,
         coalesce(list_position(['click', 'view', 'purchase', 'signup'], event_type), 5) AS op,
         value::DECIMAL(15,2) AS v
  FROM events),
priced AS (
  SELECT *,
         CASE WHEN event_id % 97 = 0 THEN NULL WHEN op > 3 THEN 0
              WHEN event_id % 211 = 0 THEN -v ELSE v END::DECIMAL(15,2) AS ded,
         if(op > 3, v, 0)::DECIMAL(15,2) AS chg
  FROM numbered),
facts AS (
  SELECT event_id AS cdr_event_id, ts AS creation_time, user_id AS cust_num,
         user_id * 10 + k % 3 AS object_id,
         CASE WHEN k % 18 < 14 THEN s.offer_id WHEN k % 18 < 16 THEN NULL ELSE 9999999 END AS offer_id,
         op::SMALLINT AS operation_type_id, ded AS deduct_amount, chg AS charge_amount,
         (2 * v)::DECIMAL(15,2) AS current_amount_pre,
         (2 * v - ded + chg)::DECIMAL(15,2) AS current_amount_post,
         if(op > 3, ts + to_hours(k - 20), NULL) AS charge_expire_time,
         if(event_id % 3 <> 0, ts + to_hours(k * 5), NULL) AS current_amount_expire_time
  FROM priced LEFT JOIN offer_slots s ON s.slot = k % 18),
objects AS (
  SELECT object_id, cust_num, (object_id % 10 + 1)::INT AS object_type_id,
         max(current_amount_expire_time) AS expiry_date
  FROM facts GROUP BY ALL)
"""

LINEITEM_STAR = f"""
WITH {LOOKUPS},
slotted AS (
  SELECT *, CASE WHEN o_custkey % 4 = 0 AND l_partkey % 18 BETWEEN 7 AND 13
                 THEN l_partkey % 18 - 7 ELSE l_partkey % 18 END AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
facts AS (
  SELECT l_orderkey * 10 + l_linenumber AS cdr_event_id,
         o_orderdate + to_hours(l_linenumber) AS creation_time, o_custkey AS cust_num,
         o_orderkey AS object_id,
         CASE WHEN k < 14 THEN s.offer_id WHEN k < 16 THEN NULL ELSE 9999999 END AS offer_id,
         l_linenumber::SMALLINT AS operation_type_id,
         if(l_linenumber <= 3, l_extendedprice, 0)::DECIMAL(15,2) AS deduct_amount,
         if(l_linenumber > 3, l_extendedprice, 0)::DECIMAL(15,2) AS charge_amount,
         o_totalprice::DECIMAL(15,2) AS current_amount_pre,
         (o_totalprice - l_quantity)::DECIMAL(15,2) AS current_amount_post,
         if(l_linenumber > 3, l_shipdate, NULL) AS charge_expire_time,
         if(l_orderkey % 3 <> 0, o_orderdate + to_days(30), NULL) AS current_amount_expire_time
  FROM slotted LEFT JOIN offer_slots s ON s.slot = k),
objects AS (
  SELECT o_orderkey AS object_id, o_custkey AS cust_num,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS object_type_id,
         if(o_orderkey % 11 <> 0, o_orderdate + to_days((o_orderkey % 730)::INT), NULL) AS expiry_date
  FROM orders)
"""

USAGE = "operation_type_id BETWEEN 1 AND 3"
MONTH = "strftime(creation_time, '%Y-%m')"


def _any(name: str, *fragments: str) -> str:
    return f"regexp_matches({name}, '{'|'.join(fragments)}', 'i')"


def _segment(name: str, loan_label: str, other_label: str) -> str:
    return f"""CASE WHEN {_any(name, 'data', 'internet', 'mo')} THEN 'Data Users'
        WHEN {_any(name, 'voice', 'min', 'sms')} THEN 'Voice-centric users'
        WHEN {_any(name, 'loan')} THEN '{loan_label}' ELSE '{other_label}' END"""


def _mean(amount: str) -> str:
    return f"sum({amount})::DOUBLE / nullif(count({amount}), 0)"


def _dashboard(now: str) -> str:
    return f"""
SELECT *, coalesce(total_revenue / nullif((SELECT count(*) FROM customers), 0), 0.0)::DOUBLE AS arpu
FROM (SELECT coalesce(trunc(sum(deduct_amount)), 0)::BIGINT AS total_revenue,
             coalesce(trunc(sum(charge_amount)), 0)::BIGINT AS total_charges,
             coalesce(trunc(sum(deduct_amount)), 0)::BIGINT AS total_deducted,
             count(*) AS number_of_operations,
             count(DISTINCT cust_num) FILTER (creation_time >= {now} - INTERVAL 1 YEAR)
               AS active_customers
      FROM facts)"""


def _kpis(now: str) -> str:
    return f"""
SELECT *, coalesce(total_revenue / nullif((SELECT count(*) FROM customers), 0), 0.0) AS arpu
FROM (SELECT coalesce(sum(deduct_amount) FILTER ({USAGE}), 0)::DOUBLE AS total_revenue,
             coalesce(sum(charge_amount), 0)::DOUBLE AS total_charges,
             coalesce(sum(deduct_amount) FILTER ({USAGE}), 0)::DOUBLE AS total_deducted,
             count(*) AS number_of_operations,
             count(DISTINCT cust_num) FILTER (creation_time >= {now} - INTERVAL 1 YEAR)
               AS active_customers
      FROM facts)"""


def _overall(now: str) -> str:
    return f""",
leading_offer AS (SELECT offer_name, count(DISTINCT cust_num) AS n FROM facts
                  JOIN offers USING (offer_id) GROUP BY ALL ORDER BY n DESC, offer_name LIMIT 1),
leading_operation AS (SELECT description, count(*) AS n FROM facts
                      JOIN operation_types USING (operation_type_id)
                      GROUP BY ALL ORDER BY n DESC, description LIMIT 1),
overall AS (
SELECT (SELECT count(*) FROM customers) AS total_customers,
       count(*) AS total_cdr_events,
       coalesce(sum(deduct_amount) FILTER ({USAGE}), 0)::DOUBLE AS total_revenue,
       coalesce(sum(charge_amount), 0)::DOUBLE AS total_charges,
       count(DISTINCT cust_num) FILTER (creation_time >= {now} - INTERVAL 1 YEAR)
         AS active_customers_year,
       (SELECT count(*) FROM offers) AS total_offers,
       coalesce(sum(deduct_amount) FILTER ({USAGE}), 0)::DOUBLE
         / (SELECT count(*) FROM customers) AS avg_revenue_per_customer,
       count(*) / (SELECT count(*) FROM customers) AS avg_events_per_customer,
       count(DISTINCT offer_id) AS unique_active_offers,
       count(DISTINCT operation_type_id) AS unique_operation_types,
       (SELECT count(DISTINCT object_type_id) FROM objects SEMI JOIN object_types
        USING (object_type_id)) AS unique_object_types_used,
       coalesce((SELECT offer_name FROM leading_offer), 'N/A') AS most_popular_offer,
       coalesce((SELECT n FROM leading_offer), 0) AS most_popular_offer_subscribers,
       coalesce((SELECT description FROM leading_operation), 'N/A') AS most_popular_operation,
       coalesce((SELECT n FROM leading_operation), 0) AS most_popular_operation_events
FROM facts)"""


def _sentence(text: str, condition: str, *values: str) -> str:
    quoted = text.replace("'", "''")
    return f"if({condition}, printf('{quoted}', {', '.join(values)}), NULL)" if values else (
        f"if({condition}, '{quoted}', NULL)"
    )


def _conclusions() -> str:
    def count(name: str) -> str:
        return f"{name}::VARCHAR"

    def share(part: str, whole: str) -> str:
        return f"({part} / {whole} * 100)"

    sentences = [
        _sentence(kpis.CUSTOMERS_SERVED, "total_customers > 0", count("total_customers")),
        _sentence(
            kpis.CUSTOMERS_ACTIVE,
            "active_customers_year > 0",
            share("active_customers_year", "total_customers"),
            count("active_customers_year"),
        ),
        _sentence(kpis.CUSTOMERS_INACTIVE, "active_customers_year = 0"),
        _sentence(kpis.REVENUE_EACH, "avg_revenue_per_customer > 0", "avg_revenue_per_customer"),
        _sentence(kpis.EVENTS_EACH, "avg_events_per_customer > 0", "avg_events_per_customer"),
        _sentence(kpis.EVENTS_PROCESSED, "total_cdr_events > 0", count("total_cdr_events")),
        _sentence(kpis.REVENUE_TOTAL, "total_revenue > 0", "total_revenue"),
        _sentence(kpis.OFFERS_AVAILABLE, "total_offers > 0", count("total_offers")),
        _sentence(
            kpis.OFFERS_ACTIVE,
            "unique_active_offers > 0",
            count("unique_active_offers"),
            share("unique_active_offers", "total_offers"),
        ),
        _sentence(
            kpis.OFFER_LEADING,
            "most_popular_offer_subscribers > 0",
            "most_popular_offer",
            count("most_popular_offer_subscribers"),
        ),
        _sentence(
            kpis.OPERATION_LEADING,
            "most_popular_operation_events > 0",
            "most_popular_operation",
            count("most_popular_operation_events"),
        ),
        _sentence(
            kpis.OPERATIONS_USED, "unique_operation_types > 0", count("unique_operation_types")
        ),
        _sentence(
            kpis.OBJECT_TYPES_IN_USE,
            "unique_object_types_used > 0",
            count("unique_object_types_used"),
        ),
    ]
    return f"""{_overall(LINEITEM_NOW)},
told AS (SELECT list_filter([{', '.join(sentences)}], lambda s: s IS NOT NULL) AS said FROM overall)
SELECT unnest(range(1, len(said) + 1)) AS conclusion_no, unnest(said) AS conclusion FROM told"""


def _journey(now: str) -> str:
    return f""",
recent AS (SELECT f.*, offer_name,
                  date_diff('day', min(creation_time) OVER (PARTITION BY cust_num), creation_time) AS age
           FROM facts f JOIN offers USING (offer_id)
           WHERE creation_time >= {now} - INTERVAL 6 MONTH),
staged AS (SELECT cust_num,
                  CASE WHEN age <= 7 THEN 'New Customer (0-7 days)'
                       WHEN age <= 30 THEN 'Early Stage (8-30 days)'
                       WHEN age <= 90 THEN 'Growing (31-90 days)'
                       ELSE 'Mature (90+ days)' END AS journey_stage,
                  count(*) AS events, sum(deduct_amount) AS spent,
                  count(DISTINCT offer_name) AS tried, min(age) AS youngest
           FROM recent GROUP BY ALL)"""


def _recent(key: str) -> str:
    return f"""
SELECT f.{key}, cdr_event_id, creation_time, t.description AS operation_type, offer_name,
       deduct_amount::DOUBLE AS deduct_amount, charge_amount::DOUBLE AS charge_amount,
       current_amount_pre::DOUBLE AS current_amount_pre,
       current_amount_post::DOUBLE AS current_amount_post,
       row_number() OVER (PARTITION BY f.{key} ORDER BY creation_time DESC, cdr_event_id,
         t.description NULLS FIRST, offer_name NULLS FIRST, deduct_amount NULLS FIRST,
         charge_amount NULLS FIRST, current_amount_pre NULLS FIRST, current_amount_post NULLS FIRST)
         AS event_no
FROM facts f JOIN operation_types t USING (operation_type_id) LEFT JOIN offers USING (offer_id)
QUALIFY event_no <= 100"""


def _trend(now: str) -> str:
    return f""",
trend AS (SELECT {MONTH} AS month, offer_name, count(DISTINCT cust_num) AS unique_subscribers,
                 count(*) AS total_subscriptions, sum(deduct_amount)::DOUBLE AS monthly_revenue
          FROM facts JOIN offers USING (offer_id)
          WHERE creation_time >= {now} - INTERVAL 12 MONTH GROUP BY ALL)"""


def _baskets(now: str) -> str:
    return f""",
baskets AS (SELECT cust_num, count(DISTINCT offer_id) AS unique_offers_used,
                   string_agg(DISTINCT offer_name, ', ' ORDER BY offer_name) AS offers_used,
                   sum(deduct_amount) AS spent, count(*) AS total_events
            FROM facts JOIN offers USING (offer_id)
            WHERE creation_time >= {now} - INTERVAL 6 MONTH GROUP BY cust_num)"""


BORROWERS = f""",
borrowers AS (
  SELECT cust_num, cust_type,
         count(*) FILTER ({_any('offer_name', 'loan')}) AS loans,
         sum(if({_any('offer_name', 'loan')}, charge_amount, 0)) AS lent,
         sum(if({_any('offer_name', 'loan')}, 0, deduct_amount)) AS repaid
  FROM facts JOIN offers USING (offer_id) JOIN customers USING (cust_num)
  GROUP BY ALL HAVING loans > 0)"""


def _flow(now: str) -> str:
    return f"""
SELECT {MONTH} AS month, sum(coalesce(charge_amount, 0))::DOUBLE AS total_charged,
       sum(coalesce(deduct_amount, 0))::DOUBLE AS total_deducted,
       (sum(coalesce(charge_amount, 0)) - sum(coalesce(deduct_amount, 0)))::DOUBLE
         AS net_balance_change,
       {_mean('current_amount_post')} AS avg_final_balance,
       count(DISTINCT cust_num) AS active_customers
FROM facts WHERE creation_time >= {now} - INTERVAL 12 MONTH GROUP BY ALL"""


def _expiring(now: str, grain: str) -> str:
    return f"""
SELECT expiry_date::DATE AS expiry_date, description AS object_type,
       count(*) AS expiring_objects, count(DISTINCT cust_num) AS affected_customers
FROM objects JOIN object_types USING (object_type_id)
WHERE objects.expiry_date <= {now} + INTERVAL 1 YEAR GROUP BY {grain}, description"""


OFFER_CHECK = """
SELECT 'Offer ID Consistency' AS check_type, count(*) AS total_records,
       count(*) FILTER (f.offer_id IS NOT NULL AND o.offer_id IS NULL)
         AS inconsistent_records_no_match,
       count(*) FILTER (f.offer_id <> o.offer_id) AS inconsistent_records_mismatch,
       count(*) FILTER (f.offer_id IS NOT NULL AND o.offer_id IS NULL) / count(*) * 100
         AS inconsistency_rate
FROM facts f LEFT JOIN offers o USING (offer_id)"""

AMOUNT_CHECK = f"""
SELECT 'Amount Anomalies' AS check_type, count(*) AS total_records,
       count(*) FILTER (deduct_amount < 0) AS negative_deductions,
       count(*) FILTER (charge_amount < 0) AS negative_charges,
       count(*) FILTER (deduct_amount::DOUBLE > 10 * (SELECT {_mean('deduct_amount')} FROM facts))
         AS high_deductions,
       {_mean('deduct_amount')} AS avg_deduct,
       round(stddev_pop(deduct_amount::DOUBLE), 6) AS stddev_deduct
FROM facts"""


def _time_check(now: str) -> str:
    return f"""
SELECT 'Timestamp Issues' AS check_type, count(*) AS total_records,
       count(*) FILTER (creation_time > {now}) AS future_timestamps,
       count(*) FILTER (year(creation_time) < 2020) AS very_old_timestamps,
       count(*) FILTER (charge_expire_time < creation_time) AS invalid_expiry_times
FROM facts"""


CUSTOMER_CHECK = """
SELECT 'Customer Consistency' AS check_type, count(*) AS customers_in_events,
       count(c.cust_num) AS customers_in_master,
       count(*) - count(c.cust_num) AS orphaned_customers
FROM (SELECT DISTINCT cust_num FROM facts) f LEFT JOIN customers c USING (cust_num)"""

QUALITY_COUNTS = (
    "total_records",
    "inconsistent_records_no_match",
    "inconsistent_records_mismatch",
    "negative_deductions",
    "negative_charges",
    "high_deductions",
    "future_timestamps",
    "very_old_timestamps",
    "invalid_expiry_times",
    "customers_in_events",
    "customers_in_master",
    "orphaned_customers",
    "inconsistency_rate",
)


def _quality(now: str) -> str:
    checks = [OFFER_CHECK, AMOUNT_CHECK, _time_check(now), CUSTOMER_CHECK]
    union = " UNION ALL BY NAME ".join(f"({check})" for check in checks)
    filled = ", ".join(f"coalesce({name}, 0) AS {name}" for name in QUALITY_COUNTS)
    return f"SELECT check_type, {filled}, avg_deduct, stddev_deduct FROM ({union})"


def _activity(now: str) -> str:
    return f""",
activity AS (
  SELECT cust_num, cust_type, count(*) AS total_transactions, sum(deduct_amount) AS spent,
         max(creation_time) AS last_activity,
         date_diff('day', max(creation_time), {now}) AS days_since_last_activity,
         {_mean('deduct_amount')} AS avg_transaction_amount,
         count(DISTINCT creation_time::DATE) AS active_days,
         CASE WHEN days_since_last_activity > 30 THEN 'High Risk'
              WHEN days_since_last_activity > 14 THEN 'Medium Risk'
              WHEN total_transactions < 5 THEN 'Low Engagement' ELSE 'Active' END
           AS churn_risk_level,
         (days_since_last_activity > 30 OR total_transactions < 3)::INT AS churn_flag
  FROM facts JOIN customers USING (cust_num) GROUP BY cust_num, cust_type)"""


ON_EVENTS = {
    "dashboard_kpis": _dashboard(EVENTS_NOW),
    "kpi_summary_events": _kpis(EVENTS_NOW),
    "overall_stats_events": f"{_overall(EVENTS_NOW)} SELECT * FROM overall",
    "sample_count": "SELECT count(*) AS n FROM facts",
    "sample_time_range": "SELECT min(creation_time) AS min_t, max(creation_time) AS max_t FROM facts",
    "balance_flow_events": _flow(EVENTS_NOW),
    "customer_behavior_by_type": f"""
SELECT cust_type, count(DISTINCT cust_num) AS active_customers,
       coalesce({_mean('deduct_amount')}, 0) AS avg_deduct_amount,
       coalesce({_mean('charge_amount')}, 0) AS avg_charge_amount,
       coalesce(sum(deduct_amount), 0)::DOUBLE AS total_revenue,
       count(*) AS total_events, count(*) / count(DISTINCT cust_num) AS avg_events_per_customer,
       coalesce({_mean('current_amount_post')}, 0) AS avg_balance_after_transaction
FROM facts JOIN customers USING (cust_num) GROUP BY ALL""",
    "customer_lifecycle": f"""
SELECT cust_num, cust_type,
       {_mean("date_sub('hour', creation_time, charge_expire_time)")} AS avg_charge_lifetime_hours,
       {_mean("date_sub('hour', creation_time, current_amount_expire_time)")}
         AS avg_current_lifetime_hours,
       {_mean('charge_amount')} AS avg_charge_amount,
       {_mean('current_amount_post')} AS avg_final_balance, count(*) AS transaction_count
FROM facts JOIN customers USING (cust_num)
WHERE charge_expire_time IS NOT NULL AND current_amount_expire_time IS NOT NULL
  AND charge_amount > 0
GROUP BY cust_num, cust_type HAVING count(*) >= 5""",
    "customer_recent_events": _recent("cust_num"),
    "customer_profile": f"""
, items AS (
  SELECT cust_num, 'customer_info' AS section FROM customers
  UNION ALL BY NAME
  SELECT cust_num, 'objects' AS section, object_id, description AS object_type_description,
         expiry_date
  FROM objects JOIN object_types USING (object_type_id)
  UNION ALL BY NAME
  SELECT * EXCLUDE (event_no), 'cdr_events' AS section FROM ({_recent('cust_num')}))
SELECT items.*, cust_type FROM items JOIN customers USING (cust_num)""",
    "data_bundles": f"""
SELECT o.offer_id, o.offer_name, count(DISTINCT cust_num) AS subscriber_count,
       coalesce({_mean('deduct_amount')}, 0) AS avg_usage,
       coalesce({_mean("date_sub('hour', creation_time, charge_expire_time)")}, 0)
         AS avg_duration_hours
FROM offers o LEFT JOIN facts USING (offer_id)
WHERE {_any('o.offer_name', 'data', 'mo', 'internet')} GROUP BY ALL""",
    "operations_breakdown": f"""
SELECT t.operation_type_id, t.description, count(cdr_event_id) AS event_count,
       count(DISTINCT cust_num) AS customer_count,
       coalesce({_mean('deduct_amount')}, 0) AS avg_deduct_amount,
       coalesce(sum(deduct_amount), 0)::DOUBLE AS total_deduct_amount
FROM operation_types t LEFT JOIN facts USING (operation_type_id) GROUP BY ALL""",
    "daily_series": f"""
SELECT creation_time::DATE AS event_date, count(*) AS event_count,
       coalesce(sum(deduct_amount), 0)::DOUBLE AS total_deduct_amount,
       count(DISTINCT cust_num) AS active_customers
FROM facts WHERE creation_time >= {EVENTS_NOW} - INTERVAL 5 YEAR GROUP BY ALL""",
    "usage_patterns": f"""
SELECT hour(creation_time) AS hour_of_day, dayname(creation_time) AS day_of_week,
       dayofweek(creation_time) + 1 AS day_num, count(*) AS event_count,
       sum(deduct_amount)::DOUBLE AS total_revenue,
       count(DISTINCT cust_num) AS active_customers,
       {_mean('deduct_amount')} AS avg_transaction_amount
FROM facts WHERE creation_time >= {EVENTS_NOW} - INTERVAL 3 MONTH GROUP BY ALL""",
    "usage_heatmap": "SELECT hour(creation_time) AS hour_of_day, "
    + ", ".join(
        f"count(*) FILTER (dayofweek(creation_time) = {number}) AS {day}"
        for number, day in enumerate(
            ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
        )
    )
    + f" FROM facts WHERE creation_time >= {EVENTS_NOW} - INTERVAL 3 MONTH GROUP BY ALL",
    "expiry_forecast_daily": _expiring(EVENTS_NOW, "objects.expiry_date::DATE"),
    "expiry_impact": f"""
, spoilt AS (
  SELECT cust_num,
         coalesce(sum(charge_amount) FILTER (charge_expire_time < {EVENTS_NOW}
           AND charge_amount > 0), 0) AS charged_gone,
         coalesce(sum(current_amount_post) FILTER (current_amount_expire_time < {EVENTS_NOW}
           AND current_amount_post > 0), 0) AS current_gone,
         sum(charge_amount) AS charged
  FROM facts WHERE coalesce(charge_expire_time, current_amount_expire_time) IS NOT NULL
  GROUP BY cust_num)
SELECT if(charged_gone > 0 OR current_gone > 0, 'Has Expired Balances', 'No Expired Balances')
         AS expiry_status,
       count(*) AS customer_count, {_mean('charged_gone')} AS avg_expired_charged,
       {_mean('current_gone')} AS avg_expired_current,
       sum(charged_gone + current_gone)::DOUBLE AS total_expired_value,
       {_mean('charged')} AS avg_total_charged,
       round(avg(charged_gone::DOUBLE / nullif(charged, 0)::DOUBLE), 6) AS expiry_rate
FROM spoilt GROUP BY ALL""",
    "network_capacity": f"""
, hourly AS (
  SELECT creation_time::DATE AS day, hour(creation_time) AS usage_hour, count(*) AS events,
         count(DISTINCT cust_num) AS users,
         count(*) FILTER ({_any('offer_name', 'data', 'internet')}) AS data_events,
         count(*) FILTER ({_any('offer_name', 'voice', 'min')}) AS voice_events
  FROM facts LEFT JOIN offers USING (offer_id)
  WHERE creation_time >= {EVENTS_NOW} - INTERVAL 7 DAY GROUP BY ALL),
per_hour AS (
  SELECT usage_hour, {_mean('events')} AS avg_events_per_hour, {_mean('users')} AS avg_users_per_hour,
         {_mean('data_events')} AS avg_data_events, {_mean('voice_events')} AS avg_voice_events,
         max(events) AS peak_events, min(events) AS min_events
  FROM hourly GROUP BY usage_hour)
SELECT *, CASE WHEN avg_events_per_hour > 1.2 * avg(avg_events_per_hour) OVER () THEN 'Peak Hours'
               WHEN avg_events_per_hour < 0.8 * avg(avg_events_per_hour) OVER () THEN 'Low Usage'
               ELSE 'Normal Usage' END AS capacity_status
FROM per_hour""",
    "dq_amount_anomalies": AMOUNT_CHECK,
    "dq_timestamp_issues": _time_check(EVENTS_NOW),
    "activity_snapshot": f"""
, spans AS (SELECT * FROM (VALUES
  ('current_hour', {EVENTS_NOW} - INTERVAL 1 HOUR, 'infinity'::TIMESTAMP),
  ('today', date_trunc('day', {EVENTS_NOW}), date_trunc('day', {EVENTS_NOW}) + INTERVAL 1 DAY),
  ('yesterday', date_trunc('day', {EVENTS_NOW}) - INTERVAL 1 DAY, date_trunc('day', {EVENTS_NOW})))
  AS t(metric_type, since, until))
SELECT metric_type, count(cdr_event_id) AS event_count, count(DISTINCT cust_num) AS active_users,
       sum(deduct_amount)::DOUBLE AS total_revenue,
       sum(deduct_amount)::DOUBLE / nullif(count(cdr_event_id), 0) AS avg_transaction_value
FROM spans LEFT JOIN facts ON creation_time >= since AND creation_time < until GROUP BY ALL""",
    "system_health": f"""
SELECT 'data_freshness' AS health_metric, max(creation_time) AS latest_record,
       date_sub('minute', max(creation_time), {EVENTS_NOW}) AS minutes_since_last_record,
       count(*) AS total_records, count(DISTINCT cust_num) AS total_customers FROM facts
UNION ALL
SELECT 'recent_activity', {EVENTS_NOW}, 0, count(*), count(DISTINCT cust_num) FROM facts
WHERE creation_time >= {EVENTS_NOW} - INTERVAL 1 HOUR""",
    "health_status": f"""
SELECT if(date_sub('minute', max(creation_time), {EVENTS_NOW}) > 60,
          'Warning - Data not fresh (last record over 60 mins ago)', 'Healthy') AS health_status
FROM facts""",
    "stream_freshness": f"""
SELECT max(creation_time) AS latest_record,
       date_sub('minute', max(creation_time), {EVENTS_NOW}) AS minutes_since_last_record,
       count(*) AS total_records,
       if(date_sub('minute', max(creation_time), {EVENTS_NOW}) > 60,
          'Warning - Data not fresh (last record over 60 mins ago)', 'Healthy') AS health_status
FROM facts""",
}


def _windows(unit: str) -> str:
    """Windows that end no later than the newest fact less the one-hour delay."""
    return f"""{_all_windows(unit)}
HAVING window_end <= (SELECT max(creation_time) FROM facts) - INTERVAL 1 HOUR"""


def _all_windows(unit: str) -> str:
    return f"""
SELECT date_trunc('{unit}', creation_time) AS window_start,
       date_trunc('{unit}', creation_time) + INTERVAL 1 {unit} AS window_end,
       count(*) AS event_count, count(DISTINCT cust_num) AS active_users,
       sum(coalesce(deduct_amount, 0))::DOUBLE AS total_revenue,
       sum(coalesce(deduct_amount, 0))::DOUBLE / count(*) AS avg_transaction_value
FROM facts GROUP BY window_start, window_end"""


ON_EVENTS["table_append"] = """
SELECT cdr_event_id, cdr_event_id::VARCHAR AS cdr_id, creation_time, cust_num, object_id, offer_id,
       operation_type_id, deduct_amount::DOUBLE AS deduct_amount,
       charge_amount::DOUBLE AS charge_amount, current_amount_pre::DOUBLE AS current_amount_pre,
       current_amount_post::DOUBLE AS current_amount_post, charge_expire_time,
       current_amount_expire_time, strftime(creation_time, '%Y-%m') AS event_month
FROM facts"""
ON_EVENTS["stream_activity"] = _windows("hour")
ON_EVENTS["stream_activity_open"] = _all_windows("hour")
ON_EVENTS["stream_activity_daily"] = _windows("day")

ON_LINEITEM = {
    "kpi_summary": _kpis(LINEITEM_NOW),
    "overall_stats": f"{_overall(LINEITEM_NOW)} SELECT * FROM overall",
    "top_offer": """
SELECT offer_name, count(DISTINCT cust_num) AS subscriber_count
FROM facts JOIN offers USING (offer_id) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1""",
    "top_operation": """
SELECT description, count(*) AS event_count
FROM facts JOIN operation_types USING (operation_type_id) GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 1""",
    "object_types_used": """
SELECT count(DISTINCT object_type_id) AS unique_object_types_used
FROM objects SEMI JOIN object_types USING (object_type_id)""",
    "overall_conclusions": _conclusions(),
    "sample_top_offers": """
SELECT offer_id, count(*) AS n FROM facts GROUP BY ALL ORDER BY n DESC, offer_id NULLS LAST LIMIT 5""",
    "sample_top_operations": """
SELECT operation_type_id, count(*) AS n FROM facts GROUP BY ALL
ORDER BY n DESC, operation_type_id LIMIT 5""",
    "customer_type_distribution": """
SELECT cust_type, count(DISTINCT c.cust_num) AS customer_count, count(object_id) AS object_count
FROM customers c LEFT JOIN objects USING (cust_num) GROUP BY ALL""",
    "customer_spending_segments": f"""
, spending AS (SELECT cust_num, cust_type, sum(deduct_amount) AS spent, count(*) AS n,
                      {_mean('deduct_amount')} AS size
               FROM facts JOIN customers USING (cust_num) GROUP BY cust_num, cust_type),
cuts AS (SELECT list(spent ORDER BY spent NULLS FIRST) AS s, count(*) AS n FROM spending)
SELECT CASE WHEN spent >= s[ceil(cuts.n * 0.8)::INT] THEN 'High Value'
            WHEN spent >= s[ceil(cuts.n * 0.5)::INT] THEN 'Medium Value'
            ELSE 'Low Value' END AS spending_segment,
       cust_type, count(*) AS customer_count, {_mean('spent')} AS avg_total_spent,
       {_mean('spending.n')} AS avg_transactions, round(avg(size), 6) AS avg_transaction_size
FROM spending, cuts GROUP BY ALL""",
    "customer_offer_preferences": f"""
, favourite AS (SELECT cust_num, offer_name FROM facts JOIN offers USING (offer_id)
                GROUP BY cust_num, offer_name
                QUALIFY row_number() OVER (PARTITION BY cust_num ORDER BY count(*) DESC, offer_name) = 1),
spending AS (SELECT cust_num, sum(deduct_amount) AS spent FROM facts GROUP BY cust_num)
SELECT {_segment('offer_name', 'Loan takers', 'General users')} AS user_segment,
       count(*) AS customer_count, {_mean('spent')} AS avg_customer_value
FROM favourite JOIN spending USING (cust_num) GROUP BY ALL""",
    "customer_journey": f"""{_journey(LINEITEM_NOW)}
SELECT journey_stage, count(*) AS customers_count, {_mean('events')} AS avg_transactions,
       {_mean('spent')} AS avg_spending, {_mean('tried')} AS avg_offers_tried,
       sum(spent)::DOUBLE AS total_stage_revenue
FROM staged GROUP BY ALL""",
    "journey_funnel": f"""{_journey(LINEITEM_NOW)},
stages AS (SELECT journey_stage, count(*) AS customers_count, min(youngest) AS youngest
           FROM staged GROUP BY ALL)
SELECT journey_stage, customers_count,
       customers_count / (SELECT arg_min(customers_count, youngest) FROM stages) * 100 AS pct_initial
FROM stages""",
    "journey_sequence": f"""{_journey(LINEITEM_NOW)}
SELECT cust_num, creation_time, offer_name, deduct_amount::DOUBLE AS deduct_amount,
       row_number() OVER (PARTITION BY cust_num ORDER BY creation_time, cdr_event_id, offer_name,
                          deduct_amount) AS transaction_sequence,
       age AS days_from_first_transaction
FROM recent""",
    "customer_objects": """
SELECT cust_num, object_id, description AS object_type_description, expiry_date
FROM objects JOIN object_types USING (object_type_id)""",
    "object_profile": f"""
, latest AS ({_recent('object_id')})
SELECT o.object_id, o.cust_num, t.description AS object_type_description, o.expiry_date,
       latest.* EXCLUDE (object_id, event_no)
FROM objects o JOIN object_types t USING (object_type_id) LEFT JOIN latest USING (object_id)""",
    "offers_summary": f"""
SELECT o.offer_id, o.offer_name, count(DISTINCT cust_num) AS subscriber_count,
       count(cdr_event_id) AS event_count,
       coalesce({_mean('deduct_amount')}, 0) AS avg_deduct_amount,
       coalesce(sum(deduct_amount), 0)::DOUBLE AS total_deduct_amount
FROM offers o LEFT JOIN facts USING (offer_id) GROUP BY ALL""",
    "offer_performance": f"""
, aged AS (SELECT *, date_diff('day', min(creation_time) OVER (PARTITION BY cust_num, offer_id),
                               creation_time) AS days FROM facts)
SELECT o.offer_id, o.offer_name, count(DISTINCT cust_num) AS subscriber_count,
       count(cdr_event_id) AS event_count,
       coalesce(sum(deduct_amount), 0)::DOUBLE AS total_usage,
       coalesce({_mean('days')}, 0) AS avg_offer_lifetime_days
FROM offers o LEFT JOIN aged USING (offer_id) GROUP BY ALL""",
    "offer_trend": f"{_trend(LINEITEM_NOW)} SELECT * FROM trend",
    "offer_trend_top10": f"""{_trend(LINEITEM_NOW)}
SELECT * FROM trend SEMI JOIN
  (SELECT offer_name FROM trend GROUP BY ALL
   ORDER BY sum(unique_subscribers) DESC, offer_name LIMIT 10) USING (offer_name)""",
    "cross_offer": f"""{_baskets(LINEITEM_NOW)}
SELECT unique_offers_used, count(*) AS customer_count, {_mean('spent')} AS avg_spending_per_customer,
       {_mean('total_events')} AS avg_events_per_customer,
       sum(spent)::DOUBLE AS total_segment_revenue
FROM baskets GROUP BY ALL""",
    "customer_offer_list": f"""{_baskets(LINEITEM_NOW)}
SELECT * EXCLUDE (spent), spent::DOUBLE AS total_spent FROM baskets""",
    "competitive": f"""
, market AS (
  SELECT offer_name, count(DISTINCT cust_num) AS unique_users,
         sum(coalesce(deduct_amount, 0)) AS revenue,
         {_mean('coalesce(deduct_amount, 0)')} AS avg_revenue_per_use,
         nullif(date_diff('day', min(creation_time), {LINEITEM_NOW}), 0) AS days,
         CASE WHEN {_any('offer_name', 'data', 'internet', 'mo')} THEN 'Data Products'
              WHEN {_any('offer_name', 'voice', 'min', 'call')} THEN 'Voice Products'
              WHEN {_any('offer_name', 'loan')} THEN 'Financial Products'
              ELSE 'Other Products' END AS product_category
  FROM facts JOIN offers USING (offer_id) GROUP BY offer_name)
SELECT product_category, offer_name, unique_users, revenue::DOUBLE AS total_revenue,
       avg_revenue_per_use, revenue::DOUBLE / days AS daily_revenue,
       unique_users / days AS daily_user_acquisition,
       rank() OVER (PARTITION BY product_category ORDER BY revenue DESC) AS revenue_rank,
       rank() OVER (PARTITION BY product_category ORDER BY unique_users DESC) AS user_rank
FROM market""",
    "next_offer": f"""
, main AS (SELECT cust_num, offer_name AS main_offer,
                  {_segment('offer_name', 'Loan Users', 'Mixed Users')} AS user_segment
           FROM facts JOIN offers USING (offer_id) GROUP BY cust_num, offer_name
           QUALIFY rank() OVER (PARTITION BY cust_num ORDER BY count(*) DESC) = 1),
earned AS (
  SELECT user_segment, offer_name AS recommended_offer, count(DISTINCT cust_num) AS users_count,
         {_mean('deduct_amount')} AS avg_revenue_per_use, sum(deduct_amount) AS revenue
  FROM main JOIN facts USING (cust_num) JOIN offers USING (offer_id)
  WHERE offer_name <> main_offer AND CASE user_segment
    WHEN 'Data Users' THEN {_any('offer_name', 'data', 'internet')}
    WHEN 'Voice-centric users' THEN {_any('offer_name', 'voice', 'min', 'sms')}
    WHEN 'Loan Users' THEN {_any('offer_name', 'loan')} ELSE true END
  GROUP BY user_segment, offer_name)
SELECT * EXCLUDE (revenue), revenue::DOUBLE AS total_revenue,
       row_number() OVER (PARTITION BY user_segment ORDER BY revenue DESC, recommended_offer)
         AS recommendation_rank
FROM earned QUALIFY recommendation_rank <= 3""",
    "revenue_by_offer_month": f"""
SELECT {MONTH} AS month, offer_name, coalesce(sum(deduct_amount), 0)::DOUBLE AS revenue
FROM facts LEFT JOIN offers USING (offer_id) WHERE {USAGE} GROUP BY ALL""",
    "revenue_trend_by_type": f"""
SELECT {MONTH} AS month, cust_type, sum(deduct_amount)::DOUBLE AS monthly_revenue,
       count(DISTINCT cust_num) AS active_customers, count(*) AS total_transactions,
       {_mean('deduct_amount')} AS avg_transaction_value
FROM facts JOIN customers USING (cust_num)
WHERE creation_time >= {LINEITEM_NOW} - INTERVAL 18 MONTH GROUP BY ALL""",
    "arpu": f"""
SELECT {MONTH} AS month, cust_type, count(DISTINCT cust_num) AS active_users,
       sum(deduct_amount)::DOUBLE AS total_revenue,
       sum(deduct_amount)::DOUBLE / count(DISTINCT cust_num) AS arpu,
       {_mean('deduct_amount')} AS avg_transaction_value
FROM facts JOIN customers USING (cust_num)
WHERE creation_time >= {LINEITEM_NOW} - INTERVAL 12 MONTH GROUP BY ALL""",
    "balance_flow": _flow(LINEITEM_NOW),
    "loan_analysis": f"""{BORROWERS}
SELECT cust_type, count(*) AS loan_customers, {_mean('loans')} AS avg_loans_per_customer,
       {_mean('lent')} AS avg_total_loan_amount, {_mean('repaid')} AS avg_total_repayments,
       round(avg(repaid::DOUBLE / nullif(lent, 0)::DOUBLE), 6) AS avg_repayment_ratio,
       count(*) FILTER (repaid >= lent) AS customers_fully_repaid,
       count(*) FILTER (repaid * 2 < lent) AS high_risk_customers
FROM borrowers GROUP BY ALL""",
    "loan_risk_split": f"""{BORROWERS}
SELECT 'Low Risk' AS risk, count(*) FILTER ((repaid * 2 < lent) IS NOT TRUE) AS customers FROM borrowers
UNION ALL SELECT 'High Risk', count(*) FILTER (repaid * 2 < lent) FROM borrowers""",
    "object_types_analysis": """
SELECT t.object_type_code, t.description, count(DISTINCT object_id) AS object_count,
       count(DISTINCT cust_num) AS customer_count
FROM object_types t LEFT JOIN objects USING (object_type_id) GROUP BY ALL""",
    "expiry_forecast": _expiring(LINEITEM_NOW, "objects.expiry_date"),
    "dq_offer_consistency": OFFER_CHECK,
    "dq_customer_consistency": CUSTOMER_CHECK,
    "data_quality_report": _quality(LINEITEM_NOW),
    "churn_by_quarter": f"""
, quiet AS (SELECT cust_num, max(creation_time) AS last FROM facts SEMI JOIN customers USING (cust_num)
            GROUP BY ALL HAVING date_diff('day', max(creation_time), {LINEITEM_NOW}) > 90)
SELECT strftime(last, '%Y') || '-Q' || quarter(last) AS period, count(*) AS churn_count
FROM quiet GROUP BY ALL""",
    "churn_by_offer": f"""
, lapsed AS (SELECT cust_num, offer_id FROM facts GROUP BY ALL
             HAVING date_diff('day', max(creation_time), {LINEITEM_NOW}) > 90)
SELECT offer_id, offer_name, count(*) AS churned_customers
FROM lapsed JOIN offers USING (offer_id) GROUP BY ALL""",
    "churn_risk": f"""{_activity(LINEITEM_NOW)}
SELECT churn_risk_level, cust_type, count(*) AS customer_count, {_mean('spent')} AS avg_spent,
       {_mean('days_since_last_activity')} AS avg_days_inactive,
       {_mean('total_transactions')} AS avg_transactions,
       sum(spent)::DOUBLE AS total_revenue_at_risk
FROM activity GROUP BY ALL""",
    "customer_churn_flags": f"""{_activity(LINEITEM_NOW)}
SELECT * EXCLUDE (spent), spent::DOUBLE AS total_spent FROM activity""",
    "seasonality": f"""
, monthly AS (SELECT year(creation_time) AS year, month(creation_time) AS month,
                     monthname(creation_time) AS month_name, count(*) AS events,
                     sum(deduct_amount) AS revenue, count(DISTINCT cust_num) AS customers
              FROM facts WHERE creation_time >= {LINEITEM_NOW} - INTERVAL 24 MONTH GROUP BY ALL),
seasons AS (SELECT month, month_name, {_mean('events')} AS avg_monthly_events,
                   {_mean('revenue')} AS avg_monthly_revenue,
                   {_mean('customers')} AS avg_monthly_customers,
                   round(stddev_pop(revenue::DOUBLE), 4) AS revenue_volatility,
                   count(*) AS data_points
            FROM monthly GROUP BY ALL)
SELECT *, CASE WHEN avg_monthly_revenue > 1.1 * avg(avg_monthly_revenue) OVER () THEN 'Peak Season'
               WHEN avg_monthly_revenue < 0.9 * avg(avg_monthly_revenue) OVER () THEN 'Low Season'
               ELSE 'Normal Season' END AS season_type
FROM seasons""",
}

RAW = """
WITH numbered AS (
  SELECT *, json_extract_string(props, '$.k')::INT AS k,
         coalesce(list_position(['click', 'view', 'purchase', 'signup'], event_type), 5) AS op,
         value::DECIMAL(15,2)::VARCHAR AS v, strftime(ts, '%Y%m%d%H%M%S') AS stamp
  FROM events),
raw AS (
  SELECT
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN ' '
         WHEN event_id % 107 = 0 THEN 'CDR-' || event_id
         WHEN event_id % 50 = 1 THEN (event_id - 1)::VARCHAR ELSE event_id::VARCHAR END AS cdr_id,
    CASE WHEN event_id % 89 = 0 THEN 'not a time'
         WHEN event_id % 5 = 0 THEN stamp || '.0' ELSE stamp END AS creation_time,
    CASE WHEN event_id % 113 = 0 THEN 'unknown' WHEN event_id % 7 = 0 THEN user_id || '.0'
         ELSE user_id::VARCHAR END AS cust_num,
    CASE WHEN event_id % 127 = 0 THEN NULL WHEN event_id % 109 = 0 THEN 'Q'
         WHEN event_id % 2 = 0 THEN 'S' ELSE 'A' END AS cust_type,
    (user_id * 10 + k % 3)::VARCHAR AS object_id,
    (['F', 'f', 'B', 'C', 'c', 'Z', NULL])[k % 7 + 1] AS object_type,
    CASE WHEN event_id % 131 = 0 THEN '0' WHEN event_id % 137 = 0 THEN '6'
         ELSE op::VARCHAR END AS operation_type,
    CASE WHEN k % 18 < 10 THEN (7000000 + k % 18)::VARCHAR WHEN k % 18 < 12 THEN '1482110'
         WHEN k % 18 < 14 THEN 'none' WHEN k % 18 < 16 THEN NULL ELSE '9999999' END AS offer_id,
    CASE WHEN event_id % 83 = 0 THEN 'n/a' WHEN event_id % 97 = 0 THEN NULL
         WHEN op > 3 THEN '0' ELSE v END AS deduct_amount,
    if(op > 3, v, '0') AS charge_amount,
    v AS curent_amount,
    if(event_id % 79 = 0, NULL, v) AS curent_amount_2,
    if(op > 3, strftime(ts + to_hours(k - 20), '%Y%m%d%H%M%S') || '.0', NULL)
      AS charge_amount_expire_time,
    if(event_id % 3 <> 0, strftime(ts + to_hours(k * 5), '%Y%m%d%H%M%S'), NULL)
      AS curent_amount_expire_time
  FROM numbered),
named AS (
  SELECT * EXCLUDE (object_type, operation_type, curent_amount, curent_amount_2,
                    charge_amount_expire_time, curent_amount_expire_time),
         object_type AS object_type_code, operation_type AS operation_type_id,
         curent_amount AS current_amount_pre, curent_amount_2 AS current_amount_post,
         charge_amount_expire_time AS charge_expire_time,
         curent_amount_expire_time AS current_amount_expire_time
  FROM raw)
"""

CLOCKS = ("creation_time", "charge_expire_time", "current_amount_expire_time")
AMOUNTS = ("deduct_amount", "charge_amount", "current_amount_pre", "current_amount_post")
IDS = {"cust_num": "BIGINT", "object_id": "BIGINT", "offer_id": "INT", "operation_type_id": "SMALLINT"}


def _each(pattern: str, names) -> str:
    return ", ".join(f"{pattern.format(name)} AS {name}" for name in names)


NUMBERS = ", ".join(f"try_cast(try_cast({n} AS DOUBLE) AS {kind}) AS {n}" for n, kind in IDS.items())
TIMES = _each("try_strptime(replace({}, '.0', ''), '%Y%m%d%H%M%S')", CLOCKS)

CONFORMED = f"""{RAW},
conformed AS (
  SELECT nullif(trim(cdr_id), '') AS cdr_id, cust_type, upper(object_type_code) AS object_type_code,
         {NUMBERS}, {TIMES}, {_each('coalesce(try_cast({} AS DECIMAL(15,2)), 0)', AMOUNTS)}
  FROM named),
valid AS (
  SELECT * FROM conformed
  WHERE cdr_id IS NOT NULL AND creation_time IS NOT NULL AND cust_num IS NOT NULL
    AND operation_type_id IS NOT NULL),
first_records AS (
  SELECT * EXCLUDE (cust_type, object_type_code) FROM valid
  QUALIFY row_number() OVER (PARTITION BY cdr_id ORDER BY creation_time, cust_num, object_id) = 1),
new_customers AS (
  SELECT cust_num AS cust_num_bigint,
         arg_min(cust_type, (coalesce(creation_time, 'infinity'), cust_type)) AS cust_type
  FROM conformed WHERE cust_num IS NOT NULL AND cust_type IN ('S', 'A') GROUP BY ALL),
types AS (SELECT * FROM (VALUES (1, 'F'), (2, 'B'), (3, 'C'), (4, 'Z'))
          AS t(object_type_id, object_type_code)),
new_objects AS (
  SELECT object_id AS object_id_bigint, cust_num AS cust_num_bigint, object_type_id,
         current_amount_expire_time AS expiry_date
  FROM conformed JOIN types USING (object_type_code)
  WHERE object_id IS NOT NULL AND cust_num IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY current_amount_expire_time NULLS LAST,
                             object_type_id, cust_num) = 1),
raw_offers AS (
  SELECT try_cast(CASE WHEN p_partkey % 19 = 0 THEN 'x' || p_partkey
                       WHEN p_partkey % 10 = 1 THEN (6999999 + p_partkey)::VARCHAR
                       WHEN p_partkey % 23 = 0 THEN '1482110'
                       ELSE (7000000 + p_partkey)::VARCHAR END AS INT) AS offer_id,
         p_name AS offer_name
  FROM part),
seed_offers AS (SELECT * FROM (VALUES {_values(SEED_OFFERS)}) AS t(offer_id, offer_name)),
new_offers AS (
  SELECT offer_id, min(offer_name) AS offer_name
  FROM raw_offers ANTI JOIN seed_offers USING (offer_id)
  WHERE offer_id IS NOT NULL GROUP BY ALL),
known_offers AS (SELECT * FROM seed_offers UNION ALL SELECT * FROM new_offers),
labels AS (SELECT * FROM (VALUES {_values(SEED_OPERATION_TYPES)}) AS t(operation_type_id, description)),
referenced AS (
  SELECT * FROM first_records
  WHERE cust_num IN (SELECT cust_num_bigint FROM new_customers)
    AND object_id IN (SELECT object_id_bigint FROM new_objects
                      SEMI JOIN new_customers USING (cust_num_bigint))
    AND operation_type_id BETWEEN 1 AND 5
    AND (offer_id IS NULL OR offer_id IN (SELECT offer_id FROM known_offers)))
"""

DOUBLES = "REPLACE (" + _each("{}::DOUBLE", AMOUNTS) + ")"


def _counted(table: str, offered: str, added: str) -> str:
    return f"SELECT '{table}' AS table_name, ({offered}) AS attempted, ({added}) AS inserted"


INGEST = {
    "raw_source": f"{RAW} SELECT * FROM raw",
    "ingest_normalize": f"{RAW} SELECT * FROM raw",
    "ingest_rename": f"{RAW} SELECT * FROM named",
    "ingest_project": f"{RAW} SELECT * EXCLUDE (cust_type, object_type_code) FROM named",
    "ingest_cast": f"""{RAW}
SELECT cdr_id, {', '.join(CLOCKS)}, {NUMBERS},
       {_each('try_cast({} AS DECIMAL(15,2))::DOUBLE', AMOUNTS)} FROM named""",
    "ingest_fill": f"""{RAW}
SELECT cdr_id, {', '.join(CLOCKS)}, {NUMBERS},
       {_each('coalesce(try_cast({} AS DECIMAL(15,2)), 0)::DOUBLE', AMOUNTS)} FROM named""",
    "ingest_ts": f"{RAW} SELECT cdr_id, {TIMES} FROM named",
    "ingest_required": f"""{CONFORMED}
SELECT * EXCLUDE (cust_type, object_type_code) {DOUBLES} FROM valid""",
    "ingest_quarantine": f"""{CONFORMED}
SELECT cdr_id, creation_time, cust_num, operation_type_id, object_id,
       concat_ws(',', if(cdr_id IS NULL, 'cdr_id', NULL),
                 if(creation_time IS NULL, 'creation_time', NULL),
                 if(cust_num IS NULL, 'cust_num', NULL),
                 if(operation_type_id IS NULL, 'operation_type_id', NULL)) AS missing_columns
FROM conformed WHERE missing_columns <> ''""",
    "ingest_customers": f"{CONFORMED} SELECT * FROM new_customers",
    "ingest_object_types": f"""{CONFORMED}
SELECT (3 + row_number() OVER (ORDER BY object_type_code))::INT AS object_type_id, object_type_code,
       'Auto-imported type ' || object_type_code AS description
FROM (SELECT DISTINCT object_type_code FROM conformed
      WHERE object_type_code NOT IN ('F', 'B', 'C'))""",
    "ingest_offers": f"{CONFORMED} SELECT * FROM new_offers",
    "ingest_operation_types": f"""{CONFORMED}
SELECT operation_type_id::SMALLINT AS operation_type_id, description FROM labels
WHERE operation_type_id > 3 AND operation_type_id IN (SELECT operation_type_id FROM conformed)""",
    "ingest_objects": f"{CONFORMED} SELECT * FROM new_objects",
    "ingest_events_incremental": f"""{CONFORMED}
SELECT * {DOUBLES} FROM first_records
WHERE cdr_id NOT IN (SELECT cdr_id FROM valid WHERE creation_time < '2024-01-11')""",
    "ingest_fk_filter": f"{CONFORMED} SELECT * {DOUBLES} FROM referenced",
    "ingest_load": f"""{CONFORMED}
SELECT *, strftime(creation_time, '%Y-%m') AS event_month FROM (SELECT * {DOUBLES} FROM referenced)""",
    "facts_reset": f"""{CONFORMED}
SELECT *, strftime(creation_time, '%Y-%m') AS event_month FROM (SELECT * {DOUBLES} FROM referenced)""",
    "ingest_rejected": f"""{CONFORMED},
missing AS (
  SELECT 'missing ' || concat_ws(',', if(cdr_id IS NULL, 'cdr_id', NULL),
                 if(creation_time IS NULL, 'creation_time', NULL),
                 if(cust_num IS NULL, 'cust_num', NULL),
                 if(operation_type_id IS NULL, 'operation_type_id', NULL)) AS reason
  FROM conformed),
refused AS (
  SELECT concat_ws(', ',
    if(cust_num IN (SELECT cust_num_bigint FROM new_customers), NULL, 'unknown customer'),
    if(object_id IN (SELECT object_id_bigint FROM new_objects
                     SEMI JOIN new_customers USING (cust_num_bigint)), NULL, 'unknown object'),
    if(operation_type_id BETWEEN 1 AND 5, NULL, 'unknown operation'),
    if(offer_id IS NULL OR offer_id IN (SELECT offer_id FROM known_offers), NULL, 'unknown offer')) AS reason
  FROM first_records)
SELECT reason, count(*) AS rejected
FROM (SELECT * FROM missing WHERE reason <> 'missing ' UNION ALL SELECT * FROM refused WHERE reason <> '')
GROUP BY ALL
UNION ALL SELECT 'repeated', (SELECT count(*) FROM valid) - (SELECT count(*) FROM first_records)""",
    "stream_ingest": f"""{CONFORMED}
SELECT *, strftime(creation_time, '%Y-%m') AS event_month FROM (SELECT * {DOUBLES} FROM referenced)
WHERE offer_id IS NULL OR offer_id IN (SELECT offer_id FROM seed_offers)""",
    "ingest_counts": CONFORMED
    + " UNION ALL ".join(
        [
            _counted(
                "customers",
                "SELECT count(DISTINCT cust_num) FROM conformed",
                "SELECT count(*) FROM new_customers",
            ),
            _counted(
                "object_types",
                "SELECT count(DISTINCT object_type_code) FROM conformed",
                "SELECT count(DISTINCT object_type_code) FROM conformed "
                "WHERE object_type_code NOT IN ('F', 'B', 'C')",
            ),
            _counted(
                "operation_types",
                "SELECT count(DISTINCT operation_type_id) FROM conformed",
                "SELECT count(DISTINCT operation_type_id) FROM conformed "
                "WHERE operation_type_id IN (4, 5)",
            ),
            _counted(
                "offers",
                "SELECT count(DISTINCT offer_id) FROM raw_offers",
                "SELECT count(*) FROM new_offers",
            ),
            _counted(
                "objects",
                "SELECT count(DISTINCT object_id) FROM conformed",
                "SELECT count(*) FROM new_objects",
            ),
            _counted(
                "cdr_events",
                "SELECT count(*) FROM conformed",
                "SELECT count(*) FROM referenced",
            ),
        ]
    ),
}


# The same reports with rules that ask for loans before anything else.
for _name, _loan in (("next_offer", "Loan Users"), ("customer_offer_preferences", "Loan takers")):
    ON_LINEITEM[f"{_name}_loans_first"] = ON_LINEITEM[_name].replace(
        "CASE WHEN", f"CASE WHEN {_any('offer_name', 'loan')} THEN '{_loan}' WHEN", 1
    )

for _name in ("arpu", "balance_flow", "revenue_trend_by_type", "offer_trend"):
    ON_LINEITEM[f"{_name}_from_partials"] = ON_LINEITEM[_name]
ON_LINEITEM["spending_sketches"] = f"""
SELECT count(DISTINCT cust_num) AS active_customers, true AS customers_close, true AS percentiles_close
FROM facts WHERE creation_time >= {LINEITEM_NOW} - INTERVAL 12 MONTH"""


def all_oracles() -> dict[str, str]:
    return {
        **{name: EVENTS_STAR + sql for name, sql in ON_EVENTS.items()},
        **{name: LINEITEM_STAR + sql for name, sql in ON_LINEITEM.items()},
        **INGEST,
    }
