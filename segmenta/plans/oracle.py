"""

It shares no table with the operators: codes, keys and steps are stated again here, so a wrong
entry on either side fails the comparison.  Fixture views have the definitions of
:mod:`segmenta.sources.tables`.
"""

from __future__ import annotations

from segmenta.plans import cards

# They must equal the dashboard's own.
SEGMENTS = {
    'Чемпионы': '000',
    'Потенциальные лидеры': '001 110 111 101 011 100 010',
    'Лояльные': '122 123 023 013 022 112 113 012 002 003 102 103',
    'Перспективные': '021 031 020 030 121 131 120 130 201',
    'Низкоактивные крупные покупатели': '210 220 211 221 230',
    'Растущие': '222 212 213 223 202 203',
    'Новички': '133 132 033 032',
    'Требуют внимания': '330 331 320 310 321 311 200 300 301 231',
    'Сомневаются': '303 302',
    'В зоне риска': '313 312',
    'Спящие': '322 323 232 233',
    'Потерянные': '332 333',
}
OTHER_SEGMENT = 'Прочие'
KEYS = ('discount', 'utm_source', 'funnel', 'source')
STEPS = [  # flag, event, title
    ('step1_visit', 'enter_site', '1. Зашел на сайт'),
    ('step2_page', 'open_page', '2. Открыл страницу'),
    ('step3_consult', 'request_consultation', '3. Оставил заявку на консультацию'),
    ('step4_demo', 'request_demo', '4. Запросил демо'),
    ('step5_payment', 'go_to__payment', '5. Перешел к оплате'),
    ('step6_results', 'get_test_results', '6. Запросил результаты теста'),
]
CHANNELS = {
    'Чемпионы': 'sms',
    'Потенциальные лидеры': 'sms',
    'Перспективные': 'sms',
    'Лояльные': 'sms',
    'Низкоактивные крупные покупатели': 'sms',
    'Требуют внимания': 'sms',
    'Растущие': 'in_store',
    'Новички': 'in_store',
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in rows)


def _is(column: str, wanted) -> str:
    """A condition; true without a wish."""
    if wanted is None:
        return "true"
    wanted = [wanted] if isinstance(wanted, str) else wanted
    return f"list_contains([{', '.join(map(_q, wanted))}], {column})"


def _between(column: str, days) -> str:
    return f"CAST({column} AS DATE) BETWEEN DATE {_q(days[0])} AND DATE {_q(days[1])}" if days else "true"


SHOPS = """shops AS (
  SELECT DISTINCT o_orderpriority AS name FROM orders
  WHERE o_orderpriority <> '4-NOT SPECIFIED')"""

BONUSCHEQUES = """bonuscheques AS (
  SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN '100' ELSE '200' END
           || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS card,
         o_orderkey AS doc_id, o_orderpriority AS shop, o_orderdate AS datetime,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS summ_with_disc
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
              JOIN customer ON c_custkey = o_custkey)"""

USERS = """users AS (
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey END AS id,
         o_orderdate AS date_joined
  FROM orders)"""

USERENTRY = """userentry AS (SELECT user_id, ts AS entry_at FROM events)"""

USERENTRY_MONTHS = """userentry AS (SELECT o_custkey AS user_id, o_orderdate AS entry_at FROM orders)"""

STAT = """stat AS (
  SELECT user_id AS uid,
    CASE event_type WHEN 'view' THEN 'enter_site' WHEN 'click' THEN 'open_page'
      WHEN 'signup' THEN 'request_consultation' WHEN 'purchase' THEN 'go_to__payment'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'request_demo' ELSE 'get_test_results' END
    END AS event,
    ts AS created_at,
    CASE event_id % 7 WHEN 0 THEN NULL
      WHEN 1 THEN '?utm_source=src' || CAST(user_id % 4 AS VARCHAR)
      WHEN 2 THEN '?discount=' || CAST((event_id % 3) * 10 AS VARCHAR)
                  || '&funnel=f' || CAST(user_id % 2 AS VARCHAR)
      WHEN 3 THEN '?source=s' || CAST(user_id % 3 AS VARCHAR)
                  || '&utm_source=src' || CAST(user_id % 4 AS VARCHAR)
      WHEN 4 THEN '?utm_source=src1&source=s2'
      WHEN 5 THEN '?page=1'
      ELSE '?discount=&funnel=f9' END AS url_params,
    event_id
  FROM events)"""

STAT_IRREGULAR = STAT.replace("stat AS", "regular AS") + """, stat AS (
  SELECT CASE WHEN event_id % 3 <> 0 THEN uid END AS uid, event, event_id, url_params,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN CAST(CAST(created_at AS DATE) AS TIMESTAMP)
              ELSE created_at END AS created_at
  FROM regular)"""

# --- scoring ---------------------------------------------------------------------

_CODES = _values((code, name) for name, codes in SEGMENTS.items() for code in codes.split())


def _scored(days=None, shops=None) -> str:
    """purchase, measure, cut (one row of quartiles) and scored."""

    def cuts(letter, names):
        return ", ".join(
            f"max(bound) FILTER (kind = {_q(letter)} AND q = {q}) AS {name}" for q, name in zip((1, 2, 3), names)
        )

    def above(value, *names):
        return " + ".join(f"CAST(coalesce({value} > {name}, true) AS INTEGER)" for name in names)

    return f"""WITH {SHOPS}, {BONUSCHEQUES},
purchase AS (
  SELECT card AS client_id, doc_id, shop, CAST(datetime AS DATE) AS day, summ_with_disc AS amount
  FROM bonuscheques SEMI JOIN shops ON shops.name = bonuscheques.shop
  WHERE starts_with(card, '200') AND {_between('datetime', days)} AND {_is('shop', shops)}),
measure AS (
  SELECT client_id, shop, (SELECT max(day) FROM purchase) - max(day) AS recency,
         count(DISTINCT doc_id) AS frequency, sum(amount) AS monetary
  FROM purchase GROUP BY ALL),
placed AS (
  SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS i,
         count(*) OVER (PARTITION BY kind) - 1 AS top
  FROM (SELECT unnest(['r', 'f', 'm']) AS kind,
               unnest([CAST(recency AS DOUBLE), CAST(frequency AS DOUBLE), CAST(monetary AS DOUBLE)]) AS v
        FROM measure)
  WHERE v IS NOT NULL),
quartile AS (
  SELECT kind, q, max(v) FILTER (i = top * q // 4) AS low, max(v) FILTER (i = (top * q + 3) // 4) AS high,
         max(top * q % 4) / 4.0::DOUBLE AS part
  FROM placed, (VALUES (1), (2), (3)) AS quarters(q) GROUP BY kind, q),
cut AS (
  SELECT {cuts('r', ('r25', 'recency_median', 'r75'))},
         {cuts('f', ('f25', 'frequency_median', 'f75'))},
         {cuts('m', ('m25', 'monetary_median', 'm75'))}
  FROM (SELECT kind, q, low + part * (high - low) AS bound FROM quartile)),
ranked AS (
  SELECT measure.*, {above('recency', 'r25', 'recency_median', 'r75')} AS r_rank,
         3 - ({above('frequency', 'f25', 'frequency_median', 'f75')}) AS f_rank,
         3 - ({above('CAST(monetary AS DOUBLE)', 'm25', 'monetary_median', 'm75')}) AS m_rank
  FROM measure, cut),
scored AS (
  SELECT ranked.*, concat(r_rank, f_rank, m_rank) AS rfm_code, coalesce(named, {_q(OTHER_SEGMENT)}) AS rfm_group
  FROM ranked LEFT JOIN (VALUES {_CODES}) AS codes(code, named) ON code = concat(r_rank, f_rank, m_rank))
"""


TRANSACTIONS = _scored() + """
SELECT client_id, doc_id, shop, day AS transaction_date, (SELECT max(day) FROM purchase) AS current_dt,
       CAST(amount AS DOUBLE) AS purchase_amount
FROM purchase"""
RFM_BASE = _scored() + "SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM measure"
RFM_THRESHOLDS = _scored() + "FROM cut"
RFM_RANKS = _scored() + "SELECT client_id, shop, r_rank, f_rank, m_rank FROM scored"
RFM_SEGMENTS = _scored() + "SELECT client_id, rfm_code, shop, rfm_group FROM scored"


def _report(keys: str, group=None, **filters) -> str:
    return _scored(**filters) + f"""
SELECT rfm_group, s.shop, CAST(o.monetary AS DOUBLE) AS monetary, o.recency, o.frequency, client_id, rfm_code
FROM scored AS s JOIN measure AS o USING ({keys}) WHERE {_is('rfm_group', group)}"""


def _ltv(groups=None, **filters) -> str:
    return _scored(**filters) + f"""
SELECT client_id, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT month(day)) AS active_month,
       CAST(sum(amount) AS DOUBLE) / count(DISTINCT month(day)) AS revenue_per_active_month
FROM scored JOIN purchase USING (client_id) WHERE {_is('rfm_group', groups)} GROUP BY client_id, rfm_group"""


def _seasonality(group=None) -> str:
    return _scored() + f"""
SELECT CAST(m AS INTEGER) AS month, round(avg(total) / avg(avg(total)) OVER (), 2) AS seasonality_index
FROM (SELECT year(day) AS y, month(day) AS m, rfm_group, sum(amount) AS total
      FROM scored JOIN purchase USING (client_id) WHERE {_is('rfm_group', group)} GROUP BY ALL)
GROUP BY m ORDER BY m"""


def _share(group=None, **filters) -> str:
    return _scored(**filters) + f""",
chosen AS (SELECT *, greatest(r_rank, f_rank, m_rank) < 2 AS good FROM scored WHERE {_is('rfm_group', group)})
SELECT if(good, 'High M + Good R/F', 'Other') AS segment, rfm_group, count(*) AS clients_count,
       CAST(sum(monetary) AS DOUBLE) AS total_revenue, CAST(sum(frequency) AS BIGINT) AS total_purchases,
       CAST(sum(monetary) AS DOUBLE) / count(*) AS avg_check,
       round(CAST(100 * sum(monetary) AS DOUBLE) / (SELECT CAST(sum(monetary) AS DOUBLE) FROM chosen), 2)
         AS revenue_share_percent
FROM chosen GROUP BY good, rfm_group ORDER BY revenue_share_percent DESC"""


def _kpi(groups=None, **filters) -> str:
    return _scored(**filters) + f"""
SELECT round(CAST(100 * coalesce(sum(monetary) FILTER (greatest(r_rank, f_rank, m_rank) < 2), 0) AS DOUBLE)
             / CAST(sum(monetary) AS DOUBLE), 2) AS high_value_share_percent,
       CAST(sum(frequency) AS BIGINT) AS total_purchases, count(*) AS clients_count,
       CAST(sum(monetary) AS DOUBLE) AS total_revenue, CAST(sum(monetary) AS DOUBLE) / count(*) AS avg_check
FROM scored WHERE {_is('rfm_group', groups)}"""


def _average(measure: str, out: str, group=None, **filters) -> str:
    """Each row of a client meets all of the client's rows twice."""
    return _scored(**filters) + f""",
client AS (SELECT client_id, count(*) * sum({measure}) AS total, count(*) * count({measure}) AS n FROM measure GROUP BY 1)
SELECT rfm_group, round(CAST(sum(total) AS DOUBLE) / sum(n), 1) AS {out}
FROM scored JOIN client USING (client_id) WHERE {_is('rfm_group', group)}
GROUP BY rfm_group HAVING sum(n) > 0 ORDER BY 2 DESC"""


# --- lifecycle --------------------------------------------------------------------


def _cohort(group=None, columns="*", **filters) -> str:
    return _scored(**filters) + f""",
active AS (
  SELECT DISTINCT client_id, rfm_group, date_trunc('month', day) AS seen,
         date_trunc('month', min(day) OVER (PARTITION BY client_id)) AS start
  FROM purchase JOIN scored USING (client_id)),
counted AS (
  SELECT CAST(start AS DATE) AS cohort_month, rfm_group, count(*) AS retained_users,
         max(if(seen = start, count(*), NULL)) OVER (PARTITION BY start, rfm_group) AS cohort_users,
         CAST(12 * (year(seen) - year(start)) + month(seen) - month(start) AS INTEGER) AS months_after_first
  FROM active GROUP BY start, seen, rfm_group),
rated AS (
  SELECT cohort_month, rfm_group, retained_users, cohort_users,
         CAST(round(CAST(least(retained_users, cohort_users) AS DECIMAL(20,0)) / cohort_users, 2) AS DOUBLE) AS retention_rate,
         months_after_first
  FROM counted WHERE {_is('rfm_group', group)} ORDER BY cohort_month, months_after_first, rfm_group)
SELECT {columns} FROM rated"""


def _churn(group=None, **filters) -> str:
    return _scored(**filters) + f""",
gaps AS (
  SELECT client_id, DATE {_q(cards.CHURN_AS_OF)} - day AS age,
         min(day) OVER (PARTITION BY client_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) - day AS gap
  FROM purchase)
SELECT if(age > 90, 'Более 90 дней', 'До 30 дней') AS recency_group, rfm_group, count(*) AS total_clients,
       count(*) FILTER (coalesce(gap, 91) > 90) AS churn_clients,
       round(100.0 * count(*) FILTER (coalesce(gap, 91) > 90) / count(*), 2) AS churn_percent
FROM scored JOIN gaps USING (client_id)
WHERE (age > 90 OR age <= 30) AND {_is('rfm_group', group)}
GROUP BY 1, 2 ORDER BY 2, 5 DESC"""


def _churn_risk(groups=None) -> str:
    return _scored() + f"""
SELECT client_id, rfm_group, day AS transaction_date, age AS recency_days,
       CASE WHEN age > 90 THEN 'высокий' WHEN age > 30 THEN 'средний' ELSE 'низкий' END || ' риск ухода'
         AS churn_risk_segment
FROM (SELECT client_id, day, (SELECT max(day) FROM purchase) - day AS age FROM purchase)
     JOIN scored USING (client_id)
WHERE {_is('rfm_group', groups)} ORDER BY age DESC"""


AVG_INTERVAL_BY_CHURN_RISK = _scored() + """,
days AS (SELECT DISTINCT client_id, day FROM purchase),
steps AS (
  SELECT client_id, day - lag(day) OVER client AS gap,
         (SELECT max(day) FROM purchase) - max(day) OVER (PARTITION BY client_id) AS age
  FROM days WINDOW client AS (PARTITION BY client_id ORDER BY day))
SELECT CASE WHEN age > 90 THEN 'высокий' WHEN age > 30 THEN 'средний' ELSE 'низкий' END || ' риск ухода'
         AS churn_risk_segment,
       count(DISTINCT client_id) AS clients_count, round(avg(gap), 1) AS avg_interval_days
FROM steps GROUP BY 1 ORDER BY 1"""


def _weekly(entries: str) -> str:
    return f"""WITH {entries},
aged AS (
  SELECT user_id, min(entry_at) OVER visitor AS start,
         (epoch_us(CAST(entry_at AS TIMESTAMP)) - epoch_us(CAST(min(entry_at) OVER visitor AS TIMESTAMP)))
           // 604800000000 AS week
  FROM userentry WHERE user_id IS NOT NULL WINDOW visitor AS (PARTITION BY user_id)),
counted AS (
  SELECT CAST(date_trunc('month', start) AS DATE) AS cohort_month, week, count(DISTINCT user_id) AS n
  FROM aged GROUP BY 1, 2)
SELECT cohort_month, week AS weeks_since_first,
       round(100.0 * n / first_value(n) OVER (PARTITION BY cohort_month ORDER BY week), 2) AS retention_percent
FROM counted QUALIFY week > 0 ORDER BY 1, 2"""


_FIRST_DAY = f"make_date(year(DATE {_q(cards.REGISTRATIONS_AS_OF)}) - {{back}}, 1, 1)"
REGISTRATIONS_DAILY = f"""WITH {USERS}
SELECT CAST(date_joined AS DATE) AS date_joined, count(id) AS count FROM users
WHERE year(date_joined) BETWEEN year({_FIRST_DAY.format(back=30)}) AND year({_FIRST_DAY.format(back=1)})
GROUP BY 1 HAVING count(id) > 0 ORDER BY 1"""
REGISTRATIONS_MONTHLY = f"""WITH {USERS}
SELECT make_date(year(date_joined), month(date_joined), 1) AS date_joined, count(id) AS count
FROM users GROUP BY 1 HAVING count(id) > 0 ORDER BY 1"""

# --- campaigns ---------------------------------------------------------------------


def _parsed(days=None, anchor: str = "", log: str = STAT) -> str:
    found = ", ".join(f"nullif(regexp_extract(url_params, '(?s).*{anchor}{k}=([^&]+)', 1), '') AS {k}" for k in KEYS)
    return f"WITH {log}, parsed AS (SELECT uid, event, created_at, event_id, {found} FROM stat WHERE {_between('created_at', days)})"


def _filled(skip: str = "", **filters) -> str:
    both = ", ".join(f"coalesce({k}, lag({k}{skip}) OVER log) AS {k}_filled" for k in KEYS)
    log = "WINDOW log AS (PARTITION BY uid ORDER BY created_at NULLS LAST, event_id)"
    return _parsed(**filters) + f", filled AS (SELECT uid, event, created_at, event_id, {both} FROM parsed {log})"


def _tagged(**filters) -> str:
    columns = ", ".join(f"{k}_filled" for k in KEYS)
    return _filled(**filters) + f""", tagged AS (
  SELECT uid, event, replace(tag, '_filled', '') || '=' || value AS param
  FROM (UNPIVOT filled ON {columns} INTO NAME tag VALUE value))"""


def _event_counts(**filters) -> str:
    return _tagged(**filters) + "SELECT param AS params, event, count(*) AS cnt FROM tagged GROUP BY ALL ORDER BY cnt DESC"


PARAM_FUNNEL_FLAGS = _tagged() + "SELECT uid, param, " + ", ".join(
    f"CAST(count_if(event = {_q(event)}) > 0 AS INTEGER) AS {flag}" for flag, event, _ in STEPS
) + " FROM tagged GROUP BY uid, param"


def _reached(**filters) -> str:
    """Visitors per parameter and step; those without an id are one."""
    return _tagged(**filters) + f""", reached AS (
  SELECT param, step, count(DISTINCT coalesce(CAST(uid AS VARCHAR), '')) AS users_count
  FROM tagged JOIN (VALUES {_values((event, title) for _, event, title in STEPS)}) AS steps(event, step) USING (event)
  GROUP BY param, step)"""


def _funnel(pattern=None, **filters) -> str:
    return _reached(**filters) + f"""
SELECT step, users_count,
       coalesce(round(100.0 * users_count / lag(users_count) OVER (PARTITION BY param ORDER BY step), 2), 100.0)
         AS conversion_percent, param
FROM reached WHERE {f"param ILIKE {_q(pattern)}" if pattern else "true"} ORDER BY step"""


CAMPAIGN_AUDIENCE = _scored() + f"""
SELECT DISTINCT client_id, rfm_group, channel
FROM scored JOIN (VALUES {_values(CHANNELS.items())}) AS channels(rfm_group, channel) USING (rfm_group)"""
REPEAT_BUYERS = _scored() + """
SELECT * FROM (
  SELECT client_id, count(DISTINCT doc_id) AS purchases FROM purchase
  WHERE day > (SELECT max(day) - INTERVAL 6 MONTH FROM purchase) GROUP BY client_id)
WHERE purchases > 2"""

def _table(view: str, name: str) -> str:
    return f"WITH {view} SELECT * FROM {name}"


_DAYS, _SHOPS = cards.FILTER_DATE_RANGE, cards.FILTER_SHOPS
_GROUP, _GROUPS = cards.FILTER_GROUP, cards.FILTER_GROUPS
_PUBLISHED = "cohort_month, rfm_group, retained_users, cohort_users, retention_rate"

ORACLE_SQL: dict[str, str] = {
    "transactions": TRANSACTIONS,
    "rfm_base": RFM_BASE,
    "rfm_thresholds": RFM_THRESHOLDS,
    "rfm_ranks": RFM_RANKS,
    "rfm_segments": RFM_SEGMENTS,
    "rfm_report": _report("client_id"),
    "rfm_report_by_shop": _report("client_id, shop"),
    "ltv": _ltv(),
    "seasonality_index": _seasonality(),
    "segment_revenue_share": _share(),
    "kpi_cards": _kpi(),
    "cohort_retention": _cohort(),
    "churn_rate": _churn(),
    "churn_risk_segment": _churn_risk(),
    "avg_recency_by_segment": _average("recency", "avg_interval_days"),
    "avg_spend_by_segment": _average("monetary", "avg_spend"),
    "avg_frequency_by_segment": _average("frequency", "avg_frequency"),
    "registrations_daily": REGISTRATIONS_DAILY,
    "registrations_monthly": REGISTRATIONS_MONTHLY,
    "weekly_retention": _weekly(USERENTRY),
    "weekly_retention_cohorts": _weekly(USERENTRY_MONTHS),
    "url_params": _parsed() + "SELECT * EXCLUDE event_id FROM parsed",
    "url_params_exact_key": _parsed(anchor="(?:^|[?&])") + "SELECT * EXCLUDE event_id FROM parsed",
    "attribution_fill": _filled() + "SELECT * EXCLUDE event_id FROM filled",
    "attribution_carry_forward": _filled(skip=" IGNORE NULLS") + "SELECT * EXCLUDE event_id FROM filled",
    "attribution_fill_irregular": _filled(log=STAT_IRREGULAR) + "FROM filled",
    "attribution_carry_forward_irregular": _filled(skip=" IGNORE NULLS", log=STAT_IRREGULAR) + "FROM filled",
    "param_event_counts_irregular": _event_counts(log=STAT_IRREGULAR),
    "param_rows": _tagged() + "FROM tagged",
    "param_event_counts": _event_counts(),
    "param_funnel_flags": PARAM_FUNNEL_FLAGS,
    "param_funnel_steps": _reached() + "FROM reached",
    "param_funnel": _funnel(),
    "param_funnel_filtered": _funnel(cards.FILTER_PARAM),
    "dashboard_filters": _report("client_id", _GROUP, days=_DAYS, shops=_SHOPS),
    "ltv_filtered": _ltv(_GROUPS, days=_DAYS),
    "churn_rate_filtered": _churn(_GROUP, shops=_SHOPS),
    "segment_revenue_share_filtered": _share(_GROUP, days=_DAYS),
    "seasonality_index_filtered": _seasonality(_GROUP),
    "cohort_retention_filtered": _cohort(_GROUP, _PUBLISHED, shops=_SHOPS),
    "churn_risk_segment_filtered": _churn_risk(_GROUPS),
    "avg_recency_filtered": _average("recency", "avg_interval_days", _GROUP, days=_DAYS),
    "param_event_counts_period": _event_counts(days=cards.FILTER_STAT_PERIOD),
    "avg_spend_filtered": _average("monetary", "avg_spend", _GROUPS, days=_DAYS),
    "avg_frequency_filtered": _average("frequency", "avg_frequency", _GROUP, shops=_SHOPS),
    "kpi_cards_filtered": _kpi(_GROUPS, days=_DAYS, shops=_SHOPS),
    "param_funnel_period": _funnel(days=cards.FILTER_STAT_PERIOD),
    "param_funnel_published": f"SELECT * EXCLUDE param FROM ({_funnel()})",
    "weekly_retention_exported": _weekly(USERENTRY_MONTHS) + f" LIMIT {cards.EXPORT_CAP}",
    "weekly_retention_capped": _weekly(USERENTRY_MONTHS) + f" LIMIT {cards.SMALL_CAP}",
    "avg_interval_by_churn_risk": AVG_INTERVAL_BY_CHURN_RISK,
    "read_bonuscheques": f"WITH {BONUSCHEQUES} SELECT * REPLACE (CAST(summ_with_disc AS DOUBLE) AS summ_with_disc) FROM bonuscheques",
    "read_shops": _table(SHOPS, "shops"),
    "read_users": _table(USERS, "users"),
    "read_userentry": _table(USERENTRY, "userentry"),
    "read_stat": f"WITH {STAT} SELECT * EXCLUDE event_id FROM stat",
    "rejected_stat": f"WITH {STAT_IRREGULAR} SELECT 'created_at: missing' AS problem, count(*) AS rows FROM stat WHERE created_at IS NULL",
    "cheques_of_a_period": _scored(days=_DAYS) + """
SELECT client_id, doc_id, shop, day AS transaction_date, CAST(amount AS DOUBLE) AS purchase_amount FROM purchase""",
    "published_rfm_segments": RFM_SEGMENTS,
    "published_registrations": REGISTRATIONS_DAILY,
    "campaign_audience": CAMPAIGN_AUDIENCE,
    "repeat_buyers": REPEAT_BUYERS,
}
