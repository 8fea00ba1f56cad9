"""SQL for each registered query, written from what the analysis means, not from its plan:
first periods by self join, ranks by sorting everything, histograms by comparing edges.
"""

from __future__ import annotations

from patronage.registry.queries import (
    ACTIVATION_CHOICE,
    CHOSEN,
    POINTS,
    SAMPLE_ROWS,
    SAMPLE_ROWS_LARGE,
    SKETCHED,
    SPLITS,
    TABLES,
    TOLERANCE,
    YEAR_1995,
    YEAR_1996,
)
from patronage.sources.star import BALANCE_BINS, STAR_SCHEMAS

Span = tuple[str, str]


def _between(column: str, span: Span | None) -> str:
    if span is None:
        return "TRUE"
    return f"{column} >= TIMESTAMP '{span[0]}' AND {column} <= TIMESTAMP '{span[1]}'"


def _in(column: str, values) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"{column} IN ({listed})"


PEOPLE = """
people AS (
  SELECT c_custkey AS id, c_mktsegment AS traffic_source, r_name AS gender, c_acctbal AS age
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def shop_views(span: Span | None, item_time: str = "o_orderdate") -> str:
    return f"""WITH {PEOPLE},
usr AS (
  SELECT s.id, s.created_at, p.traffic_source, p.gender, p.age
  FROM (SELECT o_custkey AS id, min(o_orderdate) AS created_at FROM orders
        WHERE o_custkey IS NOT NULL GROUP BY 1) s
  LEFT JOIN people p ON p.id = s.id
  WHERE {_between("s.created_at", span)}
),
ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS status,
         o_orderdate AS created_at
  FROM orders WHERE {_between("o_orderdate", span)}
),
itm AS (
  SELECT l_orderkey AS order_id, o_custkey AS user_id, l_partkey AS product_id,
         o_orderstatus AS status, CAST(l_extendedprice AS DECIMAL(18,2)) AS sale_price,
         {item_time} AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE {_between(item_time, span)}
),
prd AS (
  SELECT p_partkey AS id, p_type AS category, p_brand AS brand, p_name AS name FROM part
)"""


def event_log() -> str:
    return f"""WITH {PEOPLE},
usr AS (
  SELECT s.id, s.created_at, p.traffic_source, p.gender, p.age
  FROM (SELECT user_id AS id, min(ts) AS created_at FROM events
        WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY 1) s
  LEFT JOIN people p ON p.id = s.id
),
ord AS (
  SELECT event_id AS order_id, user_id, 'F' AS status, ts AS created_at
  FROM events WHERE event_type = 'purchase'
),
itm AS (SELECT * FROM ord)"""


PERIOD = {
    "month": "CAST(date_trunc('month', created_at) AS DATE)",
    "week": "CAST(date_trunc('week', created_at) AS DATE)",
    "day": "CAST(created_at AS DATE)",
}
GAP = {
    "month": "date_diff('month', {a}, {b})",
    "week": "date_diff('day', {a}, {b}) // 7",
    "day": "date_diff('day', {a}, {b})",
}
MONDAY = "CAST(date_trunc('week', cohort) AS DATE)"
WEEK_OF_MONTH = f"((day({MONDAY}) - 1) // 7 + 1)"
SIZE = "' · N=' || format('{:,}', cohort_size)"
LABEL = {
    "month": f"strftime(cohort, '%Y-%m') || {SIZE}",
    "week": f"strftime(cohort, '%Y-%m') || ' W' || {WEEK_OF_MONTH} || ' ('"
    f" || strftime(cohort, '%G-W%V') || ')' || {SIZE}",
    "day": f"strftime(cohort, '%Y-%m-%d (%a') || ', W' || {WEEK_OF_MONTH} || ')' || {SIZE}",
}


def _gap(grain: str, a: str, b: str) -> str:
    return f"CAST({GAP[grain].format(a=a, b=b)} AS INTEGER)"


EXACT = "status = 'F'"
LOWER = "lower(status) = 'f'"
TRIM_LOWER = "lower(trim(status)) = 'f'"


def _cells(head: str, grain: str, rows: str = "itm", where: str = EXACT) -> str:
    return f"""{head},
act AS (SELECT user_id, {PERIOD[grain]} AS period FROM {rows}
        WHERE {where} AND user_id IS NOT NULL AND created_at IS NOT NULL),
fst AS (SELECT user_id, min(period) AS cohort FROM act GROUP BY user_id),
siz AS (SELECT cohort, count(*) AS cohort_size FROM fst GROUP BY cohort),
cel AS (
  SELECT cohort, {_gap(grain, "cohort", "period")} AS age,
         count(DISTINCT act.user_id) AS active_users
  FROM act JOIN fst ON act.user_id = fst.user_id GROUP BY 1, 2
)"""


def _sparse(head: str, **rows: str) -> str:
    return f"""{_cells(head, "month", **rows)}
SELECT cohort AS cohort_month, age AS age_m, active_users, cohort_size,
       round(active_users / cohort_size, 6) AS retention
FROM cel JOIN siz USING (cohort)"""


def _dense(head: str, grain: str, max_age: int, keep: str = "TRUE") -> str:
    week_index = ""
    if grain == "week":
        week_index = "CAST(date_diff('day', DATE '1970-01-05', cohort) // 7 AS INTEGER) AS week_index,"
    return f"""{_cells(head, grain, where=TRIM_LOWER)},
lst AS (SELECT max(period) AS last_period FROM act),
grd AS (
  SELECT siz.cohort, cohort_size, CAST(a.age AS INTEGER) AS age
  FROM siz, lst, range({max_age + 1}) a(age)
  WHERE {_gap(grain, "siz.cohort", "last_period")} >= a.age AND {keep}
)
SELECT cohort AS cohort_{grain}, {week_index} {LABEL[grain]} AS cohort_label, age AS age_{grain[0]},
       CAST(coalesce(active_users, 0) AS BIGINT) AS active_users, cohort_size,
       round(coalesce(active_users, 0) / cohort_size, 6) AS retention
FROM grd LEFT JOIN cel USING (cohort, age)"""


def _in_month(month: str, week: int | None = None) -> str:
    kept = f"strftime(cohort, '%Y-%m') = '{month}'"
    return kept if week is None else f"{kept} AND {WEEK_OF_MONTH} = {week}"


def _pivot(cells: str, grain: str, ages, label: bool) -> str:
    g = grain[0]
    keys = f"cohort_{grain}" + (", cohort_label" if label else "")
    columns = ", ".join(
        f"max(CASE WHEN age_{g} = {age} THEN retention END) AS {g}{age}" for age in ages
    )
    return f"SELECT {keys}, {columns} FROM ({cells}) GROUP BY {keys}"


def _repeat_monthly(head: str, year: int) -> str:
    return f"""{head},
act AS (SELECT DISTINCT user_id, {PERIOD["month"]} AS period FROM itm
        WHERE {TRIM_LOWER} AND user_id IS NOT NULL AND created_at IS NOT NULL),
mon AS (
  SELECT period AS order_month,
         count(*) FILTER (EXISTS (SELECT 1 FROM act e
                                  WHERE e.user_id = act.user_id AND e.period < act.period))
           AS returning_users,
         count(*) AS purchasers
  FROM act GROUP BY period HAVING year(period) = {year}
)"""


def _weekday_cells(head: str) -> str:
    return f"""{_cells(head, "day", where=LOWER)},
rpt AS (
  SELECT cohort, cohort + age AS repeat_day, active_users, cohort_size
  FROM cel JOIN siz USING (cohort) WHERE age >= 1
)"""


def _weekday(head: str, day: str) -> str:
    return f"""{_weekday_cells(head)},
wkd AS (
  SELECT isodow({day}) - 1 AS weekday, sum(active_users) AS repeats, sum(cohort_size) AS exposed
  FROM rpt GROUP BY 1
)
SELECT CAST(d.i AS INTEGER) AS weekday,
       ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][d.i + 1] AS weekday_name,
       CAST(coalesce(repeats, 0) AS BIGINT) AS repeat_orders,
       CAST(coalesce(exposed, 0) AS BIGINT) AS exposure,
       round(repeats / exposed, 6) AS repeat_rate
FROM range(7) d(i) LEFT JOIN wkd ON wkd.weekday = d.i
WHERE EXISTS (SELECT 1 FROM rpt)"""


def _bin_case(column: str) -> str:
    edges = BALANCE_BINS.edges
    arms = " ".join(
        f"WHEN {column} >= {low} AND {column} < {high} THEN '{name}'"
        for low, high, name in zip(edges, edges[1:], BALANCE_BINS.labels)
    )
    return f"CASE {arms} END"


def _scope(head: str, chosen: dict | None = None) -> str:
    c = chosen or {}
    orders = "status = 'F'" + (f" AND {_in('month(created_at)', c['months'])}" if c else "")
    group = _bin_case("age")
    users = f"({group}) IS NOT NULL AND traffic_source IS NOT NULL"
    products = "category IS NOT NULL AND brand IS NOT NULL"
    if c:
        users = (
            f"{_in(f'({group})', c['age_groups'])} AND gender = '{c['gender']}'"
            f" AND {_in('traffic_source', c['traffic_sources'])}"
        )
        products = f"{_in('category', c['categories'])} AND {_in('brand', c['brands'])}"
    return f"""{head},
sus AS (SELECT * FROM usr WHERE {users}),
sco AS (
  SELECT i.*, p.category, p.name
  FROM itm i
  JOIN (SELECT order_id FROM ord WHERE {orders}) o ON o.order_id = i.order_id
  JOIN (SELECT * FROM prd WHERE {products}) p ON p.id = i.product_id
  JOIN sus ON sus.id = i.user_id
)"""


def _kpis(scope: str) -> str:
    return f"""{scope},
tot AS (
  SELECT CAST(coalesce(sum(sale_price), 0) AS DOUBLE) AS total_revenue,
         count(DISTINCT order_id) AS total_orders,
         count(DISTINCT user_id) AS purchasing_users,
         (SELECT count(DISTINCT id) FROM sus) AS total_users
  FROM sco
)
SELECT *,
       CASE WHEN total_users > 0 THEN round(total_revenue / total_users, 6) ELSE 0 END AS arpu,
       CASE WHEN purchasing_users > 0 THEN round(total_revenue / purchasing_users, 6)
            ELSE 0 END AS arppu,
       CASE WHEN total_orders > 0 THEN round(total_revenue / total_orders, 6) ELSE 0 END AS aov
FROM tot"""


def _revenue_monthly(scope: str) -> str:
    return f"""{scope}
SELECT {PERIOD["month"]} AS "month", CAST(sum(sale_price) AS DOUBLE) AS revenue
FROM sco WHERE created_at IS NOT NULL GROUP BY 1"""


def _top_share(scope: str) -> str:
    return f"""{scope},
rev AS (SELECT user_id, sum(sale_price) AS revenue FROM sco GROUP BY 1),
cnt AS (SELECT count(*) AS n, greatest(1, ceil(count(*) * 0.1::DOUBLE)) AS k FROM rev),
rnk AS (SELECT revenue, row_number() OVER (ORDER BY revenue DESC, user_id) AS pos FROM rev),
tot AS (
  SELECT CAST(max(CASE WHEN n > 0 THEN k ELSE 0 END) AS BIGINT) AS top_count,
         CAST(coalesce(sum(revenue) FILTER (pos <= k), 0) AS DOUBLE) AS top_revenue,
         CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_revenue
  FROM cnt LEFT JOIN rnk ON TRUE
)
SELECT *, CASE WHEN total_revenue > 0
               THEN round(top_revenue / total_revenue * 100, 6) ELSE 0 END AS share_pct
FROM tot"""


def _histogram(bins: int) -> str:
    """Bins over the CTE `vals(v)`."""
    return f"""
lim AS (
  SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi,
         avg(v) AS mean
  FROM vals
),
edg AS (
  SELECT CAST(i + 1 AS INTEGER) AS bin, lo + i * ((hi - lo) / {bins}) AS lo,
         CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS hi,
         i = {bins - 1} AS is_last, mean
  FROM lim, range({bins}) r(i) WHERE lo IS NOT NULL
)
SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(v) AS users, round(mean, 6) AS mean
FROM edg LEFT JOIN vals ON v >= lo AND (v < hi OR (is_last AND v <= hi))
GROUP BY ALL"""


def _revenue_histogram(scope: str) -> str:
    return f"""{scope},
vals AS (SELECT CAST(sum(sale_price) AS DOUBLE) AS v FROM sco GROUP BY user_id),
{_histogram(15)}"""


def _topk(scope: str, key: str, value: str, name: str) -> str:
    return rf"""{scope}
SELECT {key}, round({value}, 6) AS {name},
       CASE WHEN length({key}) <= 25 THEN {key}
            ELSE regexp_extract({key}, '^(.{{0,21}}\S) ', 1) || '...' END AS label
FROM sco WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY {name} DESC, {key} LIMIT 10"""


MONEY = "CAST(sum(sale_price) AS DOUBLE)"
REVENUE = ("category", MONEY, "revenue")
AOV = ("category", f"{MONEY} / count(DISTINCT order_id)", "aov")
PRODUCT = ("name", MONEY, "revenue")


def _activation(head: str, chosen: dict | None = None) -> str:
    kept = "traffic_source IS NOT NULL"
    if chosen:
        kept = (
            f"{_in('traffic_source', chosen['traffic_sources'])} AND gender = '{chosen['gender']}'"
            f" AND {_in('month(created_at)', chosen['months'])}"
        )
    return f"""{head},
ppl AS (SELECT * FROM usr WHERE {kept}),
buy AS (SELECT * FROM ord WHERE status = 'F' AND created_at IS NOT NULL),
fbt AS (SELECT user_id, min(created_at) AS first_at FROM buy GROUP BY user_id),
mrk AS (SELECT ppl.*, fbt.first_at, {_bin_case("age")} AS age_group
        FROM ppl LEFT JOIN fbt ON fbt.user_id = ppl.id),
fst AS (
  SELECT user_id, order_id, created_at
  FROM buy WHERE user_id IN (SELECT id FROM ppl)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, order_id) = 1
),
ttf AS (
  SELECT CAST(floor((epoch_us(first_at) - epoch_us(created_at)) / 86400000000.0) AS BIGINT) AS v
  FROM mrk WHERE first_at IS NOT NULL
)"""


RATE = "round(count(first_at) / count(DISTINCT id) * 100, 6) AS activation_rate"
COUNTED = f"count(DISTINCT id) AS total_users, count(first_at) AS activated_users, {RATE}"


def _activation_kpis(activation: str) -> str:
    return f"""{activation}
SELECT count(DISTINCT id) AS total_users,
       (SELECT count(DISTINCT user_id) FROM buy WHERE user_id IN (SELECT id FROM ppl))
         AS activated_users,
       round((SELECT count(DISTINCT user_id) FROM buy WHERE user_id IN (SELECT id FROM ppl))
             / count(DISTINCT id) * 100, 6) AS activation_rate
FROM ppl"""


def _ttfp_summary(activation: str) -> str:
    return f"""{activation}
SELECT round(avg(v), 6) AS mean_days, round(quantile_cont(v, 0.5), 6) AS median_days,
       round(quantile_cont(v, 0.25), 6) AS q25_days,
       round(quantile_cont(v, 0.75), 6) AS q75_days, max(v) AS max_days
FROM ttf"""


def _ttfp_histogram(activation: str) -> str:
    return f"{activation}, vals AS (SELECT CAST(v AS DOUBLE) AS v FROM ttf), {_histogram(20)}"


def _activation_monthly(activation: str) -> str:
    return f"""{activation}
SELECT {PERIOD["month"]} AS signup_month, {COUNTED} FROM mrk GROUP BY 1"""


def _activation_by(activation: str, dimension: str) -> str:
    return f"""{activation}
SELECT {dimension}, {COUNTED} FROM mrk WHERE {dimension} IS NOT NULL GROUP BY 1"""


BIN_NAMES = ", ".join(f"('{name}')" for name in BALANCE_BINS.labels)


def _by_age_group(activation: str) -> str:
    return f"""{activation}
SELECT b.age_group, {COUNTED}
FROM (VALUES {BIN_NAMES}) b(age_group) LEFT JOIN mrk ON mrk.age_group = b.age_group
GROUP BY 1"""


def _age_by_month(activation: str) -> str:
    return f"""{activation},
dat AS (SELECT *, {PERIOD["month"]} AS signup_month FROM mrk),
grd AS (SELECT signup_month, age_group
        FROM (SELECT DISTINCT signup_month FROM dat), (VALUES {BIN_NAMES}) b(age_group))
SELECT grd.signup_month, grd.age_group, count(DISTINCT id) AS total_users,
       CASE WHEN count(id) > 0 THEN count(first_at) END AS activated_users, {RATE}
FROM grd LEFT JOIN dat ON dat.signup_month = grd.signup_month AND dat.age_group = grd.age_group
GROUP BY 1, 2"""


def _age_pivot(activation: str) -> str:
    columns = ", ".join(
        f"max(CASE WHEN age_group = '{name}' THEN activation_rate END) AS \"{name}\""
        for name in BALANCE_BINS.labels
    )
    return f"SELECT signup_month, {columns} FROM ({_age_by_month(activation)}) GROUP BY 1"


def _first_order(activation: str) -> str:
    return f"{activation} SELECT user_id, order_id, created_at FROM fst"


def _first_items(activation: str) -> str:
    return f"""{activation},
fit AS (
  SELECT i.user_id, i.sale_price, p.category
  FROM itm i JOIN fst ON fst.order_id = i.order_id LEFT JOIN prd p ON p.id = i.product_id
  WHERE p.category IS NOT NULL
)"""


def _basket(activation: str) -> str:
    return f"""{_first_items(activation)}
SELECT round(CAST(sum(sale_price) AS DOUBLE) / count(sale_price), 6) AS mean_price,
       round(quantile_cont(CAST(sale_price AS DOUBLE), 0.5), 6) AS median_price
FROM fit"""


def _first_categories(activation: str) -> str:
    return f"""{_first_items(activation)}
SELECT category, count(DISTINCT user_id) AS users
FROM fit GROUP BY category ORDER BY users DESC, category LIMIT 5"""


def _frequency(rows: str) -> str:
    return f"""{rows}
SELECT num_orders, count(*) AS users
FROM (SELECT user_id, count(DISTINCT order_id) AS num_orders FROM src
      WHERE user_id IS NOT NULL GROUP BY user_id)
GROUP BY num_orders"""


def _complete_items(head: str) -> str:
    return f"{head}, src AS (SELECT * FROM itm WHERE status = 'F')"


def _sample(n: int) -> str:
    return f"""
SELECT event_id AS id, user_id, event_type, ts AS created_at, round("value", 6) AS "value"
FROM events WHERE year(ts) = 2024 ORDER BY md5(event_id || '|42'), event_id LIMIT {n}"""


RAW_EVENTS = """
raw AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE WHEN event_id % 11 > 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
         ' ' || CAST(CAST("value" AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CAST(CAST("value" AS DECIMAL(18,1)) AS VARCHAR) || 'e-1' AS ratio,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,
         CASE WHEN event_id % 40 = 0 THEN 'unknown' ELSE CAST(event_id % 7 AS VARCHAR) END AS score,
         CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS note,
         CAST(NULL AS VARCHAR) AS remark
  FROM events
)"""
RAW_COLUMNS = ("id", "user_id", "amount", "ratio", "created_at", "score", "note", "remark")


def _inferred() -> str:
    """Each column's values by what they look like, told one by one."""
    long = " UNION ALL ".join(
        f"SELECT {place} AS place, '{name}' AS column_name, trim({name}) AS x FROM raw"
        for place, name in enumerate(RAW_COLUMNS)
    )
    names = ", ".join(f"({place}, '{name}')" for place, name in enumerate(RAW_COLUMNS))
    number = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
    return f"""WITH {RAW_EVENTS},
val AS ({long}),
cnt AS (
  SELECT place, count(*) AS total, count(x) AS known,
         count(*) FILTER (regexp_full_match(x, '[+-]?[0-9]{{1,18}}')) AS longs,
         count(*) FILTER (regexp_full_match(x, '{number}')) AS decimals,
         count(*) FILTER (regexp_full_match(x, '{number}([eE][+-]?[0-9]{{1,3}})?')) AS doubles,
         count(*) FILTER (regexp_full_match(x, '[0-9]{{4}}-.*')
                          AND try_cast(x AS TIMESTAMP) IS NOT NULL) AS times,
         max(CASE WHEN regexp_full_match(x, '{number}')
             THEN length(ltrim(split_part(ltrim(x, '+-'), '.', 1), '0')) END) AS whole,
         max(CASE WHEN regexp_full_match(x, '{number}') THEN length(split_part(x, '.', 2)) END)
           AS behind
  FROM val GROUP BY place
),
typ AS (
  SELECT *, CASE WHEN known = 0 THEN 'string'
              WHEN longs >= known * {1 - TOLERANCE} THEN 'bigint'
              WHEN decimals >= known * {1 - TOLERANCE}
                THEN format('decimal({{}},{{}})', whole + behind, behind)
              WHEN doubles >= known * {1 - TOLERANCE} THEN 'double'
              WHEN times >= known * {1 - TOLERANCE} THEN 'timestamp' ELSE 'string' END AS type
  FROM cnt
)
SELECT CAST(n.place AS INTEGER) AS place, column_name, coalesce(type, 'string') AS type,
       coalesce(total - known, 0) AS nulls,
       coalesce(known - CASE type WHEN 'bigint' THEN longs WHEN 'double' THEN doubles
         WHEN 'timestamp' THEN times WHEN 'string' THEN known ELSE decimals END, 0) AS rejects
FROM (VALUES {names}) n(place, column_name) LEFT JOIN typ ON typ.place = n.place"""


TYPED_EVENTS = f"""WITH {RAW_EVENTS}
SELECT CAST(created_at AS DATE) AS "day", count(id) AS ids,
       CAST(sum(CAST(user_id AS BIGINT)) AS BIGINT) AS user_sum,
       CAST(sum(CAST(trim(amount) AS DECIMAL(18,2))) AS DOUBLE) AS amount,
       round(sum(CAST(ratio AS DOUBLE)), 6) AS ratio,
       CAST(sum(TRY_CAST(score AS BIGINT)) AS BIGINT) AS score, count(note) AS notes
FROM raw GROUP BY 1"""


def _ttfp_sketch(activation: str) -> str:
    """Per month and part, the values at the ranks ceil(k * n / points)."""
    ranges = []
    for name, (first, last) in SKETCHED.items():
        kept = " AND ".join(
            f"signup_month {sign} DATE '{day}'"
            for sign, day in ((">=", first), ("<=", last))
            if day
        )
        ranges.append(f"SELECT '{name}' AS months, * FROM pts WHERE {kept or 'TRUE'}")

    def quantile(q: float) -> str:
        low = f"list_extract(vs, CAST(floor((len(vs) - 1) * {q}) AS BIGINT) + 1)"
        high = f"list_extract(vs, CAST(ceil((len(vs) - 1) * {q}) AS BIGINT) + 1)"
        share = f"((len(vs) - 1) * {q} - floor((len(vs) - 1) * {q}))"
        return f"round(CAST({low} AS DOUBLE) + ({high} - {low}) * {share}, 6)"

    return f"""{activation},
dys AS (
  SELECT {PERIOD["month"]} AS signup_month, id % {SPLITS} AS part,
         CAST(floor((epoch_us(first_at) - epoch_us(created_at)) / 86400000000.0) AS BIGINT) AS v
  FROM mrk WHERE first_at IS NOT NULL
),
rnk AS (
  SELECT signup_month, part, v, row_number() OVER (PARTITION BY signup_month, part ORDER BY v) AS r,
         count(*) OVER (PARTITION BY signup_month, part) AS n
  FROM dys
),
pts AS (
  SELECT signup_month, part, n, v,
         (k * n + {POINTS - 1}) // {POINTS} - ((k - 1) * n + {POINTS - 1}) // {POINTS} AS weight
  FROM rnk, range(1, {POINTS + 1}) p(k) WHERE r = (k * n + {POINTS - 1}) // {POINTS}
),
rng AS ({" UNION ALL ".join(ranges)}),
lst AS (SELECT months, list(v ORDER BY v) AS vs FROM rng, range(weight) t(i) GROUP BY months),
siz AS (SELECT DISTINCT months, signup_month, part, n FROM rng),
err AS (SELECT months, sum(CASE WHEN n > {POINTS} THEN ceil(n / {POINTS}) + 1 ELSE 0 END) AS off
        FROM siz GROUP BY months)
SELECT m.months, CAST(len(vs) AS BIGINT) AS buyers, {quantile(0.5)} AS median_days,
       {quantile(0.25)} AS q25_days, {quantile(0.75)} AS q75_days, {quantile(1.0)} AS max_days,
       CAST(coalesce(off, 0) AS BIGINT) AS rank_error
FROM (VALUES {", ".join(f"('{name}')" for name in SKETCHED)}) m(months)
LEFT JOIN lst ON lst.months = m.months LEFT JOIN err ON err.months = m.months"""


def _bitmap_rates(activation: str) -> str:
    by = {
        "everyone": "''",
        "gender": "gender",
        "traffic_source": "traffic_source",
        "age_group": "age_group",
        "signup_month": "strftime(created_at, '%Y-%m')",
    }
    each = " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, {value} AS \"value\", {COUNTED} FROM mrk"
        f" WHERE {value} IS NOT NULL GROUP BY {value} HAVING count(*) > 0"
        for name, value in by.items()
    )
    return f"{activation} {each}"


def _bitmap_choice(activation: str) -> str:
    sources = _in("traffic_source", ACTIVATION_CHOICE["traffic_sources"])
    return f"""{activation}
SELECT strftime(created_at, '%Y-%m') AS signup_month, age_group, {COUNTED}
FROM mrk
WHERE {sources} AND gender = '{ACTIVATION_CHOICE["gender"]}' AND created_at IS NOT NULL
  AND age_group IS NOT NULL
GROUP BY 1, 2"""


def _first_known(activation: str) -> str:
    order = "ORDER BY o_orderdate, o_orderkey"
    return f"""{activation},
gap AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 7 > 4 THEN o_totalprice END AS total
        FROM orders
        WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL
          AND o_custkey IN (SELECT id FROM ppl))
SELECT o_custkey AS user_id, first(o_orderkey {order}) AS order_id,
       first(priority {order}) FILTER (WHERE priority IS NOT NULL) AS priority,
       round(first(total {order}) FILTER (WHERE total IS NOT NULL), 6) AS total
FROM gap GROUP BY o_custkey"""


def _cube_by_value(head: str) -> str:
    dimensions = ("order_month", "status", "gender", "age_group", "traffic_source", "category", "brand")
    each = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, sale_price, order_id, user_id FROM fct"
        for d in dimensions
    )
    return f"""{head},
fct AS (
  SELECT month(o.created_at) AS order_month, o.status, u.gender, {_bin_case("u.age")} AS age_group,
         u.traffic_source, p.category, p.brand, i.sale_price, i.order_id, i.user_id
  FROM itm i
  JOIN ord o ON o.order_id = i.order_id
  JOIN usr u ON u.id = i.user_id
  JOIN prd p ON p.id = i.product_id
  WHERE o.status IS NOT NULL AND ({_bin_case("u.age")}) IS NOT NULL
    AND u.traffic_source IS NOT NULL AND p.category IS NOT NULL AND p.brand IS NOT NULL
)
SELECT dimension, value, CAST(coalesce(sum(sale_price), 0) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS buyers
FROM ({each}) WHERE value IS NOT NULL GROUP BY 1, 2"""


def _cube_report(shop: str) -> str:
    figures = (
        ("month", """strftime("month", '%Y-%m')""", "revenue", _revenue_monthly),
        ("category", "category", "revenue", lambda scope: _topk(scope, *REVENUE)),
        ("order value", "category", "aov", lambda scope: _topk(scope, *AOV)),
        ("product", "name", "revenue", lambda scope: _topk(scope, *PRODUCT)),
    )
    return " UNION ALL ".join(
        f"SELECT '{choice}' AS choice, '{figure}' AS figure, {key} AS key, {amount} AS amount"
        f" FROM ({sql(_scope(shop, chosen))})"
        for choice, chosen in (("none", None), ("some", CHOSEN))
        for figure, key, amount, sql in figures
    )


def _sizes() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS "rows",
CAST((SELECT count(*) FROM (DESCRIBE {name})) AS INTEGER) AS cols"""
        for name in TABLES
    )


def _stored_bounds() -> str:
    found = []
    for name in TABLES:
        for field in STAR_SCHEMAS[name].split(", "):
            column, kind = field.split()
            if kind in ("int", "bigint", "timestamp_ntz"):
                value = f"epoch_us({column})" if kind == "timestamp_ntz" else column
                found.append(f"""SELECT '{name}' AS table_name, '{column}' AS column_name,
       count(*) AS "rows", count({column}) AS known, CAST(min({value}) AS BIGINT) AS least,
       CAST(max({value}) AS BIGINT) AS greatest FROM {name}""")
    return " UNION ALL ".join(found)


def oracle_sql() -> dict[str, str]:
    shop, year, log = shop_views(None), shop_views(YEAR_1995), event_log()
    scope, people = _scope(shop), _activation(shop)
    category = "(SELECT i.* FROM itm i JOIN prd p ON p.id = i.product_id WHERE category = 'MEDIUM')"
    month_dense = _dense(shop, "month", 12)
    week_month = _dense(shop, "week", 12, _in_month("1995-02"))
    sql = {
        "purchase_frequency": _frequency(_complete_items(shop)),
        "purchase_counts_by_user": f"""{shop}
SELECT user_id, count(DISTINCT order_id) AS num_orders
FROM itm WHERE status IN ('F', 'O', 'P') AND user_id IS NOT NULL GROUP BY user_id""",
        "cohort_monthly_sparse": _sparse(shop),
        "cohort_monthly_by_category": _sparse(shop, rows=category),
        "cohort_monthly_dense": month_dense,
        "cohort_weekly_dense": _dense(shop, "week", 52, _in_month("1995-02", 2)),
        "cohort_weekly_month": week_month,
        "cohort_daily_dense": _dense(shop, "day", 60, _in_month("1995-02")),
        "cohort_daily_dense_w5": _dense(shop, "day", 60, _in_month("1995-02", 5)),
        "cohort_monthly_from": _sparse(
            shop, where=f"{EXACT} AND created_at >= TIMESTAMP '1996-03-01'"
        ),
        "cohort_pivot": f"""WITH cll AS ({_sparse(shop)}),
grd AS (SELECT cohort_month, a.age AS age_m
        FROM (SELECT DISTINCT cohort_month FROM cll),
             range((SELECT max(age_m) FROM cll) + 1) a(age))
SELECT cohort_month,
       string_agg(coalesce(printf('%.6f', retention), '-'), ' ' ORDER BY age_m) AS retention
FROM grd LEFT JOIN cll USING (cohort_month, age_m) GROUP BY cohort_month""",
        "cohort_pivot_dense": _pivot(month_dense, "month", range(1, 13), True),
        "cohort_pivot_weekly": _pivot(week_month, "week", range(1, 13), True),
        "cohort_pivot_daily": _pivot(
            _dense(shop, "day", 30, _in_month("2001-07")), "day", range(1, 31), True
        ),
        "repeat_purchaser_monthly": f"""{_repeat_monthly(shop, 1996)}
SELECT *, round(returning_users / purchasers, 6) AS rate_raw,
       round_even(returning_users / purchasers, 3) AS repeat_purchaser_rate
FROM mon""",
        "repeat_rate_by_season": f"""{_repeat_monthly(shop, 1996)}
SELECT CASE WHEN month(order_month) >= 11 THEN 'nov_dec' ELSE 'jan_oct' END AS season,
       CAST(sum(returning_users) AS BIGINT) AS returning_users,
       CAST(sum(purchasers) AS BIGINT) AS purchasers,
       round(sum(returning_users) / sum(purchasers) * 100, 6) AS rate_pct
FROM mon GROUP BY 1""",
        "repeat_by_order_weekday": _weekday(shop, "repeat_day"),
        "revenue_scope": f"""{scope}
SELECT order_id, user_id, product_id, CAST(sale_price AS DOUBLE) AS sale_price, created_at
FROM sco""",
        "revenue_kpis": _kpis(scope),
        "revenue_monthly": _revenue_monthly(scope),
        "order_frequency": _frequency(f"{scope}, src AS (SELECT * FROM sco)"),
        "top_decile_revenue_share": _top_share(scope),
        "customer_revenue_histogram": _revenue_histogram(scope),
        "category_revenue_topk": _topk(scope, *REVENUE),
        "category_aov_topk": _topk(scope, *AOV),
        "product_revenue_topk": _topk(scope, *PRODUCT),
        "activation_kpis": _activation_kpis(people),
        "ttfp_summary": _ttfp_summary(people),
        "activation_monthly": _activation_monthly(people),
        "activation_by_gender": _activation_by(people, "gender"),
        "activation_by_channel": _activation_by(people, "traffic_source"),
        "activation_by_age_group": _by_age_group(people),
        "activation_age_by_month": _age_by_month(people),
        "activation_age_pivot": _age_pivot(people),
        "first_order": _first_order(people),
        "first_order_basket_value": _basket(people),
        "first_order_top_categories": _first_categories(people),
        "ttfp_histogram": _ttfp_histogram(people),
        "status_counts": f"""{shop}
SELECT status, count(*) AS orders FROM ord WHERE status IS NOT NULL GROUP BY status""",
        "dimension_values": f"""{shop}
SELECT DISTINCT 'status' AS dimension, status AS "value" FROM ord WHERE status IS NOT NULL
UNION ALL SELECT DISTINCT 'traffic_source', traffic_source FROM usr
  WHERE traffic_source IS NOT NULL
UNION ALL SELECT DISTINCT 'category', category FROM prd WHERE category IS NOT NULL
UNION ALL SELECT DISTINCT 'brand', brand FROM prd WHERE brand IS NOT NULL""",
        "available_months": f"""{shop}
SELECT DISTINCT {PERIOD["month"]} AS "month", strftime(created_at, '%Y-%m') AS label
FROM itm WHERE created_at IS NOT NULL""",
        "cohort_months_weekly": f"""{shop}
SELECT DISTINCT CAST(date_trunc('month', date_trunc('week', created_at)) AS DATE) AS "month",
       strftime(date_trunc('week', created_at), '%Y-%m') AS label
FROM itm WHERE created_at IS NOT NULL""",
        "date_bounds": f"""{shop}
SELECT CAST(min(created_at) AS DATE) AS first_day, CAST(max(created_at) AS DATE) AS last_day
FROM itm""",
    }
    sql |= {
        "ttfp_sketch": _ttfp_sketch(people),
        "inferred_types": _inferred(),
        "typed_events": TYPED_EVENTS,
        "events_through_csv": f"""WITH {RAW_EVENTS}
SELECT CAST(id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, note AS event_type,
       CAST(created_at AS TIMESTAMP) AS created_at
FROM raw""",
        "first_rows": "SELECT * FROM region LIMIT 5",
        "revenue_report": f"""{scope}
SELECT 'revenue' AS figure,
       coalesce((SELECT CAST(sum(sale_price) AS DOUBLE) FROM sco), 0) AS amount
UNION ALL SELECT strftime("month", '%Y-%m'), revenue FROM ({_revenue_monthly(scope)})
UNION ALL SELECT category, revenue FROM ({_topk(scope, *REVENUE)})""",
        "revenue_cube": _cube_by_value(shop),
        "revenue_cube_kpis": _kpis(_scope(shop, CHOSEN)),
        "revenue_cube_report": _cube_report(shop),
        "cohort_monthly_steps": _sparse(shop),
        "cohort_monthly_clustered": month_dense,
        "activation_bitmaps": _bitmap_rates(people),
        "activation_bitmaps_chosen": _bitmap_choice(people),
        "first_known_per_user": _first_known(people),
        "activation_monthly_clustered": _activation_monthly(people),
    }
    scope, people = _scope(year), _activation(year)
    sql |= {
        "purchase_frequency_1995": _frequency(_complete_items(year)),
        "cohort_monthly_dense_1995": _dense(year, "month", 12),
        "revenue_kpis_1995": _kpis(scope),
        "revenue_monthly_1995": _revenue_monthly(scope),
        "top_decile_revenue_share_1995": _top_share(scope),
        "customer_revenue_histogram_1995": _revenue_histogram(scope),
        "activation_kpis_1995": _activation_kpis(people),
        "ttfp_summary_1995": _ttfp_summary(people),
        "activation_monthly_1995": _activation_monthly(people),
        "activation_by_gender_1995": _activation_by(people, "gender"),
        "activation_by_channel_1995": _activation_by(people, "traffic_source"),
        "activation_by_age_group_1995": _by_age_group(people),
        "activation_age_by_month_1995": _age_by_month(people),
        "first_order_1995": _first_order(people),
        "first_order_basket_value_1995": _basket(people),
        "first_order_top_categories_1995": _first_categories(people),
        "ttfp_histogram_1995": _ttfp_histogram(people),
    }
    buyers = _activation(log)
    sql |= {
        "cohort_weekly_dense_evt": _dense(log, "week", 12, _in_month("2024-01")),
        "cohort_daily_dense_evt": _dense(log, "day", 30, _in_month("2024-01")),
        "repeat_by_order_weekday_evt": _weekday(log, "repeat_day"),
        "repeat_by_cohort_weekday": _weekday(log, "cohort"),
        "repeat_weekday_vs_weekend": f"""{_weekday_cells(log)}
SELECT CASE WHEN isodow(repeat_day) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_group,
       CAST(sum(active_users) AS BIGINT) AS repeaters, CAST(sum(cohort_size) AS BIGINT) AS exposure,
       round_even(sum(active_users) / sum(cohort_size) * 100, 3) AS rate_pct
FROM rpt GROUP BY 1""",
        "ttfp_summary_evt": _ttfp_summary(buyers),
        "ttfp_histogram_evt": _ttfp_histogram(buyers),
        "sample_events": _sample(SAMPLE_ROWS),
        "sample_events_50k": _sample(SAMPLE_ROWS_LARGE),
        "revenue_monthly_shipped": _revenue_monthly(
            _scope(shop_views(None, "l_shipdate"))
        ),
        "revenue_kpis_chosen": _kpis(_scope(shop, CHOSEN)),
        "activation_kpis_chosen": _activation_kpis(_activation(shop, ACTIVATION_CHOICE)),
        "revenue_kpis_1996": _kpis(_scope(shop_views(YEAR_1996))),
        "table_summary": _sizes(),
        "table_summary_stored": _sizes(),
        "stored_bounds": _stored_bounds(),
        "date_bounds_stored": """SELECT CAST(min(o_orderdate) AS DATE) AS first_day,
       CAST(max(o_orderdate) AS DATE) AS last_day FROM orders""",
    }
    return sql
