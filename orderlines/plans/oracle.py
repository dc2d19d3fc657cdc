"""DuckDB SQL that recomputes the registered queries from the same tables."""

from __future__ import annotations

from orderlines.functions.segments import SHORT_STRATEGIES, STRATEGIES
from orderlines.schema import WEEKDAY_NAMES

ORACLE_SQL: dict[str, str] = {}

# Half-up division of cents by a whole quantity to four decimals, in integers.
UNIT_PRICE = (
    "CAST((2 * CAST(price * 100 AS BIGINT) * 100 + qty) // (2 * qty) AS DOUBLE) / 10000"
)

LINES = f"""
base AS (
  SELECT l.*, o.*, p_name, p_type, p_retailprice,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(l_quantity AS BIGINT) AS qty,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS cut
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS BIGINT) AS line_no,
         o_orderdate AS order_time, CAST(o_orderdate AS DATE) AS date,
         CAST(hour(o_orderdate) AS INTEGER) AS hour,
         CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
         CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS platform,
         p_name AS product_name, p_type AS category,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
         CAST({UNIT_PRICE} AS DECIMAL(18,4)) AS unit_price,
         CAST(price AS DECIMAL(18,4)) AS total_amount, cut AS discount,
         CAST(price - cut AS DECIMAL(18,4)) AS actual_amount,
         CAST(CASE WHEN l_returnflag = 'R' THEN price - cut ELSE 0 END AS DECIMAL(18,4)) AS refund_amount,
         CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'completed' END AS status
  FROM base
)"""

EVENTS = """
lines AS (
  SELECT CAST(event_id AS VARCHAR) AS order_id, ts AS order_time, CAST(ts AS DATE) AS date,
         CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
         CAST(user_id AS VARCHAR) AS customer_id, event_type AS platform,
         CAST(value AS DECIMAL(18,4)) AS actual_amount
  FROM events
)"""

RAW = """
base AS (
  SELECT l.*, o.*, p_name, p_type, p_retailprice,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS cut
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
once AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE o_orderdate END AS order_time,
         CAST(o_custkey AS VARCHAR) AS customer_id, p_name AS product_name,
         CASE WHEN l_partkey % 40 <> 5 THEN p_type END AS category,
         CASE WHEN l_suppkey % 10 <> 3 THEN CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(18,4)) END AS quantity,
         CAST(CASE WHEN l_partkey % 30 = 2 THEN NULL WHEN l_partkey % 50 = 1 THEN -CAST(p_retailprice AS DECIMAL(18,2))
                   ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS DECIMAL(18,4)) AS raw_price,
         CAST(price AS DECIMAL(18,4)) AS total_amount,
         CASE WHEN l_linenumber <> 5 THEN cut END AS discount,
         CASE WHEN l_linenumber <> 6 THEN CAST(price - cut AS DECIMAL(18,4)) END AS actual_amount,
         CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'completed' END AS status,
         o_orderpriority AS platform, l_linenumber
  FROM base
),
raw AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE l_linenumber = 1),
coerced AS (
  SELECT order_id, order_time, CAST(order_time AS DATE) AS date, CAST(hour(order_time) AS INTEGER) AS hour,
         CAST(isodow(order_time) - 1 AS INTEGER) AS weekday,
         CASE WHEN isodow(order_time) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         customer_id, product_name, category, quantity,
         CASE WHEN raw_price < 0 THEN 0 ELSE raw_price END AS unit_price, raw_price,
         total_amount, discount, actual_amount, status, platform
  FROM raw
)"""

DISTINCT_COLUMNS = (
    "order_id, order_time, date, hour, weekday, is_weekend, customer_id, product_name, category, "
    "quantity, unit_price, total_amount, discount, actual_amount, status"
)


def filled(platform: str = "platform") -> str:
    columns = DISTINCT_COLUMNS + (", platform" if platform == "platform" else "")
    return f"""
dedup AS (SELECT {columns}, count(*) AS copies FROM coerced GROUP BY ALL),
lines AS (
  SELECT order_id, order_time, date, hour, weekday, is_weekend, customer_id, product_name,
         coalesce(category, '其他') AS category, coalesce(quantity, 1) AS quantity,
         coalesce(unit_price, CAST(CAST((2 * CAST(total_amount * 10000 AS BIGINT)
           + CAST(coalesce(quantity, 1) AS BIGINT)) // (2 * CAST(coalesce(quantity, 1) AS BIGINT)) AS DOUBLE)
           / 10000 AS DECIMAL(18,4))) AS unit_price,
         total_amount, coalesce(discount, 0) AS discount, coalesce(actual_amount, total_amount) AS actual_amount,
         CAST(0 AS DECIMAL(18,4)) AS refund_amount, status, {platform} AS platform, copies
  FROM dedup
)"""


def star(query: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([LINES, *ctes]) + query


def event(query: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([EVENTS, *ctes]) + query


def raw(query: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([RAW, *ctes]) + query


def ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)"


def mean(value: str) -> str:
    return ratio(f"sum({value})", f"nullif(count({value}), 0)")


def cents(value: str) -> str:
    """Half-up rounding of the printed digits of a double."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,16)), 2) AS DOUBLE)"


def sums(*columns: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in columns)


def day(column: str = "date") -> str:
    return f"strftime({column}, '%Y-%m-%d') AS date"


ALL_MONEY = ("quantity", "unit_price", "total_amount", "discount", "actual_amount", "refund_amount")

# ---- sources and sinks ----

ORACLE_SQL["s1_csv_scan"] = star(
    f" SELECT '品类' || category AS category, count(*) AS n, {sums('quantity', 'total_amount')} FROM lines GROUP BY 1"
)
ORACLE_SQL["s2_typed_csv_scan"] = star(
    f" SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS n, {sums(*ALL_MONEY)} FROM lines GROUP BY 1"
)
_VALUE = "CAST(sum(actual_amount) AS DOUBLE)"
ORACLE_SQL["s3_format_dispatch"] = event(
    f""" SELECT platform, count(*) AS n, CAST(count(*) AS DOUBLE) AS quantity, {_VALUE} AS unit_price,
         {_VALUE} AS total_amount, 0.0::DOUBLE AS discount, {_VALUE} AS actual_amount, 0.0::DOUBLE AS refund_amount
         FROM lines GROUP BY 1"""
)
ORACLE_SQL["s5_export_union"] = star(
    """ SELECT platform, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS total_amount,
        CASE WHEN platform NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CAST(sum(discount) AS DOUBLE) END AS discount
        FROM lines GROUP BY platform"""
)

PROFILES = """,
    used AS (
      SELECT customer_id, platform, min(order_time) AS first FROM lines GROUP BY ALL
    ),
    platforms AS (
      SELECT customer_id, string_agg(platform, '|' ORDER BY first, platform) AS platforms_used FROM used GROUP BY ALL
    ),
    favourites AS (
      SELECT customer_id, first(category ORDER BY n DESC, category) AS favorite_category
      FROM (SELECT customer_id, category, count(*) AS n FROM lines GROUP BY ALL) GROUP BY ALL
    ),
    totals AS (
      SELECT customer_id, count(DISTINCT order_id) AS total_orders, CAST(sum(actual_amount) AS DOUBLE) AS total_spent,
             CAST(sum(actual_amount) AS DOUBLE) / count(actual_amount) AS avg_order_value,
             min(order_time) AS first_order, max(order_time) AS last_order
      FROM lines GROUP BY ALL
    )"""
PROFILE_JOINS = "FROM totals JOIN favourites USING (customer_id) JOIN platforms USING (customer_id)"

ORACLE_SQL["s4_csv_sink"] = star(
    PROFILES
    + f""" SELECT customer_id, total_orders, total_spent, strftime(last_order, '%Y-%m-%d') AS last_order,
           favorite_category, platforms_used {PROFILE_JOINS}"""
)
ORACLE_SQL["a13_customer_profiles"] = star(
    PROFILES
    + f""" SELECT customer_id, total_orders, total_spent, avg_order_value,
           strftime(first_order, '%Y-%m-%d %H:%M:%S') AS first_order,
           strftime(last_order, '%Y-%m-%d %H:%M:%S') AS last_order, favorite_category, platforms_used {PROFILE_JOINS}"""
)

# ---- normalization and cleaning ----

ORACLE_SQL["p1_alias_rename"] = raw(
    f""" SELECT category, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS quantity,
         CAST(sum(raw_price) AS DOUBLE) AS unit_price, {sums('total_amount', 'discount', 'actual_amount')}
         FROM raw GROUP BY category"""
)
ORACLE_SQL["p2_required_fields"] = raw(
    """ SELECT missing, (SELECT count(*) FROM raw) AS rows
        FROM (VALUES ('product_name'), ('total_amount')) AS m(missing)"""
)
ORACLE_SQL["p3_time_parts"] = raw(
    f""" SELECT {day()}, hour, weekday, is_weekend, count(*) AS n,
         CAST(sum(CASE WHEN order_time IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_times
         FROM coerced GROUP BY ALL"""
)
ORACLE_SQL["p4_numeric_clamp"] = raw(
    """ SELECT product_name, CAST(sum(CASE WHEN raw_price < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_prices,
        CAST(min(unit_price) AS DOUBLE) AS least_price, CAST(sum(unit_price) AS DOUBLE) AS prices,
        count(quantity) AS quantities FROM coerced GROUP BY product_name"""
)
ORACLE_SQL["p5_default_platform"] = raw(
    f""" SELECT '未知平台' AS platform, count(*) AS n,
         {sums('quantity', 'unit_price', 'total_amount', 'discount', 'actual_amount')} FROM coerced"""
)
ORACLE_SQL["p6_dedup"] = raw(
    f""", dedup AS (SELECT {DISTINCT_COLUMNS}, platform, count(*) AS copies FROM coerced GROUP BY ALL)
        SELECT category, count(*) AS clean_rows, CAST(sum(copies) AS BIGINT) AS raw_rows FROM dedup GROUP BY category"""
)
ORACLE_SQL["p7_null_fill"] = raw(
    f" SELECT category, count(*) AS n, {sums(*ALL_MONEY)} FROM lines GROUP BY category", filled()
)
ORACLE_SQL["p8_derived_fill"] = raw(
    """ SELECT order_id, product_name, CAST(total_amount AS DOUBLE) AS total_amount, CAST(quantity AS DOUBLE) AS quantity,
        round(CAST(unit_price AS DOUBLE), 4) AS unit_price, CAST(actual_amount AS DOUBLE) AS actual_amount FROM lines""",
    filled(),
)
ORACLE_SQL["p9_derived_amount"] = raw(
    f""", dedup AS (
          SELECT {DISTINCT_COLUMNS.replace(', actual_amount', '')}, platform FROM coerced GROUP BY ALL
        ),
        lines AS (
          SELECT platform, coalesce(quantity, 1) AS quantity,
                 coalesce(unit_price, CAST(CAST((2 * CAST(total_amount * 10000 AS BIGINT)
                   + CAST(coalesce(quantity, 1) AS BIGINT)) // (2 * CAST(coalesce(quantity, 1) AS BIGINT)) AS DOUBLE)
                   / 10000 AS DECIMAL(18,4))) AS unit_price,
                 total_amount, coalesce(discount, 0) AS discount,
                 CAST(total_amount - coalesce(discount, 0) AS DECIMAL(18,4)) AS actual_amount,
                 CAST(0 AS DECIMAL(18,4)) AS refund_amount
          FROM dedup
        )
        SELECT platform, count(*) AS n, {sums(*ALL_MONEY)} FROM lines GROUP BY platform"""
)
ORACLE_SQL["p10_default_status"] = raw(
    f""", dedup AS (
          SELECT {DISTINCT_COLUMNS.replace(', customer_id', '').replace(', status', '')}, platform FROM coerced GROUP BY ALL
        )
        SELECT 'completed' AS status, count(*) AS n, count(*) AS by_order, count(DISTINCT order_id) AS customers FROM dedup"""
)
BOUNDS = """
    totals AS (SELECT order_id, CAST(sum(actual_amount) AS DECIMAL(28,4)) AS amount FROM lines GROUP BY order_id),
    quarters AS (
      SELECT quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3 FROM totals
    ),
    bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM quarters),
    outlying AS (
      SELECT order_id, amount, lower_bound, upper_bound FROM totals, bounds
      WHERE CAST(amount AS DOUBLE) < lower_bound OR CAST(amount AS DOUBLE) > upper_bound
    )"""
ORACLE_SQL["p11_clean_lines"] = raw(
    """ SELECT order_id, strftime(order_time, '%Y-%m-%d %H:%M:%S') AS order_time, strftime(date, '%Y-%m-%d') AS date,
        hour, weekday, is_weekend, customer_id, platform, product_name, category,
        CAST(quantity AS DOUBLE) AS quantity, round(CAST(unit_price AS DOUBLE), 4) AS unit_price,
        CAST(total_amount AS DOUBLE) AS total_amount, CAST(discount AS DOUBLE) AS discount,
        CAST(actual_amount AS DOUBLE) AS actual_amount, CAST(refund_amount AS DOUBLE) AS refund_amount, status,
        order_id IN (SELECT order_id FROM outlying) AS is_anomaly FROM lines""",
    filled(),
    BOUNDS,
)
ORACLE_SQL["p12_predicates"] = star(
    f""" SELECT platform, count(*) AS n, {sums(*ALL_MONEY)} FROM lines
         WHERE status = 'refunded' AND actual_amount < 50000 AND platform IN ('1-URGENT', '2-HIGH')
           AND order_time IS NOT NULL GROUP BY platform"""
)

# ---- quality ----

ORACLE_SQL["q1_order_outliers"] = star(
    """ SELECT order_id, CAST(amount AS DOUBLE) AS amount, round(lower_bound, 2) AS lower_bound,
        round(upper_bound, 2) AS upper_bound FROM outlying""",
    BOUNDS,
)
ORACLE_SQL["q2_quantity_outliers"] = event(
    """ SELECT CAST(floor(cut) AS BIGINT) AS threshold, count(*) FILTER (WHERE CAST(actual_amount AS DOUBLE) > cut) AS n_outliers
        FROM lines, (SELECT quantile_cont(CAST(actual_amount AS DOUBLE), 0.99) AS cut FROM lines) GROUP BY cut"""
)
ORACLE_SQL["q3_quality_report"] = raw(
    """ SELECT 'raw_rows' AS check, NULL AS column, CAST((SELECT count(*) FROM raw) AS VARCHAR) AS value
        UNION ALL SELECT 'clean_rows', NULL, CAST((SELECT count(*) FROM lines) AS VARCHAR)
        UNION ALL SELECT 'duplicates_removed', NULL,
          CAST((SELECT count(*) FROM raw) - (SELECT count(*) FROM lines) AS VARCHAR)
        UNION ALL SELECT 'total_orders', NULL, CAST((SELECT count(DISTINCT order_id) FROM lines) AS VARCHAR)
        UNION ALL SELECT 'missing_customer_id', 'customer_id', '0'
        UNION ALL SELECT 'missing_platform', 'platform', '1'
        UNION ALL SELECT 'first_date', 'date', (SELECT strftime(min(date), '%Y-%m-%d') FROM lines)
        UNION ALL SELECT 'last_date', 'date', (SELECT strftime(max(date), '%Y-%m-%d') FROM lines)
        UNION ALL SELECT 'bad_times', 'order_time', CAST((SELECT count(*) FROM raw WHERE order_time IS NULL) AS VARCHAR)
        UNION ALL SELECT 'negative_values', 'quantity', CAST((SELECT count(*) FROM raw WHERE quantity < 0) AS VARCHAR)
        UNION ALL SELECT 'negative_values', 'unit_price', CAST((SELECT count(*) FROM raw WHERE raw_price < 0) AS VARCHAR)
        UNION ALL SELECT 'negative_values', 'total_amount', CAST((SELECT count(*) FROM raw WHERE total_amount < 0) AS VARCHAR)
        UNION ALL SELECT 'negative_values', 'discount', CAST((SELECT count(*) FROM raw WHERE discount < 0) AS VARCHAR)
        UNION ALL SELECT 'negative_values', 'actual_amount', CAST((SELECT count(*) FROM raw WHERE actual_amount < 0) AS VARCHAR)
        UNION ALL SELECT 'amount_lower_bound', 'actual_amount',
          CAST(CAST(round(lower_bound, 2) AS DECIMAL(28,2)) AS VARCHAR) FROM bounds
        UNION ALL SELECT 'amount_upper_bound', 'actual_amount',
          CAST(CAST(round(upper_bound, 2) AS DECIMAL(28,2)) AS VARCHAR) FROM bounds
        UNION ALL SELECT 'amount_outliers', 'actual_amount', CAST((SELECT count(*) FROM outlying) AS VARCHAR)
        UNION ALL SELECT 'quantity_threshold', 'quantity',
          CAST(CAST(floor(quantile_cont(CAST(quantity AS DOUBLE), 0.99)) AS BIGINT) AS VARCHAR) FROM lines
        UNION ALL SELECT 'quantity_outliers', 'quantity', CAST((SELECT count(*) FROM lines WHERE CAST(quantity AS DOUBLE) >
          (SELECT quantile_cont(CAST(quantity AS DOUBLE), 0.99) FROM lines)) AS VARCHAR)""",
    filled("'未知平台'"),
    BOUNDS,
)

_TEXT_COLUMNS = {
    0: "order_id", 6: "customer_id", 7: "platform", 14: "status", 15: "product_name", 16: "category",
}
_TEXT_ALSO = {
    1: ("order_time", "strftime(order_time, '%Y-%m-%d %H:%M:%S')", "timestamp_ntz"),
    2: ("date", "strftime(date, '%Y-%m-%d')", "date"),
}
_NUMBER_COLUMNS = {
    3: ("hour", "int"), 4: ("weekday", "int"), 5: ("is_weekend", "int"), 8: ("quantity", "decimal(18,4)"),
    9: ("unit_price", "decimal(18,4)"), 10: ("total_amount", "decimal(18,4)"), 11: ("discount", "decimal(18,4)"),
    12: ("actual_amount", "decimal(18,4)"), 13: ("refund_amount", "decimal(18,4)"),
}


def _text_profile(position: int, column: str, value: str, dtype: str = "string") -> str:
    counts = f"(SELECT {value} AS v, count(*) AS n FROM lines GROUP BY 1)"
    return f"""SELECT {position} AS position, '{column}' AS column, CAST(sum(n) AS BIGINT) AS count,
      count(v) AS unique, first(v ORDER BY n DESC, v) AS top, max(n) AS freq,
      CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
      CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75,
      CAST(NULL AS DOUBLE) AS max, CAST(0 AS BIGINT) AS missing, CAST(0 AS DOUBLE) AS missing_pct, count(v) AS nunique,
      '{dtype}' AS dtype FROM {counts}"""


def _number_profile(position: int, column: str, dtype: str) -> str:
    value = f"CAST({column} AS DOUBLE)"
    quartiles = ", ".join(
        f"round(quantile_cont({value}, {p}), 4) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)
    )
    return f"""SELECT {position} AS position, '{column}' AS column, count({column}) AS count,
      CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
      round({mean(column)}, 4) AS mean, round(stddev_samp({value}), 4) AS std, CAST(min({column}) AS DOUBLE) AS min,
      {quartiles}, CAST(max({column}) AS DOUBLE) AS max, CAST(0 AS BIGINT) AS missing, CAST(0 AS DOUBLE) AS missing_pct,
      count(DISTINCT {column}) AS nunique, '{dtype}' AS dtype FROM lines"""


ORACLE_SQL["q4_profile"] = star(
    " "
    + " UNION ALL ".join(
        [_text_profile(i, c, c) for i, c in _TEXT_COLUMNS.items()]
        + [_text_profile(i, *c) for i, c in _TEXT_ALSO.items()]
        + [_number_profile(i, *c) for i, c in _NUMBER_COLUMNS.items()]
    )
)
ORACLE_SQL["j2_flagged_lines"] = star(
    """ SELECT order_id IN (SELECT order_id FROM outlying) AS is_anomaly, platform, count(*) AS n,
        CAST(sum(actual_amount) AS DOUBLE) AS amount FROM lines GROUP BY 1, 2""",
    BOUNDS,
)

# ---- metrics ----

ROLLUP = """
    rollup AS (
      SELECT order_id, first(date ORDER BY line_no, date) AS date,
             first(customer_id ORDER BY line_no, customer_id) AS customer_id,
             first(platform ORDER BY line_no, platform) AS platform,
             first(status ORDER BY line_no, status) AS status,
             sum(total_amount) AS total_amount, sum(actual_amount) AS actual_amount, sum(discount) AS discount,
             sum(refund_amount) AS refund_amount, count(product_name) AS item_count
      FROM lines GROUP BY order_id
    ),
    daily AS (
      SELECT date, sum(actual_amount) AS revenue, count(*) AS orders FROM rollup GROUP BY date
    ),
    ranked_days AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS back FROM daily),
    latest AS (
      SELECT strftime(t.date, '%Y-%m-%d') AS today, CAST(t.revenue AS DOUBLE) AS today_revenue, t.orders AS today_orders,
             CAST(y.revenue AS DOUBLE) AS yesterday_revenue,
             round((CAST(t.revenue AS DOUBLE) - CAST(y.revenue AS DOUBLE)) / (CAST(y.revenue AS DOUBLE) + 0.01) * 100, 2) AS dod_change
      FROM ranked_days t, ranked_days y WHERE t.back = 1 AND y.back = 2
    ),
    spread AS (
      SELECT avg(CAST(revenue AS DOUBLE)) AS m, stddev_pop(CAST(revenue AS DOUBLE)) AS s FROM daily
    ),
    stats AS (
      SELECT round(avg(CAST(revenue AS DOUBLE)), 2) AS mean, round(median(CAST(revenue AS DOUBLE)), 2) AS median,
             round(stddev_samp(CAST(revenue AS DOUBLE)), 2) AS std,
             round(avg(pow((CAST(revenue AS DOUBLE) - m) / s, 3)), 2) AS skewness,
             round(avg(pow((CAST(revenue AS DOUBLE) - m) / s, 4)) - 3, 2) AS kurtosis
      FROM daily, spread
    ),
    overview AS (
      SELECT round(CAST(sum(actual_amount) AS DOUBLE), 2) AS total_revenue, count(*) AS total_orders,
             round(CAST(sum(actual_amount) AS DOUBLE) / count(*), 2) AS avg_order_value,
             round(CAST(count(*) FILTER (WHERE status = 'refunded') AS DOUBLE) / count(*) * 100, 2) AS refund_rate,
             round(CAST(sum(discount) AS DOUBLE) / (CAST(sum(total_amount) AS DOUBLE) + 0.01) * 100, 2) AS avg_discount_rate,
             strftime(min(date), '%Y-%m-%d') || ' ~ ' || strftime(max(date), '%Y-%m-%d') AS date_range,
             count(DISTINCT customer_id) AS n_customers
      FROM rollup
    )"""
ORACLE_SQL["a1_order_rollup"] = star(
    f""" SELECT order_id, {day()}, customer_id, platform, status, CAST(total_amount AS DOUBLE) AS total_amount,
         CAST(actual_amount AS DOUBLE) AS actual_amount, CAST(discount AS DOUBLE) AS discount,
         CAST(refund_amount AS DOUBLE) AS refund_amount, item_count FROM rollup""",
    ROLLUP,
)
ORACLE_SQL["a2_overview"] = star(" SELECT * FROM overview", ROLLUP)
ORACLE_SQL["a3_latest_day"] = star(" SELECT * FROM latest", ROLLUP)
ORACLE_SQL["a4_revenue_distribution"] = star(" SELECT * FROM stats", ROLLUP)

RANKING = """
    everything AS (SELECT count(DISTINCT order_id) AS orders, CAST(sum(actual_amount) AS DOUBLE) AS revenue FROM lines),
    ranking AS (
      SELECT product_name, first(category ORDER BY line_no, category) AS category,
             CAST(sum(quantity) AS DOUBLE) AS total_sold, CAST(sum(actual_amount) AS DOUBLE) AS total_revenue,
             count(DISTINCT order_id) AS order_count,
             CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_price,
             count(*) FILTER (WHERE status = 'refunded') AS refund_count,
             round(CAST(count(DISTINCT order_id) AS DOUBLE) / any_value(orders) * 100, 2) AS order_penetration,
             round(CAST(sum(actual_amount) AS DOUBLE) / any_value(revenue) * 100, 2) AS revenue_share
      FROM lines, everything GROUP BY product_name
    ),
    slow AS (
      SELECT * FROM ranking ORDER BY total_sold, product_name DESC
      LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM ranking)
    )"""
ORACLE_SQL["a5_product_ranking"] = star(" SELECT * FROM ranking", RANKING)
ORACLE_SQL["a7_slow_movers"] = star(" SELECT product_name, total_sold, order_count FROM slow", RANKING)
ORACLE_SQL["k2_top_products"] = star(
    " SELECT product_name, total_sold FROM ranking ORDER BY total_sold DESC, product_name LIMIT 15", RANKING
)
ORACLE_SQL["a6_category_breakdown"] = star(
    """ SELECT category, CAST(sum(actual_amount) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS order_count,
        count(DISTINCT product_name) AS product_count,
        round(CAST(sum(actual_amount) AS DOUBLE) / any_value(revenue) * 100, 2) AS revenue_share
        FROM lines, everything GROUP BY category""",
    RANKING,
)
ORACLE_SQL["a11_category_features"] = star(
    f""" SELECT category, CAST(sum(actual_amount) AS DOUBLE) AS total_sales,
         round(CAST(sum(actual_amount) AS DOUBLE) / any_value(revenue) * 100, 1) AS sales_pct,
         count(DISTINCT order_id) AS total_orders, {mean('unit_price')} AS avg_price,
         {mean('discount')} AS avg_discount FROM lines, everything GROUP BY category""",
    RANKING,
)
ORACLE_SQL["a8_platform_comparison"] = star(
    """ SELECT platform, count(DISTINCT order_id) AS total_orders, CAST(sum(actual_amount) AS DOUBLE) AS total_revenue,
        round(CAST(sum(actual_amount) AS DOUBLE) / count(DISTINCT order_id), 2) AS avg_order_value,
        round(CAST(count(*) FILTER (WHERE status = 'refunded') AS DOUBLE) / count(*) * 100, 2) AS refund_rate,
        count(DISTINCT customer_id) AS unique_customers,
        round(CAST(sum(actual_amount) AS DOUBLE) / any_value(revenue) * 100, 2) AS revenue_share
        FROM lines, everything GROUP BY platform""",
    RANKING,
)

TREND = """
    days AS (
      SELECT date, CAST(sum(actual_amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders,
             count(DISTINCT customer_id) AS customers FROM lines GROUP BY date
    ),
    trend AS (
      SELECT *, lag(revenue) OVER (ORDER BY date) AS prev_revenue,
             avg(revenue) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7 FROM days
    )"""
ORACLE_SQL["a9_daily_trend"] = star(
    f""" SELECT {day()}, revenue, orders, customers, prev_revenue,
         round((revenue - prev_revenue) / nullif(prev_revenue, 0) * 100, 2) AS dod_pct, round(ma7, 6) AS ma7 FROM trend""",
    TREND,
)
ORACLE_SQL["a10_daily_features"] = star(
    f""", d AS (
          SELECT date, CAST(sum(actual_amount) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders,
                 CAST(sum(actual_amount) AS DOUBLE) / count(DISTINCT order_id) AS avg_order_value,
                 count(DISTINCT customer_id) AS total_customers,
                 CAST(count(*) FILTER (WHERE status = 'refunded') AS DOUBLE) / count(*) AS refund_rate,
                 CAST(sum(discount) AS DOUBLE) / (CAST(sum(total_amount) AS DOUBLE) + 0.01) AS discount_rate
          FROM lines GROUP BY date
        )
        SELECT {day()}, total_revenue, total_orders, avg_order_value, total_customers,
               refund_rate, discount_rate,
               CAST(isodow(date) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day_of_month,
               CAST(weekofyear(date) AS INTEGER) AS week_of_year,
               round(avg(total_revenue) OVER w, 6) AS revenue_ma7, round(avg(total_orders) OVER w, 6) AS orders_ma7
        FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
)
HOURLY = """
    cells AS (SELECT date, weekday, hour, count(DISTINCT order_id) AS n FROM lines GROUP BY ALL),
    hourly AS (SELECT weekday, hour, avg(n) AS mean_orders FROM cells GROUP BY ALL)"""
ORACLE_SQL["a12_hourly_heatmap"] = event(
    " SELECT CASE weekday "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(WEEKDAY_NAMES))
    + " END AS weekday_name, "
    + ", ".join(
        f"round(coalesce(max(mean_orders) FILTER (WHERE hour = {hour}), 0), 4) AS h{hour:02d}" for hour in range(24)
    )
    + " FROM hourly GROUP BY weekday",
    HOURLY,
)
ORACLE_SQL["k5_orders_by_hour"] = event(
    " SELECT weekday, hour, round(mean_orders, 6) AS mean_orders FROM hourly", HOURLY
)
ORACLE_SQL["a14_distinct_counts"] = star(
    """ SELECT category, count(DISTINCT order_id) AS n_order_id, count(DISTINCT customer_id) AS n_customer_id,
        count(DISTINCT product_name) AS n_product_name FROM lines GROUP BY category"""
)
ORACLE_SQL["a14_period_counts"] = star(
    """ SELECT category, year(date) || '-Q' || quarter(date) AS period, count(DISTINCT order_id) AS n_order_id,
        count(DISTINCT customer_id) AS n_customer_id, true AS sketches_close FROM lines GROUP BY ALL"""
)
ORACLE_SQL["a15_value_counts"] = star(" SELECT product_name, count(*) AS n FROM lines GROUP BY product_name")
ORACLE_SQL["k4_ordered_dates"] = star(f" SELECT DISTINCT {day()} FROM lines")

# ---- daily series and lags ----

SERIES = """
    days AS (
      SELECT platform AS series, date, CAST(sum(actual_amount) AS DOUBLE) AS revenue FROM lines GROUP BY ALL
    ),
    lagged AS (
      SELECT *, CAST(row_number() OVER s - 1 AS INTEGER) AS day_num, count(*) OVER (PARTITION BY series) AS n_days,
             lag(revenue, 1) OVER s AS lag_1, lag(revenue, 2) OVER s AS lag_2, lag(revenue, 3) OVER s AS lag_3,
             lag(revenue, 7) OVER s AS lag_7,
             round(avg(revenue) OVER b, 6) AS rolling_mean_7, round(stddev_samp(revenue) OVER b, 6) AS rolling_std_7
      FROM days
      WINDOW s AS (PARTITION BY series ORDER BY date),
             b AS (PARTITION BY series ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
    ),
    features AS (SELECT * FROM lagged WHERE day_num >= 7)"""
ORACLE_SQL["w1_previous_day"] = event(
    f""" SELECT series AS platform, {day()}, revenue, lag_1 AS prev_revenue,
         round((revenue - lag_1) / nullif(lag_1, 0) * 100, 2) AS dod_pct FROM lagged""",
    SERIES,
)
ORACLE_SQL["w2_trailing_mean"] = event(
    f""" SELECT series AS platform, {day()},
         round(avg(revenue) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7
         FROM days""",
    SERIES,
)
ORACLE_SQL["w3_lags"] = event(f" SELECT series, {day()}, lag_1, lag_2, lag_3, lag_7 FROM features", SERIES)
ORACLE_SQL["w4_rolling_stats"] = event(
    f" SELECT series, {day()}, rolling_mean_7, rolling_std_7 FROM features", SERIES
)
ORACLE_SQL["w5_row_ordinal"] = event(f" SELECT series, {day()}, day_num FROM features", SERIES)
ORACLE_SQL["t1_lag_features"] = event(
    f""" SELECT series, {day()}, revenue, n_days, day_num, CAST(month(date) AS INTEGER) AS month,
         CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(day(date) AS INTEGER) AS day_of_month,
         lag_1, lag_2, lag_3, lag_7, rolling_mean_7, rolling_std_7, """
    + ", ".join(f"CASE WHEN isodow(date) = {d + 1} THEN 1 ELSE 0 END AS wd_{d}" for d in range(7))
    + " FROM features",
    SERIES,
)
WEEKLY = f"""
    weekly AS (
      SELECT platform || '/' || CAST(weekofyear(date) AS VARCHAR) AS series, date,
             CAST(sum(actual_amount) AS DOUBLE) AS revenue FROM lines GROUP BY ALL
    ),
    recent AS (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM weekly
    ),
    levels AS (SELECT series, max(date) AS last_date, avg(revenue) AS level FROM recent WHERE back <= 7 GROUP BY series),
    ahead AS (
      SELECT series, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date, step, {cents('level')} AS predicted,
             {cents('level * 0.85')} AS lower_bound, {cents('level * 1.15')} AS upper_bound
      FROM levels, range(1, 15) AS r(step)
    )"""
ORACLE_SQL["t4_short_history"] = event(
    f" SELECT series, {day()}, predicted, lower_bound, upper_bound FROM ahead", WEEKLY
)
ORACLE_SQL["t5_short_summary"] = event(
    """ SELECT series, round(sum(predicted), 2) AS total, round(avg(predicted), 2) AS mean,
        round(avg(lower_bound), 2) AS mean_lower, round(avg(upper_bound), 2) AS mean_upper,
        CASE WHEN arg_max(predicted, step) > arg_min(predicted, step) * 1.05 THEN '上升 ↗'
             WHEN arg_max(predicted, step) < arg_min(predicted, step) * 0.95 THEN '下降 ↘'
             ELSE '平稳 →' END AS trend
        FROM ahead WHERE step <= 7 GROUP BY series""",
    WEEKLY,
)

# ---- customers ----


def _edge(k: int) -> str:
    place = f"(n - 1) * {k}"
    return f"""(
      SELECT 3 * x.recency + ({place}) % 3 * (coalesce(y.recency, x.recency) - x.recency)
             - CASE WHEN ({place}) % 3 = 0 AND w.recency < x.recency THEN 1 ELSE 0 END
      FROM size, ordered x LEFT JOIN ordered y ON y.i = x.i + 1 LEFT JOIN ordered w ON w.i = x.i - 1
      WHERE x.i = ({place}) // 3
    )"""


def _third(rank: str) -> str:
    return f"CASE WHEN 3 * ({rank} - 1) < n - 1 THEN 1 WHEN 3 * ({rank} - 1) < 2 * (n - 1) THEN 2 ELSE 3 END"


def _case(value: str, texts: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


# The rule as patterns of the three scores, stated here once more so that it checks the library's.
_SEGMENT = """CASE
    WHEN regexp_full_match(rfm, '33[23]') THEN '重要价值' WHEN regexp_full_match(rfm, '32[23]') THEN '潜力客户'
    WHEN regexp_full_match(rfm, '[23]1[23]') THEN '重要保持' WHEN rfm = '311' THEN '新客户'
    WHEN regexp_full_match(rfm, '1[23][23]') THEN '重要挽留' WHEN regexp_full_match(rfm, '1[23]1') THEN '一般价值'
    WHEN regexp_full_match(rfm, '11[23]') THEN '流失高价值' WHEN rfm = '111' THEN '流失客户'
    ELSE '普通客户' END"""
RFM = f"""
    customers AS (
      SELECT customer_id,
             CAST(floor((SELECT epoch_us(max(order_time) + INTERVAL 1 DAY) FROM lines) / 86400000000
                        - epoch_us(max(order_time)) / 86400000000) AS INTEGER) AS recency,
             count(DISTINCT order_id) AS frequency, sum(actual_amount) AS monetary
      FROM lines GROUP BY customer_id
    ),
    size AS (SELECT count(*) AS n FROM customers),
    ordered AS (SELECT recency, row_number() OVER (ORDER BY recency) - 1 AS i FROM customers),
    edges AS (SELECT {_edge(1)} AS e1, {_edge(2)} AS e2),
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS f_rank,
             row_number() OVER (ORDER BY monetary, customer_id) AS m_rank FROM customers
    ),
    scored AS (
      SELECT customer_id, recency, frequency, monetary, f_rank,
             CASE WHEN 3 * recency <= e1 THEN 3 WHEN 3 * recency <= e2 THEN 2 ELSE 1 END AS R_score,
             {_third('f_rank')} AS F_score, {_third('m_rank')} AS M_score
      FROM ranked, size, edges
    ),
    segments AS (
      SELECT *, R_score + F_score + M_score AS RFM_score, {_SEGMENT} AS segment
      FROM (SELECT *, CAST(R_score AS VARCHAR) || F_score || M_score AS rfm FROM scored)
    )"""
ORACLE_SQL["f1_rfm_values"] = star(
    " SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary FROM customers", RFM
)
ORACLE_SQL["f2_tercile_scores"] = star(" SELECT customer_id, R_score, F_score, M_score FROM scored", RFM)
ORACLE_SQL["w6_rank"] = star(" SELECT frequency, customer_id, f_rank - 1 AS position FROM ranked", RFM)
ORACLE_SQL["w7_tercile_bins"] = star(
    " SELECT R_score, F_score, M_score, count(*) AS customers FROM scored GROUP BY ALL", RFM
)
ORACLE_SQL["f3_segments"] = star(
    """ SELECT customer_id, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, R_score, F_score, M_score,
        RFM_score, segment FROM segments""",
    RFM,
)
ORACLE_SQL["f4_strategies"] = star(
    f" SELECT customer_id, segment, {_case('segment', STRATEGIES)} AS strategy FROM segments", RFM
)
ORACLE_SQL["f5_segment_distribution"] = star(
    f""" SELECT segment, count(*) AS customers,
         round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM segments) * 100, 1) AS share,
         {_case('segment', SHORT_STRATEGIES)} AS strategy FROM segments GROUP BY segment""",
    RFM,
)
_RISK = "'重要挽留', '流失高价值'"
ORACLE_SQL["f6_at_risk"] = star(
    f" SELECT customer_id, segment, CAST(monetary AS DOUBLE) AS monetary FROM segments WHERE segment IN ({_RISK})", RFM
)
ORACLE_SQL["c1_standardized"] = star(
    " SELECT customer_id, "
    + ", ".join(
        f"""round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM customers))
            / (SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM customers), 6) AS z_{c}"""
        for c in ("recency", "frequency", "monetary")
    )
    + " FROM customers",
    RFM,
)

def kmeans(*ks: int) -> str:
    """The rounds of the clustering, for each number of clusters from ten starts, and the best of these."""
    far = "list_transform({0}, lambda c: (r - c[1]) * (r - c[1]) + (f - c[2]) * (f - c[2]) + (m - c[3]) * (m - c[3]))"
    z = ", ".join(
        f"""CAST(round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM customers))
             / (SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM customers) * 1000000) AS BIGINT) AS {c[0]}"""
        for c in ("recency", "frequency", "monetary")
    )
    return f"""
    points AS (SELECT customer_id, recency, frequency, monetary, {z} FROM customers),
    grid AS (SELECT r, f, m, count(*) AS n FROM points GROUP BY ALL),
    started AS (
      SELECT s, r, f, m, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || s || ':' || r || ':' || f || ':' || m)) AS place
      FROM grid, (SELECT unnest(range(10)) AS s)
    ),
    fits AS (
      SELECT 0 AS round, k, s, list([CAST(r AS DOUBLE), CAST(f AS DOUBLE), CAST(m AS DOUBLE)] ORDER BY place) AS centres, false AS rest
      FROM started, (SELECT unnest({list(ks)}) AS k) WHERE place <= k GROUP BY k, s
      UNION ALL
      SELECT round + 1, k, s, centres, list_sum(list_transform(list_zip(centres, was), lambda p: pow(p[1][1] - p[2][1], 2)
               + pow(p[1][2] - p[2][2], 2) + pow(p[1][3] - p[2][3], 2))) <= 1e-4 * 1e12
      FROM (SELECT round, k, s, list(coalesce(moved, old) ORDER BY number) AS centres, list(old ORDER BY number) AS was FROM (
        SELECT u.round, u.k, u.s, t.number, u.centres[t.number] AS old, w.moved
        FROM fits u, (SELECT unnest(range(1, {max(ks) + 1})) AS number) t LEFT JOIN (
          SELECT k, s, number, [CAST(sum(n * r) AS DOUBLE) / CAST(sum(n) AS DOUBLE), CAST(sum(n * f) AS DOUBLE) / CAST(sum(n) AS DOUBLE),
                                CAST(sum(n * m) AS DOUBLE) / CAST(sum(n) AS DOUBLE)] AS moved
          FROM (
            SELECT k, s, r, f, m, n, list_position(far, list_min(far)) AS number
            FROM (SELECT k, s, r, f, m, n, {far.format("centres")} AS far FROM grid, fits)
          ) GROUP BY k, s, number
        ) w ON w.k = u.k AND w.s = u.s AND w.number = t.number
        WHERE u.round < 50 AND NOT u.rest AND t.number <= len(u.centres)
      ) GROUP BY round, k, s)
    ),
    final AS (SELECT k, s, arg_max(centres, round) AS centres FROM fits GROUP BY k, s),
    costs AS (
      SELECT k, s, round(sum(n * list_min(far)) / 1e12, 6) AS cost
      FROM (SELECT k, s, n, {far.format("centres")} AS far FROM grid, final) GROUP BY k, s
    ),
    best AS (
      SELECT k, cost, list_sort(centres) AS centres FROM costs JOIN final USING (k, s)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, s) = 1
    ),
    labelled AS (
      SELECT customer_id, recency, frequency, monetary, CAST(list_position(far, list_min(far)) - 1 AS INTEGER) AS cluster
      FROM (SELECT p.*, {far.format("centres")} AS far FROM points p, best WHERE k = 4)
    )"""


ORACLE_SQL["c2_clusters"] = star(" SELECT customer_id, cluster FROM labelled", RFM, kmeans(4))
ORACLE_SQL["c3_cluster_profiles"] = star(
    """ SELECT cluster, recency, frequency, monetary, count, '聚类' || (cluster + 1)
          || ': R' || CASE WHEN recency < (SELECT median(recency) FROM customers) THEN '近' ELSE '远' END
          || '/F' || CASE WHEN frequency > (SELECT median(frequency) FROM customers) THEN '高' ELSE '低' END
          || '/M' || CASE WHEN monetary > (SELECT median(CAST(monetary AS DOUBLE)) FROM customers) THEN '高' ELSE '低' END AS profile,
          (SELECT round(cost, 2) FROM best WHERE k = 4) AS inertia
        FROM (SELECT cluster, round(avg(CAST(recency AS DOUBLE)), 1) AS recency, round(avg(CAST(frequency AS DOUBLE)), 1) AS frequency,
                     round(avg(CAST(monetary AS DOUBLE)), 1) AS monetary, count(*) AS count FROM labelled GROUP BY cluster)""",
    RFM,
    kmeans(4),
)
ORACLE_SQL["c4_elbow"] = star(" SELECT CAST(k AS INTEGER) AS k, round(cost, 2) AS inertia FROM best", RFM, kmeans(*range(1, 9)))
ORACLE_SQL["k6_segments_by_cluster"] = star(
    " SELECT segment, "
    + ", ".join(f'count(*) FILTER (cluster = {k}) AS "{k}"' for k in range(4))
    + " FROM segments JOIN labelled USING (customer_id) GROUP BY segment",
    RFM,
    kmeans(4),
)
# Agreement over the pairs of customers, and over the shares of cells and margins.
ORACLE_SQL["c5_segment_agreement"] = star(
    """, labels AS (SELECT segment AS a, cluster AS b FROM segments JOIN labelled USING (customer_id)),
        cells AS (SELECT a, b, count(*) AS n FROM labels GROUP BY ALL),
        per_a AS (SELECT a, sum(n) AS n, max(n) AS top FROM cells GROUP BY a),
        per_b AS (SELECT b, sum(n) AS n, max(n) AS top FROM cells GROUP BY b),
        whole AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM cells),
        pairs AS (
          SELECT (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM cells) AS ab, (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM per_a) AS a,
                 (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM per_b) AS b, n * (n - 1) / 2 AS every FROM whole
        ),
        bits AS (
          SELECT (SELECT sum(c.n / w.n * ln(c.n * w.n / (per_a.n * per_b.n))) FROM cells c JOIN per_a USING (a) JOIN per_b USING (b), whole w) AS mi,
                 (SELECT -sum(p.n / w.n * ln(p.n / w.n)) FROM per_a p, whole w) AS ha, (SELECT -sum(p.n / w.n * ln(p.n / w.n)) FROM per_b p, whole w) AS hb
        ),
        measures AS (
          SELECT 'rand' AS measure, (every - a - b + 2 * ab) / every AS value FROM pairs
          UNION ALL SELECT 'adjusted_rand', (ab - a * b / every) / ((a + b) / 2 - a * b / every) FROM pairs
          UNION ALL SELECT 'mutual_information', mi FROM bits
          UNION ALL SELECT 'normalized_information', 2 * mi / (ha + hb) FROM bits
          UNION ALL SELECT 'homogeneity', mi / ha FROM bits
          UNION ALL SELECT 'completeness', mi / hb FROM bits
          UNION ALL SELECT 'purity', (SELECT sum(top) FROM per_b) / n FROM whole
          UNION ALL SELECT 'inverse_purity', (SELECT sum(top) FROM per_a) / n FROM whole
          UNION ALL SELECT 'cramers_v', sqrt(sum(pow(c.n - per_a.n * per_b.n / w.n, 2) / (per_a.n * per_b.n / w.n)) FILTER (true)
                      / any_value(w.n) / (least((SELECT count(*) FROM per_a), (SELECT count(*) FROM per_b)) - 1))
            + 0 FROM (SELECT per_a.a, per_b.b, coalesce(cells.n, 0) AS n FROM per_a, per_b LEFT JOIN cells ON cells.a = per_a.a AND cells.b = per_b.b) c
            JOIN per_a ON per_a.a = c.a JOIN per_b ON per_b.b = c.b, whole w
        )
        SELECT measure, round(value, 6) AS value FROM measures""",
    RFM,
    kmeans(4),
)

# ---- baskets ----


def itemsets(support: float) -> str:
    """All subsets of every basket, level by level, then counted."""
    return f"""
    bought AS (
      SELECT order_id, product_name FROM lines GROUP BY ALL HAVING sum(quantity) > 0
    ),
    size AS (SELECT count(DISTINCT order_id) AS n FROM lines),
    subsets AS (
      SELECT order_id, [product_name] AS items, product_name AS last FROM bought
      UNION ALL
      SELECT s.order_id, list_append(s.items, b.product_name), b.product_name
      FROM subsets s JOIN bought b ON b.order_id = s.order_id AND b.product_name > s.last
    ),
    itemsets AS (
      SELECT items, count(*) AS freq, any_value(n) AS orders FROM subsets, size GROUP BY items
      HAVING CAST(count(*) AS DOUBLE) / any_value(n) >= {support}
    ),
    masks AS (
      SELECT items, freq, orders,
             list_filter(items, lambda x, i: (mask >> CAST(i - 1 AS INTEGER)) & 1 = 1) AS antecedent,
             list_filter(items, lambda x, i: (mask >> CAST(i - 1 AS INTEGER)) & 1 = 0) AS consequent
      FROM (SELECT *, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT) - 1)) AS mask FROM itemsets WHERE len(items) > 1)
    ),
    rules AS (
      SELECT m.antecedent, m.consequent, CAST(m.freq AS DOUBLE) / m.orders AS support,
             CAST(m.freq AS DOUBLE) / a.freq AS confidence,
             CAST(m.freq AS DOUBLE) * m.orders / (a.freq * c.freq) AS lift
      FROM masks m JOIN itemsets a ON a.items = m.antecedent JOIN itemsets c ON c.items = m.consequent
    ),
    best AS (
      SELECT array_to_string(antecedent, ' + ') AS antecedent, array_to_string(consequent, ' + ') AS consequent,
             round(support, 4) AS support, round(confidence, 4) AS confidence, round(lift, 2) AS lift
      FROM rules WHERE lift >= 1
      ORDER BY rules.lift DESC, rules.confidence DESC, rules.support DESC, array_to_string(rules.antecedent, ' + '),
               array_to_string(rules.consequent, ' + ') LIMIT 30
    ),
    advised AS (
      SELECT *, CASE WHEN lift >= 3 THEN '强烈建议' WHEN lift >= 2 THEN '建议' WHEN lift >= 1.5 THEN '可考虑' ELSE '弱关联' END
                || '将「' || antecedent || '」+「' || consequent || '」组合为套餐，Lift=' || CAST(lift AS VARCHAR) AS recommendation
      FROM best
    )"""


ORACLE_SQL["m1_baskets"] = star(
    " SELECT order_id, product_name FROM lines GROUP BY ALL HAVING sum(quantity) > 0"
)
ORACLE_SQL["m2_itemsets"] = star(
    " SELECT array_to_string(items, ',') AS items, freq, orders FROM itemsets", itemsets(0.0005)
)
ORACLE_SQL["m3_rules"] = star(
    """ SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent,
        round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules WHERE lift >= 1""",
    itemsets(0.0005),
)
ORACLE_SQL["m4_top_rules"] = star(" SELECT * FROM advised", itemsets(0.0005))
ORACLE_SQL["m5_pair_rules"] = star(
    """, bought AS (SELECT order_id, product_name FROM lines GROUP BY ALL HAVING sum(quantity) > 0),
        size AS (SELECT count(DISTINCT order_id) AS n FROM lines),
        single AS (SELECT product_name, count(*) AS freq FROM bought GROUP BY product_name),
        pairs AS (
          SELECT a.product_name AS antecedent, b.product_name AS consequent, count(*) AS freq
          FROM bought a JOIN bought b ON a.order_id = b.order_id AND a.product_name <> b.product_name GROUP BY ALL
        ),
        rules AS (
          SELECT antecedent, consequent, CAST(p.freq AS DOUBLE) / n AS support, CAST(p.freq AS DOUBLE) / a.freq AS confidence,
                 CAST(p.freq AS DOUBLE) * n / (a.freq * c.freq) AS lift
          FROM pairs p JOIN single a ON a.product_name = antecedent JOIN single c ON c.product_name = consequent, size
          WHERE CAST(p.freq AS DOUBLE) / n >= 0.002
        )
        SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence,
               round(lift, 6) AS lift FROM rules WHERE lift >= 1"""
)

# ---- unusual orders ----

ORACLE_SQL["d1_order_features"] = star(
    """ SELECT order_id, CAST(sum(actual_amount) AS DOUBLE) AS total_amount, count(DISTINCT product_name) AS item_count,
        CAST(sum(quantity) AS DOUBLE) AS total_quantity,
        CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_unit_price,
        CAST(sum(discount) AS DOUBLE) AS discount_total, first(hour ORDER BY line_no, hour) AS order_hour,
        first(is_weekend ORDER BY line_no, is_weekend) AS is_weekend FROM lines GROUP BY order_id"""
)

# The same lines in another layout.
for _name, _plain in (
    ("a1_bucketed_rollup", "a1_order_rollup"), ("q1_bucketed_outliers", "q1_order_outliers"), ("d1_bucketed_features", "d1_order_features"),
):
    ORACLE_SQL[_name] = ORACLE_SQL[_plain]

# The forest: draws and splits come from MD5, trees are grown level by level and walked from the node table.
_LEAF = "CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * CAST(n - 1 AS DOUBLE) / n WHEN n = 2 THEN 1 ELSE 0 END"
FOREST = f"""
    features AS (
      SELECT order_id, [CAST(sum(actual_amount) AS DOUBLE), CAST(count(DISTINCT product_name) AS DOUBLE), CAST(sum(quantity) AS DOUBLE),
                        CAST(sum(unit_price) AS DOUBLE) / count(unit_price), CAST(sum(discount) AS DOUBLE)] AS x
      FROM lines GROUP BY order_id
    ),
    sampled AS (
      SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY substr(md5('42:' || t // 4 || ':' || order_id), 8 * (t % 4) + 1, 8), order_id) AS place
      FROM features, (SELECT unnest(range(100)) AS t)
    ),
    grown AS (
      SELECT t, x, 1 AS node, 0 AS depth FROM sampled WHERE place <= 256
      UNION ALL
      SELECT t, x, CAST(2 * node + CASE WHEN x[chosen] <= low[chosen] + u * (high[chosen] - low[chosen]) THEN 0 ELSE 1 END AS INTEGER), depth + 1
      FROM (
        SELECT *, varying[CAST('0x' || substr(h, 1, 8) AS BIGINT) % len(varying) + 1] AS chosen, CAST('0x' || substr(h, 9, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
        FROM (
          SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: high[i] > low[i]) AS varying, md5('node:42:' || t || ':' || node) AS h
          FROM (
            SELECT t, x, node, depth, count(*) OVER w AS n,
                   [min(x[1]) OVER w, min(x[2]) OVER w, min(x[3]) OVER w, min(x[4]) OVER w, min(x[5]) OVER w] AS low,
                   [max(x[1]) OVER w, max(x[2]) OVER w, max(x[3]) OVER w, max(x[4]) OVER w, max(x[5]) OVER w] AS high
            FROM grown WINDOW w AS (PARTITION BY t, node)
          )
        ) WHERE depth < 8 AND n > 1 AND len(varying) > 0
      )
    ),
    sizes AS (
      SELECT t, node, depth, count(*) AS n, [min(x[1]), min(x[2]), min(x[3]), min(x[4]), min(x[5])] AS low,
             [max(x[1]), max(x[2]), max(x[3]), max(x[4]), max(x[5])] AS high
      FROM grown GROUP BY t, node, depth
    ),
    nodes AS (
      SELECT t, node, CAST(round((depth + {_LEAF}) * 1000000) AS BIGINT) AS path, depth < 8 AND n > 1 AND len(varying) > 0 AS inner_node,
             varying[CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(len(varying), 1) + 1] AS chosen,
             CAST('0x' || substr(h, 9, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u, low, high
      FROM (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: high[i] > low[i]) AS varying, md5('node:42:' || t || ':' || node) AS h FROM sizes)
    ),
    splits AS (SELECT t, node, path, inner_node, chosen, low[chosen] + u * (high[chosen] - low[chosen]) AS split FROM nodes),
    walk AS (
      SELECT order_id, x, t, 1 AS node FROM features, (SELECT DISTINCT t FROM splits)
      UNION ALL
      SELECT order_id, x, w.t, CAST(2 * w.node + CASE WHEN x[chosen] <= split THEN 0 ELSE 1 END AS INTEGER)
      FROM walk w JOIN splits s ON s.t = w.t AND s.node = w.node WHERE inner_node
    ),
    rated AS (
      SELECT order_id, round(-pow(2, -(sum(path) / 1000000.0::DOUBLE / 100 / (SELECT {_LEAF} FROM sizes WHERE node = 1 LIMIT 1))), 9) AS anomaly_score
      FROM walk w JOIN splits s ON s.t = w.t AND s.node = w.node WHERE NOT inner_node GROUP BY order_id
    ),
    forest AS (SELECT order_id, anomaly_score, anomaly_score < (SELECT quantile_cont(anomaly_score, 0.05) FROM rated) AS is_anomaly FROM rated)"""
ORACLE_SQL["d2_isolation_forest"] = star(
    " SELECT order_id, anomaly_score, CAST(CASE WHEN is_anomaly THEN -1 ELSE 1 END AS INTEGER) AS anomaly_label, is_anomaly FROM forest", FOREST
)
ORACLE_SQL["d3_verdicts"] = star(
    """ SELECT order_id, anomaly_score, by_amount, is_anomaly AS by_forest,
          CASE WHEN by_amount AND is_anomaly THEN 'both' WHEN by_amount THEN 'amount only' WHEN is_anomaly THEN 'forest only' ELSE 'normal' END AS verdict
        FROM (SELECT *, order_id IN (SELECT order_id FROM outlying) AS by_amount FROM forest)""",
    BOUNDS,
    FOREST,
)

# ---- diagnosis ----


def finding(section: str, item: str, metric: str, value: str, label: str, source: str) -> str:
    return f"""SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{metric}' AS metric,
      CAST({value} AS DOUBLE) AS value, CAST({label} AS VARCHAR) AS label FROM {source}"""


def union(*parts: str) -> str:
    return " " + " UNION ALL ".join(parts)


_KPIS = union(
    *[
        finding("summary", "NULL", m, m, "NULL", "overview")
        for m in ("total_revenue", "total_orders", "avg_order_value", "avg_discount_rate")
    ],
    finding("summary", "NULL", "refund_rate", "refund_rate",
            "CASE WHEN refund_rate > 5 THEN 'high' ELSE 'normal' END", "overview"),
    finding("summary", "NULL", "today_revenue", "round(today_revenue, 2)", "NULL", "latest"),
    finding("summary", "NULL", "today_orders", "today_orders", "NULL", "latest"),
    finding("summary", "NULL", "dod_change", "abs(dod_change)",
            "CASE WHEN dod_change >= 0 THEN '↑' ELSE '↓' END", "latest"),
    finding("summary", "NULL", "daily_mean", "mean", "NULL", "stats"),
    finding("summary", "NULL", "daily_median", "median", "NULL", "stats"),
    finding("volatility", "NULL", "std", "std", "NULL", "stats"),
    finding("volatility", "NULL", "skewness", "skewness",
            "CASE WHEN skewness > 0.5 THEN 'right' WHEN abs(skewness) <= 0.5 THEN 'even' ELSE 'left' END", "stats"),
    finding("volatility", "NULL", "kurtosis", "kurtosis",
            "CASE WHEN kurtosis > 0 THEN 'peaked' ELSE 'flat' END", "stats"),
)
ORACLE_SQL["r1_kpi_verdicts"] = star(_KPIS, ROLLUP)
ORACLE_SQL["r2_alerts"] = star(
    union(
        finding("alerts", "'orders'", "anomalous_orders", "n", "NULL",
                "(SELECT count(*) AS n FROM outlying) WHERE n > 0"),
        finding("alerts", "'revenue'", "dod_change", "abs(dod_change)", "NULL", "latest WHERE abs(dod_change) > 30"),
        finding("alerts", "'refunds'", "refund_rate", "refund_rate", "NULL", "overview WHERE refund_rate > 5"),
    ),
    ROLLUP,
    BOUNDS,
)
_TOP5 = "(SELECT * FROM ranking ORDER BY total_sold DESC, product_name LIMIT 5)"
_PRODUCTS = union(
    *[
        finding("best sellers", "product_name", m, m, "NULL", _TOP5)
        for m in ("total_sold", "total_revenue", "revenue_share")
    ],
    finding("slow movers", "product_name", "total_sold", "total_sold", "NULL", "slow"),
)
ORACLE_SQL["r3_product_findings"] = star(_PRODUCTS, RANKING)
_BEST = "ORDER BY lift DESC, confidence DESC, support DESC, antecedent, consequent LIMIT"
_TOP3 = f"(SELECT *, antecedent || ' → ' || consequent AS pair FROM advised {_BEST} 3)"
_RULES = union(
    finding("rules", "pair", "lift", "lift",
            "CASE WHEN lift >= 3 THEN '★★★ 强关联' WHEN lift >= 2 THEN '★★☆ 中等关联' ELSE '★☆☆ 弱关联' END", _TOP3),
    finding("rules", "pair", "support", "support", "NULL", _TOP3),
    finding("rules", "pair", "confidence", "confidence", "NULL", _TOP3),
    finding("rules", "pair", "recommendation", "NULL", "recommendation", _TOP3),
)
ORACLE_SQL["r4_rule_findings"] = star(_RULES, itemsets(0.002))
_AT_RISK = f"(SELECT count(*) AS n FROM segments WHERE segment IN ({_RISK})) WHERE n > 0"
_ACTIONS = union(
    finding("actions", "NULL", "bundle", "lift", "recommendation", f"(SELECT * FROM advised {_BEST} 1)"),
    finding("actions", "NULL", "at_risk", "n", "NULL", _AT_RISK),
    finding("actions", "product_name", "weak_product", "total_sold", "NULL",
            "(SELECT * FROM ranking ORDER BY total_sold, product_name DESC LIMIT 1)"),
)
_BASKETS = itemsets(0.002).replace("size AS", "basket_size AS").replace("subsets, size", "subsets, basket_size")
ORACLE_SQL["r5_actions"] = star(_ACTIONS, RANKING, RFM, _BASKETS)
_SHARES = f"""(SELECT segment, count(*) AS customers, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM segments) * 100, 1) AS share,
    {_case('segment', SHORT_STRATEGIES)} AS strategy FROM segments GROUP BY segment)"""
ORACLE_SQL["r6_all_but_forecast"] = star(
    " UNION ALL ".join(
        [
            finding("header", "NULL", "period", "NULL", "date_range", "overview"),
            finding("footer", "NULL", "period", "NULL", "date_range", "overview"),
            _KPIS,
            finding("alerts", "'orders'", "anomalous_orders", "n", "NULL", "(SELECT count(*) AS n FROM forest WHERE is_anomaly) WHERE n > 0"),
            finding("alerts", "'revenue'", "dod_change", "abs(dod_change)", "NULL", "latest WHERE abs(dod_change) > 30"),
            finding("alerts", "'refunds'", "refund_rate", "refund_rate", "NULL", "overview WHERE refund_rate > 5"),
            _PRODUCTS,
            _RULES,
            finding("segments", "segment", "customers", "customers", "strategy", _SHARES),
            finding("segments", "segment", "share", "share", "NULL", _SHARES),
            finding("segments", "NULL", "at_risk", "n", "NULL", _AT_RISK),
            _ACTIONS,
        ]
    ),
    ROLLUP,
    RANKING,
    RFM,
    _BASKETS,
    FOREST,
)

# ---- facts that any valid fit meets ----

ORACLE_SQL["k6_facts"] = star(" SELECT segment, count(*) AS customers FROM segments GROUP BY segment", RFM)
ORACLE_SQL["c2_facts"] = star(
    " SELECT count(*) AS customers, count(DISTINCT customer_id) AS distinct_customers, CAST(4 AS BIGINT) AS clusters FROM customers", RFM
)
ORACLE_SQL["c3_facts"] = star(
    """ SELECT count(*) AS customers, round(avg(CAST(recency AS DOUBLE)), 4) AS recency,
        round(avg(CAST(frequency AS DOUBLE)), 4) AS frequency, round(avg(CAST(monetary AS DOUBLE)), 4) AS monetary
        FROM customers""",
    RFM,
)
ORACLE_SQL["c4_facts"] = star(
    " SELECT CAST(3 * count(*) AS DOUBLE) AS one_cluster, CAST(8 AS BIGINT) AS fits, true AS falling FROM customers", RFM
)
_SERIES = "(SELECT platform AS series, max(date) AS last FROM lines GROUP BY platform HAVING count(DISTINCT date) >= 14)"
ORACLE_SQL["t2_facts"] = event(
    f" SELECT series, CAST(14 AS INTEGER) AS forecast_days, CAST(17 AS INTEGER) AS n_features, true AS has_error FROM {_SERIES}"
)
ORACLE_SQL["t3_facts"] = event(
    f""" SELECT series, strftime(last + INTERVAL 1 DAY, '%Y-%m-%d') AS first_day, strftime(last + INTERVAL 14 DAY, '%Y-%m-%d') AS last_day,
         CAST(14 AS BIGINT) AS days, true AS in_order, true AS in_range FROM {_SERIES}"""
)
ORACLE_SQL["t5_facts"] = event(
    f" SELECT series, true AS total_is_seven_means, true AS known_trend FROM {_SERIES}"
)
ORACLE_SQL["d2_facts"] = star(
    """ SELECT count(DISTINCT order_id) AS orders, true AS scores_in_range, true AS at_most_the_share, true AS labels_agree
        FROM lines"""
)
ORACLE_SQL["d3_facts"] = star(
    " SELECT order_id, order_id IN (SELECT order_id FROM outlying) AS by_amount FROM totals", BOUNDS
)
ORACLE_SQL["r6_facts"] = star(_KPIS + " UNION ALL " + _PRODUCTS, ROLLUP, RANKING)
