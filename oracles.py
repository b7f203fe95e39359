"""DuckDB statements with the same contract as the registered queries.

Each statement is written against the driver's tables; a shared prelude derives
the six-table order model from them.
"""

from __future__ import annotations

from basketlens.sources.schemas import FEATURES

PRELUDE = """
WITH seq AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS placed_on,
         row_number() OVER w AS order_number,
         lag(CAST(o_orderdate AS DATE)) OVER w AS previous_on,
         lead(o_orderkey) OVER w IS NULL AS is_last
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
),
t_orders AS (
  SELECT order_id, user_id,
         CASE WHEN is_last THEN 'train' ELSE 'prior' END AS eval_set,
         CAST(order_number AS INTEGER) AS order_number,
         CAST(dayofweek(placed_on) AS INTEGER) AS order_dow,
         CAST(order_id %% 24 AS INTEGER) AS order_hour_of_day,
         CASE WHEN previous_on IS NULL THEN NULL
              ELSE CAST(least(date_diff('day', previous_on, placed_on), 30) AS DOUBLE)
         END AS days_since_prior_order
  FROM seq
),
t_filled AS (
  SELECT * REPLACE (coalesce(days_since_prior_order, 0.0) AS days_since_prior_order) FROM t_orders
),
baskets AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, min(l_linenumber) AS first_line
  FROM lineitem GROUP BY 1, 2
),
t_lines AS (
  SELECT b.order_id, b.product_id,
         CAST(row_number() OVER (PARTITION BY b.order_id ORDER BY b.first_line, b.product_id)
              AS INTEGER) AS add_to_cart_order,
         CAST(CASE WHEN row_number() OVER (PARTITION BY s.user_id, b.product_id
                                           ORDER BY s.order_number) > 1
                   THEN 1 ELSE 0 END AS INTEGER) AS reordered,
         s.is_last
  FROM baskets b JOIN seq s ON b.order_id = s.order_id
),
t_train AS (SELECT * EXCLUDE (is_last) FROM t_lines WHERE is_last),
t_prior AS (SELECT * EXCLUDE (is_last) FROM t_lines WHERE NOT is_last),
t_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         CAST(dense_rank() OVER (ORDER BY p_brand) AS INTEGER) AS aisle_id,
         CAST(dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS department_id,
         p_brand, p_type
  FROM part
),
t_aisles AS (SELECT DISTINCT aisle_id, p_brand AS aisle FROM t_products),
t_departments AS (SELECT DISTINCT department_id, p_type AS department FROM t_products),
t_dim AS (
  SELECT p.product_id, p.product_name, p.aisle_id, p.department_id, a.aisle, d.department
  FROM t_products p JOIN t_aisles a USING (aisle_id) JOIN t_departments d USING (department_id)
),
t_features AS (
  SELECT o.user_id,
         max(o.order_number) AS total_max_orders,
         avg(o.days_since_prior_order) AS average_days_btw_orders,
         avg(l.reordered) AS reorder_mean,
         avg(o.order_hour_of_day) AS average_hour_of_day,
         avg(o.order_dow) AS average_order_dow,
         count(DISTINCT l.product_id) AS unique_products,
         avg(l.add_to_cart_order) AS average_add_to_cart_order
  FROM t_filled o JOIN t_train l USING (order_id) GROUP BY o.user_id
),
t_days AS (
  SELECT user_id, coalesce(sum(days_since_prior_order), 0.0) AS days_since_last_order
  FROM t_orders GROUP BY user_id
),
t_scaled AS (
  SELECT user_id, %(scaled)s
  FROM t_features, (SELECT %(stats)s FROM t_features)
)
""" % {
    "scaled": ", ".join(
        f"({c} - mean_{c}) / CASE WHEN std_{c} = 0 THEN 1 ELSE std_{c} END AS {c}" for c in FEATURES
    ),
    "stats": ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in FEATURES),
}

FEATURE_LIST = ", ".join(FEATURES)


def rounded(columns, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


FEATURES_R = rounded(FEATURES).replace(
    "round(total_max_orders, 6) AS total_max_orders", "total_max_orders"
).replace("round(unique_products, 6) AS unique_products", "unique_products")

BODIES: dict[str, str] = {}


def _histogram(source: str, value: str, bins: int) -> str:
    return f"""
, v AS (SELECT CAST({value} AS DOUBLE) AS x FROM {source}),
s AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
b AS (SELECT CAST(i AS INTEGER) AS bin, i * ((hi - lo) / {bins}) + lo AS bin_left,
             CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}) + lo END AS bin_right
      FROM range({bins}) r(i), s)
SELECT bin, round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right, count(x) AS n
FROM b LEFT JOIN v ON (x >= bin_left AND (x < bin_right OR (bin = {bins - 1} AND x = bin_right)))
GROUP BY ALL"""


def _named_counts(name: str, source: str, out: str) -> str:
    return f"""SELECT {name}, count(*) AS {out}
FROM t_train JOIN {source} USING (product_id) WHERE {name} IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


_TABLES = {
    "orders": "t_orders",
    "products": "(SELECT product_id, product_name, aisle_id, department_id FROM t_products)",
    "aisles": "t_aisles",
    "departments": "t_departments",
    "order_products_prior": "t_prior",
    "order_products_train": "t_train",
}
_COLUMNS = {
    "orders": ["order_id", "user_id", "eval_set", "order_number", "order_dow",
               "order_hour_of_day", "days_since_prior_order"],
    "products": ["product_id", "product_name", "aisle_id", "department_id"],
    "aisles": ["aisle_id", "aisle"],
    "departments": ["department_id", "department"],
    "order_products_prior": ["order_id", "product_id", "add_to_cart_order", "reordered"],
    "order_products_train": ["order_id", "product_id", "add_to_cart_order", "reordered"],
}

# -- sources, quality -------------------------------------------------------

BODIES["load_delimited"] = """SELECT l.order_id, product_id, add_to_cart_order, reordered,
  CASE WHEN is_last THEN 'train' ELSE 'prior' END AS eval_set,
  CAST(dayofweek(o_orderdate) AS INTEGER) AS order_dow, p_brand AS aisle
FROM t_lines l JOIN orders ON o_orderkey = l.order_id JOIN part ON p_partkey = product_id"""
BODIES["load_tables"] = "SELECT * FROM t_lines_all".replace(
    "t_lines_all",
    "(SELECT order_id, product_id, add_to_cart_order, reordered, "
    "CASE WHEN is_last THEN 'train' ELSE 'prior' END AS eval_set FROM t_lines)",
)
BODIES["raw_orders"] = "SELECT * FROM t_orders"
BODIES["row_count"] = "SELECT count(*) AS row_count FROM t_orders"
BODIES["table_overview"] = " UNION ALL ".join(
    [
        f"SELECT '{n}' AS table_name, count(*) AS row_count, "
        f"{len(_COLUMNS[n])} AS column_count FROM {t}"
        for n, t in _TABLES.items()
    ]
    + [
        "SELECT 'wide_table' AS table_name, count(*) AS row_count, 15 AS column_count "
        "FROM t_orders JOIN t_train USING (order_id)"
    ]
)
BODIES["preview"] = """SELECT user_id, order_id, order_number, order_dow, order_hour_of_day,
  days_since_prior_order, product_id, add_to_cart_order, reordered, department, aisle
FROM t_filled JOIN t_train USING (order_id) LEFT JOIN t_dim USING (product_id)
ORDER BY order_id, product_id LIMIT 5"""
BODIES["strip_columns"] = "SELECT order_id, user_id, order_number FROM t_orders"
BODIES["null_counts"] = "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NULL) AS {c}" for c in _COLUMNS["orders"]
) + " FROM t_orders"
BODIES["missing_report"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS variable_name, "
    f"count(*) FILTER ({c} IS NULL) AS missing_values FROM {t}"
    for n, t in _TABLES.items()
    for c in _COLUMNS[n]
)
BODIES["fill_nulls"] = "SELECT order_id, days_since_prior_order FROM t_filled"
BODIES["duplicate_check"] = ", f AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, coalesce(max(c) > 1, false) AS has_duplicates "
    f"FROM (SELECT count(*) AS c FROM {t} GROUP BY {', '.join(_COLUMNS[n])})"
    for n, t in _TABLES.items()
) + """) SELECT table_name, has_duplicates,
  CASE WHEN (SELECT bool_and(has_duplicates) FROM f) THEN 'Yes' ELSE 'No' END AS answer FROM f"""
BODIES["duplicate_rows_lines"] = """SELECT 'order_parts' AS table_name,
  max(c) > 1 AS has_duplicates, CASE WHEN max(c) > 1 THEN 'Yes' ELSE 'No' END AS answer
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
BODIES["cast_types"] = "SELECT * FROM t_orders"
BODIES["project"] = f"SELECT {FEATURES_R} FROM t_features"
BODIES["rename"] = "SELECT order_id AS basket, product_id AS item FROM t_train"
BODIES["keyword_flag"] = """SELECT product_id, product_name, contains(product_name, 'red') AS is_match
FROM t_products"""
BODIES["drop_null_rows"] = "SELECT * FROM t_orders WHERE days_since_prior_order IS NOT NULL"
BODIES["row_filter"] = """SELECT o.* FROM t_orders o WHERE user_id IN (
  SELECT user_id FROM t_orders WHERE order_dow = 0)"""
BODIES["threshold_label"] = """SELECT order_id,
  CAST(coalesce(days_since_prior_order > 20, false) AS INTEGER) AS label FROM t_orders"""
BODIES["subtract_row"] = f"""SELECT user_id, {', '.join(
    f'round({c} - (SELECT avg({c}) FROM t_features), 6) AS {c}' for c in FEATURES)}
FROM t_features"""

# -- joins --------------------------------------------------------------------

_LINE = "order_id, product_id, add_to_cart_order, reordered"
BODIES["lines_products_left"] = f"""SELECT {_LINE}, product_name, aisle_id, department_id
FROM t_train LEFT JOIN t_products USING (product_id)"""
BODIES["product_dim"] = "SELECT * FROM t_dim"
BODIES["lines_product_dim"] = f"""SELECT {_LINE}, product_name, aisle_id, department_id,
  aisle, department FROM t_train JOIN t_dim USING (product_id)"""
BODIES["orders_lines"] = f"""SELECT {_LINE}, user_id, eval_set, order_number, order_dow,
  order_hour_of_day, days_since_prior_order FROM t_filled JOIN t_train USING (order_id)"""
BODIES["wide_table"] = f"""SELECT {_LINE}, user_id, eval_set, order_number, order_dow,
  order_hour_of_day, days_since_prior_order, product_name, aisle_id, department_id, aisle, department
FROM t_filled JOIN t_train USING (order_id) LEFT JOIN t_dim USING (product_id)"""
BODIES["features_churn"] = f"""SELECT user_id, {FEATURES_R}, days_since_last_order
FROM t_features LEFT JOIN t_days USING (user_id)"""

# -- aggregates -----------------------------------------------------------------

BODIES["orders_per_user"] = """SELECT user_id, max(order_number) AS total_orders
FROM t_orders GROUP BY user_id"""
BODIES["orders_per_user_hist"] = _histogram(
    "(SELECT max(order_number) AS m FROM t_orders GROUP BY user_id)", "m", 25
)
BODIES["gap_hist"] = _histogram("t_filled", "days_since_prior_order", 30)
BODIES["orders_by_hour"] = """SELECT order_hour_of_day, count(*) AS n_orders
FROM t_orders GROUP BY 1"""
BODIES["orders_by_dow"] = "SELECT order_dow, count(*) AS n_orders FROM t_orders GROUP BY 1"
BODIES["distinct_values"] = """SELECT count(DISTINCT order_hour_of_day) AS distinct_hours,
  count(DISTINCT order_dow) AS distinct_days FROM t_orders"""
BODIES["describe"] = """SELECT count(order_number) AS count, round(avg(order_number), 6) AS mean,
  round(stddev_samp(order_number), 6) AS std, CAST(min(order_number) AS DOUBLE) AS min,
  quantile_cont(order_number, 0.25) AS q25, quantile_cont(order_number, 0.5) AS q50,
  quantile_cont(order_number, 0.75) AS q75, CAST(max(order_number) AS DOUBLE) AS max
FROM t_orders"""
BODIES["outlier_stats"] = """, q AS (SELECT quantile_cont(order_number, 0.25) AS q25,
  quantile_cont(order_number, 0.5) AS q50, quantile_cont(order_number, 0.75) AS q75 FROM t_orders),
f AS (SELECT order_number AS x, q.*,
  order_number BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS ok FROM t_orders, q)
SELECT any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75,
  CAST(min(x) FILTER (ok) AS DOUBLE) AS whisker_low,
  CAST(max(x) FILTER (ok) AS DOUBLE) AS whisker_high,
  count(*) FILTER (NOT ok) AS outliers FROM f"""
BODIES["reorder_by_cart_pos"] = """SELECT add_to_cart_order, count(*) AS n,
  round(avg(reordered), 6) AS reorder_mean,
  round(avg(reordered) - 1.96 * stddev_samp(reordered) / sqrt(count(*)), 6) AS band_low,
  round(avg(reordered) + 1.96 * stddev_samp(reordered) / sqrt(count(*)), 6) AS band_high
FROM t_train GROUP BY 1"""
BODIES["reorder_rate"] = """SELECT round(avg(reordered), 6) AS reorder_rate,
  printf('%.4f%%', avg(reordered) * 100) AS rate_text FROM t_train"""
BODIES["value_counts"] = """SELECT department, count(*) AS n FROM t_train
JOIN t_dim USING (product_id) GROUP BY 1"""
BODIES["organic_share"] = """SELECT contains(product_name, 'red') AS is_organic, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM t_train JOIN t_dim USING (product_id) GROUP BY 1"""
BODIES["user_features"] = f"SELECT user_id, {FEATURES_R} FROM t_features"
BODIES["user_features_all_lines"] = f"""SELECT user_id, {FEATURES_R} FROM (
  SELECT o.user_id, max(o.order_number) AS total_max_orders,
         avg(o.days_since_prior_order) AS average_days_btw_orders,
         avg(l.reordered) AS reorder_mean, avg(o.order_hour_of_day) AS average_hour_of_day,
         avg(o.order_dow) AS average_order_dow, count(DISTINCT l.product_id) AS unique_products,
         avg(l.add_to_cart_order) AS average_add_to_cart_order
  FROM t_filled o JOIN t_lines l USING (order_id) GROUP BY o.user_id)"""
BODIES["days_sum"] = "SELECT user_id, days_since_last_order FROM t_days"
BODIES["top_products"] = _named_counts("product_name", "t_dim", "quantity")
BODIES["top_departments"] = _named_counts("department", "t_dim", "order_count")
BODIES["top_aisles"] = _named_counts("aisle", "t_dim", "order_count")

# -- scalars ----------------------------------------------------------------------

BODIES["round_half_even"] = """SELECT o_orderkey,
  round_even(o_totalprice / 7 * 100, 0) / 100 AS rounded,
  round_even((o_orderkey + 0.5) * 1, 0) / 1 AS half_rounded FROM orders"""
BODIES["percent_text"] = """SELECT o_orderkey,
  printf('%.4f%%', (o_orderkey % 1000) / 1000.0 * 100) AS text FROM orders"""
BODIES["argmax_label"] = f"""SELECT user_id, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS label
FROM (SELECT user_id, [{', '.join(f'round({c}, 6)' for c in FEATURES)}] AS u FROM t_scaled)"""
BODIES["within_pct"] = f"""SELECT user_id, {' AND '.join(
    f'abs({c} - (SELECT avg({c}) FROM t_features)) <= 0.5 * (SELECT avg({c}) FROM t_features)'
    for c in ('average_hour_of_day', 'unique_products'))} AS is_within FROM t_features"""
BODIES["join_labels"] = """SELECT order_id, CASE WHEN t = '' THEN 'regular' ELSE t END AS labels FROM (
  SELECT order_id, concat_ws(', ', CASE WHEN order_dow IN (0, 6) THEN 'weekend' END,
    CASE WHEN order_hour_of_day < 6 THEN 'night' END,
    CASE WHEN order_number = 1 THEN 'first' END) AS t FROM t_orders)"""

# -- sampling, scaling --------------------------------------------------------------

_KEY = "md5(concat(CAST(user_id AS VARCHAR), '-42'))"
BODIES["sample_n"] = f"""SELECT user_id, {FEATURES_R} FROM t_features
ORDER BY {_KEY}, user_id LIMIT 3000"""
BODIES["sample_n_cut"] = BODIES["sample_n"].replace("LIMIT 3000", "LIMIT 100")
BODIES["standardize"] = f"SELECT user_id, {rounded(FEATURES)} FROM t_scaled"
CHURN = """, t_churn AS (SELECT t_features.*, days_since_last_order,
  CAST(coalesce(days_since_last_order > 240, false) AS INTEGER) AS churn
  FROM t_features LEFT JOIN t_days USING (user_id)),
t_split AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY %s, user_id)
    <= round(count(*) OVER (PARTITION BY churn) * 0.2) AS is_test FROM t_churn)
""" % _KEY
BODIES["stratified_split"] = CHURN + "SELECT user_id, churn, is_test FROM t_split"
BODIES["churn_label"] = f"""SELECT user_id, {FEATURES_R}, days_since_last_order,
  CAST(coalesce(days_since_last_order > 20, false) AS INTEGER) AS churn
FROM t_features LEFT JOIN t_days USING (user_id)"""


BODIES["pca_covariance"] = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"round(covar_pop({a}, {b}), 6) AS covariance FROM t_scaled"
    for i, a in enumerate(FEATURES)
    for b in FEATURES[i:]
)

# -- validity and profiles on given labels --------------------------------------------


def _metric_ctes(source: str) -> str:
    """Silhouette, Calinski-Harabasz, Davies-Bouldin and inertia of every tag in a
    table (tag, k, user_id, cluster, v)."""
    n = len(FEATURES)
    return f"""
, lab AS ({source}),
pairs AS (SELECT a.tag, a.k, a.user_id, a.cluster AS own, b.cluster AS other,
    sum(list_distance(a.v, b.v)) AS s, count(*) AS n
  FROM lab a JOIN lab b ON a.tag = b.tag AND a.k = b.k GROUP BY ALL),
per_row AS (SELECT tag, k, user_id,
    max(CASE WHEN own = other THEN n END) AS own_n,
    max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN own <> other THEN s / n END) AS b
  FROM pairs GROUP BY ALL),
sil AS (SELECT tag, k, avg(CASE WHEN own_n = 1 OR greatest(a, b) = 0 THEN 0
    ELSE (b - a) / greatest(a, b) END) AS silhouette FROM per_row GROUP BY ALL),
cells AS (SELECT tag, k, cluster, count(*) AS n,
    [{', '.join(f'avg(v[{i + 1}])' for i in range(n))}] AS centre FROM lab GROUP BY ALL),
grand AS (SELECT tag, k, count(*) AS n, count(DISTINCT cluster) AS kk,
    [{', '.join(f'avg(v[{i + 1}])' for i in range(n))}] AS centre FROM lab GROUP BY ALL),
within_ AS (SELECT l.tag, l.k, sum(list_distance(l.v, c.centre) ** 2) AS w
  FROM lab l JOIN cells c USING (tag, k, cluster) GROUP BY ALL),
between_ AS (SELECT c.tag, c.k, sum(c.n * list_distance(c.centre, g.centre) ** 2) AS b
  FROM cells c JOIN grand g USING (tag, k) GROUP BY ALL),
ch AS (SELECT tag, k, w AS inertia, (b / (kk - 1)) / (w / (n - kk)) AS calinski_harabasz
  FROM within_ JOIN between_ USING (tag, k) JOIN grand USING (tag, k)),
spread AS (SELECT l.tag, l.k, l.cluster, any_value(c.centre) AS centre,
    avg(list_distance(l.v, c.centre)) AS s
  FROM lab l JOIN cells c USING (tag, k, cluster) GROUP BY ALL),
worst AS (SELECT a.tag, a.k, a.cluster,
    max((a.s + b.s) / list_distance(a.centre, b.centre)) AS r
  FROM spread a JOIN spread b ON a.tag = b.tag AND a.k = b.k AND a.cluster <> b.cluster
  GROUP BY ALL),
db AS (SELECT tag, k, avg(r) AS davies_bouldin FROM worst GROUP BY ALL),
sq_pairs AS (SELECT l.tag, l.k, l.user_id, l.cluster AS own, m.cluster AS other, m.n,
    m.n * (list_distance(l.v, m.centre) ** 2 + m.scatter / m.n) AS s
  FROM lab l JOIN (SELECT x.tag, x.k, x.cluster, any_value(c.n) AS n,
      any_value(c.centre) AS centre, sum(list_distance(x.v, c.centre) ** 2) AS scatter
    FROM lab x JOIN cells c USING (tag, k, cluster) GROUP BY ALL) m USING (tag, k)),
sq_row AS (SELECT tag, k, user_id, max(CASE WHEN own = other THEN n END) AS own_n,
    max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN own <> other THEN s / n END) AS b FROM sq_pairs GROUP BY ALL),
sil_sq AS (SELECT tag, k, avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)
    AS silhouette_sq FROM sq_row GROUP BY ALL)
"""


_VECTOR = "[" + FEATURE_LIST + "]"
BY_FOUR = _metric_ctes(
    f"SELECT 'x' AS tag, 4 AS k, user_id, user_id % 4 AS cluster, {_VECTOR} AS v FROM t_scaled"
)
BODIES["silhouette"] = BY_FOUR + "SELECT round(silhouette, 6) AS silhouette FROM sil"
BODIES["silhouette_sq"] = BY_FOUR + "SELECT round(silhouette_sq, 6) AS silhouette_sq FROM sil_sq"
BODIES["calinski_harabasz"] = (
    BY_FOUR + "SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM ch"
)
BODIES["davies_bouldin"] = BY_FOUR + "SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db"
BODIES["inertia"] = BY_FOUR + "SELECT round(inertia, 6) AS inertia FROM ch"

GIVEN = _metric_ctes(
    " UNION ALL ".join(
        f"SELECT 'by_user' AS tag, {k} AS k, user_id, user_id % {k} AS cluster, {_VECTOR} AS v "
        f"FROM t_scaled UNION ALL SELECT 'by_reach' AS tag, {k} AS k, user_id, "
        f"CASE WHEN unique_products > 0 THEN 0 ELSE 1 + user_id % {k - 1} END AS cluster, "
        f"{_VECTOR} AS v FROM t_scaled"
        for k in (2, 3, 4)
    )
) + """, metrics AS (SELECT tag AS method, k, silhouette_sq AS silhouette, calinski_harabasz, davies_bouldin
  FROM sil_sq JOIN ch USING (tag, k) JOIN db USING (tag, k))
"""
_METRICS = rounded(("silhouette", "calinski_harabasz", "davies_bouldin"))
BODIES["stack_results"] = GIVEN + f"SELECT method, k, {_METRICS} FROM metrics"
BODIES["sort_results"] = BODIES["stack_results"] + " ORDER BY 1, 2"
BODIES["best_model"] = GIVEN + f"""SELECT method, k, {_METRICS},
  CAST(s AS INTEGER) AS silhouette_rank, CAST(c AS INTEGER) AS calinski_harabasz_rank,
  CAST(d AS INTEGER) AS davies_bouldin_rank, round((s + c + d) / 3.0, 6) AS mean_rank
FROM (SELECT *, rank() OVER (ORDER BY silhouette DESC) AS s,
  rank() OVER (ORDER BY calinski_harabasz DESC) AS c,
  rank() OVER (ORDER BY davies_bouldin) AS d FROM metrics)"""

OVERALL = ", o AS (SELECT " + ", ".join(
    f"avg({c}) AS overall_{c}" for c in FEATURES
) + " FROM t_features)"


def _means(modulus: int) -> str:
    return OVERALL + f""", m AS (SELECT CAST(user_id % {modulus} AS INTEGER) AS cluster,
  count(*) AS cluster_size, {', '.join(f'avg({c}) AS {c}' for c in FEATURES)}
  FROM t_features GROUP BY 1)
"""


def _half_even(expr: str, name: str) -> str:
    return f"round_even({expr} * 100, 0) / 100 AS {name}"


DESCRIPTION = f"""CASE WHEN {' AND '.join(
    f'abs({c} - overall_{c}) <= 0.05 * overall_{c}' for c in FEATURES)}
  THEN 'Consistent customers' ELSE coalesce(nullif(concat_ws(', ',
    CASE WHEN total_max_orders > overall_total_max_orders
      AND average_days_btw_orders < overall_average_days_btw_orders
      THEN 'High-engagement shoppers' END,
    CASE WHEN reorder_mean > overall_reorder_mean THEN 'Retention customers' END,
    CASE WHEN unique_products > overall_unique_products AND reorder_mean < overall_reorder_mean
      THEN 'Variety seekers' END), ''), 'Unstable shoppers') END AS description"""

BODIES["cluster_means"] = _means(4) + f"""SELECT cluster, cluster_size, {rounded(FEATURES)},
  {rounded([f'overall_{c}' for c in FEATURES])} FROM m, o"""
BODIES["profile_sizes"] = _means(4) + f"SELECT cluster, cluster_size, {rounded(FEATURES)} FROM m"
BODIES["classify_cluster"] = _means(200) + f"SELECT cluster, {DESCRIPTION} FROM m, o"
BODIES["cluster_profiles"] = _means(4) + f"""SELECT cluster, cluster_size,
  {', '.join(_half_even(c, c) for c in FEATURES)}, description
FROM (SELECT *, {DESCRIPTION} FROM m, o)"""
BODIES["overall_mean"] = "SELECT " + ", ".join(
    _half_even(f"avg({c})", c) for c in FEATURES
) + " FROM t_features"
BODIES["profile_delta"] = _means(4) + "SELECT cluster, " + ", ".join(
    _half_even(f"({c} - overall_{c})", c) for c in FEATURES
) + " FROM m, o"

BODIES["nearest_neighbours"] = f""", p AS (SELECT user_id, {_VECTOR} AS v FROM t_scaled),
d AS (SELECT a.user_id, list_distance(a.v, b.v) AS distance
  FROM p a JOIN p b ON a.user_id <> b.user_id)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY distance) AS INTEGER) AS place,
  round(distance, 6) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY distance) <= 15"""

# -- scores on given predictions ----------------------------------------------------------

PREDICTED = CHURN + """, p AS (SELECT churn AS label,
  average_days_btw_orders * total_max_orders / 1000.0 AS score,
  CAST(average_days_btw_orders * total_max_orders / 1000.0 > 0.25 AS INTEGER) AS prediction
  FROM t_churn),
steps AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM p GROUP BY score),
run AS (SELECT score, pos, neg, row_number() OVER d AS step,
  sum(pos) OVER d AS tp, sum(neg) OVER d AS fp,
  lead(pos) OVER d AS next_pos, lead(neg) OVER d AS next_neg,
  sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM steps WINDOW d AS (ORDER BY score DESC))
"""
_BALANCE = """SELECT count(*) FILTER (churn = 0) AS negatives,
  count(*) FILTER (churn = 1) AS positives,
  round(count(*) FILTER (churn = 0) / count(*) FILTER (churn = 1), 6) AS ratio FROM t_churn"""
BODIES["class_balance"] = CHURN + _BALANCE
BODIES["class_weight"] = CHURN + f"""SELECT user_id, churn,
  CASE WHEN churn = 1 THEN (SELECT ratio FROM ({_BALANCE})) ELSE 1.0 END AS weight FROM t_churn"""
BODIES["confusion_matrix"] = PREDICTED + """SELECT CAST(a AS INTEGER) AS actual,
  CAST(b AS INTEGER) AS predicted, count(label) AS n
FROM range(2) x(a) CROSS JOIN range(2) y(b) LEFT JOIN p ON label = a AND prediction = b
GROUP BY ALL"""
BODIES["classification_report"] = PREDICTED + """, c AS (SELECT k,
  count(*) FILTER (label = k) AS support,
  count(*) FILTER (label = k AND prediction = k) AS hit,
  count(*) FILTER (prediction = k) AS said FROM p, range(2) r(k) GROUP BY k),
q AS (SELECT k, support, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS pr,
  CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re,
  CASE WHEN said + support = 0 THEN 0 ELSE 2.0 * hit / (said + support) END AS f FROM c)
SELECT CAST(k AS VARCHAR) AS class, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(f, 6) AS f1, support FROM q
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6),
  CAST(sum(support) AS BIGINT) FROM q
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6),
  round(sum(re * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM q"""
BODIES["roc_auc"] = PREDICTED + """SELECT round(
  sum(CASE WHEN n.score < s.score THEN 1.0 WHEN n.score = s.score THEN 0.5 ELSE 0 END
      * n.neg * s.pos) / (any_value(t.np) * any_value(t.nn)), 6) AS roc_auc
FROM steps s, steps n, (SELECT sum(pos) AS np, sum(neg) AS nn FROM steps) t"""
BODIES["average_precision"] = PREDICTED + """SELECT round(sum(pos / all_pos * tp / (tp + fp)), 6)
  AS average_precision FROM run"""
_START = "UNION ALL SELECT 0.0, 0.0, CAST('inf' AS DOUBLE)"
_POINT = """round(CAST(fp AS DOUBLE) / all_neg, 6) AS fpr,
  round(CAST(tp AS DOUBLE) / all_pos, 6) AS tpr, round(score, 6) AS threshold"""
BODIES["roc_curve"] = PREDICTED + f"""SELECT {_POINT} FROM run
WHERE step = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg {_START}"""
BODIES["roc_curve_all_points"] = PREDICTED + f"SELECT {_POINT} FROM run {_START}"
BODIES["pr_curve"] = PREDICTED + """SELECT round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
  round(CAST(tp AS DOUBLE) / all_pos, 6) AS recall, round(score, 6) AS threshold FROM run
UNION ALL SELECT 1.0, 0.0, NULL"""

# -- one fuzzy step ------------------------------------------------------------------------

FUZZY = f""", g AS (SELECT user_id, {_VECTOR} AS v, {FEATURE_LIST} FROM t_scaled),
spots AS (SELECT 0 AS cluster, -0.5 AS offs UNION ALL SELECT 1, 0.5 UNION ALL SELECT 2, 0.0),
far AS (SELECT g.*, cluster, list_distance(v, list_transform(v, lambda x: CAST(offs AS DOUBLE))) ** 2 AS d
  FROM g, spots),
member AS (SELECT *, (1 / d) / sum(1 / d) OVER (PARTITION BY user_id) AS u FROM far)
"""
BODIES["fuzzy_step"] = FUZZY + f"""SELECT CAST(cluster AS INTEGER) AS cluster,
  round(sum(u * u), 6) AS weight, round(sum(u * u * d), 6) AS objective,
  {', '.join(f'round(sum(u * u * {c}) / sum(u * u), 6) AS {c}' for c in FEATURES)}
FROM member GROUP BY 1"""
BODIES["fuzzy_labels"] = FUZZY + """SELECT user_id, CAST(arg_min(cluster, d) AS INTEGER) AS cluster,
  round(max(u), 6) AS membership FROM member GROUP BY 1"""
BODIES["partition_coefficient"] = FUZZY + """SELECT round(sum(u * u) / count(DISTINCT user_id), 6)
  AS partition_coefficient FROM member"""


BODIES["attach_labels"] = FUZZY + f"""SELECT f.user_id, {FEATURES_R}, l.cluster
FROM t_features f JOIN (SELECT user_id, CAST(arg_min(cluster, d) AS INTEGER) AS cluster
  FROM member GROUP BY 1) l ON f.user_id = l.user_id"""

# -- principal components: repeated squaring of the covariance, then deflation -------------


def _component(c: int) -> str:
    """Leading unit eigenvector of m{c}, and the matrix without it."""
    times_v = "list_transform(m, lambda r: list_dot_product(r, v))"
    return f"""
, q{c} AS (SELECT 0 AS i, m FROM m{c} UNION ALL
  SELECT i + 1, list_transform(m, lambda r: list_transform(m, lambda o:
    list_dot_product(r, o) / list_sum(list_transform(m, lambda p: list_dot_product(p, p)))))
  FROM q{c} WHERE i < 40),
r{c} AS (SELECT m[list_position(d, list_max(d))] AS w FROM (
  SELECT m, list_transform(m, lambda r: list_dot_product(r, r)) AS d FROM q{c} WHERE i = 40)),
s{c} AS (SELECT w, list_transform(w, lambda x: abs(x)) AS a, sqrt(list_dot_product(w, w)) AS n FROM r{c}),
v{c} AS (SELECT list_transform(w, lambda x: x * sign(w[list_position(a, list_max(a))]) / n) AS v FROM s{c}),
m{c + 1} AS (SELECT list_transform(range(1, {len(FEATURES) + 1}), lambda i:
    list_transform(range(1, {len(FEATURES) + 1}), lambda j: m[i][j] - v[i] * v[j] * l)) AS m
  FROM (SELECT m, v, list_dot_product(v, {times_v}) AS l FROM m{c}, v{c}))"""


_MATRIX = ", ".join(
    "[" + ", ".join(f"covar_pop({a}, {b})" for b in FEATURES) + "]" for a in FEATURES
)
BODIES["pca"] = f""", m1 AS (SELECT [{_MATRIX}] AS m FROM t_scaled)
{_component(1)}{_component(2)}{_component(3)}
SELECT user_id, {', '.join(f'round(list_dot_product({_VECTOR}, v{c}.v), 6) AS pc{c}' for c in (1, 2, 3))}
FROM t_scaled, v1, v2, v3"""


BODIES["boost_bins"] = CHURN + f"""
, u AS (SELECT unnest(range({len(FEATURES)})) AS feature, unnest([{", ".join(f"{c}::DOUBLE" for c in FEATURES)}]) AS x,
  CASE WHEN churn = 1 THEN (SELECT count(*) FILTER (churn = 0) / count(*) FILTER (churn = 1) FROM t_churn) ELSE 1.0 END AS w
  FROM t_churn),
v AS (SELECT feature, x, sum(sum(w)) OVER (PARTITION BY feature ORDER BY x) AS upto,
        sum(sum(w)) OVER (PARTITION BY feature) AS total, min(x) OVER (PARTITION BY feature) AS least
      FROM u GROUP BY feature, x),
c AS (SELECT DISTINCT feature, least, (SELECT min(x) FROM v WHERE v.feature = f.feature
        AND upto >= total * (b / 256.0 - 1e-9)) AS x
      FROM (SELECT DISTINCT feature, least FROM v) f, range(1, 256) r(b))
SELECT CAST(feature AS INTEGER) AS feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS INTEGER) AS place,
  round(x, 6) AS cut FROM c WHERE x > least"""

_WIDTHS = [f"least(greatest(floor({c} * 4) + 8, 0), 15)::INTEGER" for c in FEATURES]
_WIDTHS[0] = f"CASE WHEN user_id % 11 = 0 THEN -1 ELSE {_WIDTHS[0]} END"
BODIES["boost_level"] = CHURN + f"""
, r AS (SELECT user_id, CASE WHEN bins[4] <= 8 THEN CASE WHEN bins[5] <= 7 THEN 4 ELSE 5 END
                WHEN bins[1] BETWEEN 0 AND 8 THEN 6 ELSE 7 END AS node, bins, churn,
          1.0 + user_id % 3 AS w, 1.0 / (1.0 + exp(-sin(user_id::DOUBLE))) AS p
        FROM (SELECT user_id, [{", ".join(_WIDTHS)}] AS bins FROM t_scaled)
        JOIN (SELECT user_id, churn FROM t_churn) USING (user_id)),
cells AS (SELECT node, unnest(range({len(FEATURES)})) AS feature, unnest(bins) AS bin, w * (p - churn) AS g, w * p * (1 - p) AS h FROM r),
sums AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM cells GROUP BY ALL),
scan AS (SELECT *, sum(g) OVER o AS gu, sum(h) OVER o AS hu, sum(g) OVER n AS ga, sum(h) OVER n AS ha,
           coalesce(sum(g) FILTER (bin < 0) OVER n, 0) AS gm, coalesce(sum(h) FILTER (bin < 0) OVER n, 0) AS hm
         FROM sums WINDOW n AS (PARTITION BY node, feature), o AS (PARTITION BY node, feature ORDER BY bin)),
sides AS (SELECT node, feature, bin, m, gu - (1 - m) * gm AS gl, hu - (1 - m) * hm AS hl, ga, ha
          FROM scan, (VALUES (1), (0)) s(m) WHERE bin >= 0 AND (m = 1 OR hm <> 0)),
gains AS (SELECT *, ga - gl AS gr, ha - hl AS hr,
            gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain
          FROM sides WHERE hl >= 1 AND ha - hl >= 1),
best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, feature, bin, m DESC) AS place
         FROM gains WHERE gain > 1e-6)
SELECT node::BIGINT AS node, feature::INTEGER AS feature, bin::INTEGER AS bin, m = 1 AS missing_left, round(gain, 6) AS gain,
  round(gl, 6) AS g_left, round(hl, 6) AS h_left, round(gr, 6) AS g_right, round(hr, 6) AS h_right,
  round(-gl / (hl + 1), 6) AS left_value, round(-gr / (hr + 1), 6) AS right_value
FROM best WHERE place = 1"""


_N = len(FEATURES)
_STEP = f"""
, centres AS (SELECT k, c AS centre, [sin(100 * k + 10 * c + i) FOR i IN range({_N})] AS spot
  FROM (VALUES (2), (3), (4)) m(k), range(4) r(c) WHERE c < k),
points AS (SELECT user_id, [{", ".join(f"{c}::DOUBLE" for c in FEATURES)}] AS x FROM t_scaled),
away AS (SELECT k, centre, spot, user_id, x, list_sum([(x[i] - spot[i]) ** 2 FOR i IN range(1, {_N + 1})]) AS d FROM points, centres),
own AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY k, user_id ORDER BY d, centre) = 1),
costs AS (SELECT k, sum(d) AS cost FROM own GROUP BY k),
sums AS (SELECT k, centre, count(*)::DOUBLE AS n, {", ".join(f"sum(x[{i + 1}]) AS s{i}" for i in range(_N))} FROM own GROUP BY k, centre)
"""
BODIES["lloyd_step"] = _STEP + f"""SELECT k, centre::INTEGER AS centre, round(cost, 6) AS cost, coalesce(n, 0) AS taken,
  {", ".join(f"round(coalesce(s{i} / n, spot[{i + 1}]), 6) AS {c}" for i, c in enumerate(FEATURES))}
FROM centres LEFT JOIN sums USING (k, centre) JOIN costs USING (k)"""
BODIES["minibatch_step"] = _STEP + f"""SELECT k, centre::INTEGER AS centre, round(cost, 6) AS cost, coalesce(n, 0) + before AS taken,
  {", ".join(f"round((spot[{i + 1}] * before + coalesce(s{i}, 0)) / (before + coalesce(n, 0)), 6) AS {c}" for i, c in enumerate(FEATURES))}
FROM centres LEFT JOIN sums USING (k, centre) JOIN costs USING (k)
JOIN (VALUES (0, 10.0::DOUBLE), (1, 200.0), (2, 3000.0)) b(centre, before) USING (centre) WHERE k = 3"""


BODIES["em_step"] = f"""
, given AS (SELECT k, c AS component, (c + 1) / (k * (k + 1) / 2.0) AS w, [sin(100 * k + 10 * c + i) FOR i IN range({_N})] AS spot,
    [1.5 + cos(100 * k + 10 * c + i) FOR i IN range({_N})] AS spread FROM (VALUES (2), (3)) m(k), range(3) r(c) WHERE c < k),
points AS (SELECT user_id, [{", ".join(f"{c}::DOUBLE" for c in FEATURES)}] AS x FROM t_scaled),
logs AS (SELECT k, component, user_id, x, ln(w) - 0.5 * list_sum([ln(2 * pi() * spread[i]) + (x[i] - spot[i]) ** 2 / spread[i]
    FOR i IN range(1, {_N + 1})]) AS l FROM points, given),
tops AS (SELECT *, max(l) OVER (PARTITION BY k, user_id) AS top FROM logs),
likely AS (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY k, user_id)) AS row_l FROM tops),
r AS (SELECT *, exp(l - row_l) AS r FROM likely),
sums AS (SELECT k, component, sum(r) AS n, sum(r * x[1] * x[2]) AS cross_12, avg(row_l) AS likelihood, count(*) AS rows,
    {", ".join(f"sum(r * x[{i + 1}]) AS s{i}, sum(r * x[{i + 1}] ** 2) AS q{i}" for i in range(_N))} FROM r GROUP BY k, component)
SELECT k, component::INTEGER AS component, round(likelihood, 6) AS likelihood, round(n / rows, 6) AS weight,
  {", ".join(f"round(s{i} / n, 6) AS {c}, round(q{i} / n - (s{i} / n) ** 2, 6) AS {c}_variance" for i, c in enumerate(FEATURES))},
  round(cross_12 / n - s0 / n * (s1 / n), 6) AS covariance FROM sums"""


def _autoencoder_step() -> str:
    """Forward and backward pass of the 7-8-3-8-7 network with weights sin(1), sin(2), ...
    halved, row by row, added up over all users."""
    sizes = (7, 8, 3, 8, 7)
    sums, at, steps = [], 1, []
    values = [list(FEATURES)]
    weights = []
    for layer, (rows, cols) in enumerate(zip(sizes, sizes[1:])):
        weights.append([[f"(sin({at + i * cols + j}) / 2)" for j in range(cols)] for i in range(rows)])
        bias = [f"(sin({at + rows * cols + j}) / 2)" for j in range(cols)]
        at += (rows + 1) * cols
        names = [f"y{layer}_{j}" for j in range(cols)]
        plain = [" + ".join([f"{v} * {weights[layer][i][j]}" for i, v in enumerate(values[-1])] + [bias[j]]) for j in range(cols)]
        shown = plain if layer == 3 else [f"greatest({p}, 0)" for p in plain]
        steps.append(", ".join(f"{p} AS {n}" for p, n in zip(shown, names)))
        values.append(names)
    deltas = [[f"d3_{j}" for j in range(7)]]
    steps.append(", ".join(f"2 * ({y} - {x}) / 7 AS {d}" for y, x, d in zip(values[4], FEATURES, deltas[0])))
    for layer in (2, 1, 0):
        names = [f"d{layer}_{j}" for j in range(sizes[layer + 1])]
        steps.append(", ".join(
            f"CASE WHEN {values[layer + 1][j]} > 0 THEN "
            + " + ".join(f"{d} * {w}" for d, w in zip(deltas[0], weights[layer + 1][j])) + f" ELSE 0 END AS {n}"
            for j, n in enumerate(names)
        ))
        deltas.insert(0, names)
    sums = ["count(*)::DOUBLE", "sum((" + " + ".join(f"({y} - {x}) ** 2" for y, x in zip(values[4], FEATURES)) + ") / 7)"]
    for layer in range(4):
        sums += [f"sum({v} * {d})" for v in values[layer] for d in deltas[layer]]
        sums += [f"sum({d})" for d in deltas[layer]]
    chain = "t_scaled"
    for step in steps:
        chain = f"(SELECT *, {step} FROM {chain})"
    return f"""
, sums AS (SELECT [{", ".join(sums)}] AS s FROM {chain})
SELECT CAST(i - 3 AS INTEGER) AS pos, round(s[i], 6) AS value FROM sums, range(1, 189) r(i)"""


BODIES["autoencoder_step"] = _autoencoder_step()


def statements() -> dict[str, str]:
    prelude = PRELUDE.replace("WITH", "WITH RECURSIVE", 1)
    return {name: (prelude if name == "pca" else PRELUDE) + body for name, body in BODIES.items()}
