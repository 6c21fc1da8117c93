"""The SQL surface: each statement runs through Lake.sql over versioned tables, and as it stands in the other engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import lake_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    # projections, filters, predicates
    "p_project_filter": "SELECT o_orderkey, o_totalprice * 2 AS doubled, o_orderstatus || '-' || o_orderpriority AS tag FROM orders WHERE o_totalprice > 150000 AND NOT o_orderstatus = 'F'",
    "p_star": "SELECT * FROM nation",
    "p_star_exclude": "SELECT * EXCLUDE (r_name), upper(r_name) AS shout FROM region",
    "p_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "p_in_between_like_ilike": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_name LIKE '%1%' AND c_name ILIKE 'CUSTOMER%'",
    "p_not_in": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 1)",
    "p_is_null": "SELECT e.event_id FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey WHERE c.c_custkey IS NULL",
    "p_case_when": "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM orders GROUP BY 1",
    "p_iif_coalesce": "SELECT p_partkey, IF(p_size > 25, 'big', 'little') AS kind, COALESCE(NULLIF(p_brand, 'Brand#11'), 'none') AS brand FROM part",
    "p_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "p_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "p_in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "p_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)",
    "p_always_false": "SELECT o_orderkey, o_totalprice FROM orders WHERE 1 = 0",
    "p_quoted_names": 'SELECT "o_orderkey" AS "order key", "o_orderstatus" FROM "orders" WHERE "o_orderkey" < 100',
    # joins
    "j_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "j_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "j_right": "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000",
    "j_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey",
    "j_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "j_self": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "j_using": "SELECT r_regionkey, r_name, n_name FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x JOIN region USING (r_regionkey)",
    "j_natural": "SELECT r_regionkey, r_name, n_name FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x NATURAL JOIN region",
    "j_theta": "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_nationkey = a.s_nationkey",
    "j_expression": "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey + 1 = c.c_custkey - 1",
    "j_multi": "SELECT n.n_name, r.r_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name",
    # aggregates
    "a_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "a_count_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS key_sum FROM orders GROUP BY o_orderpriority",
    "a_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "a_group_expression": "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate)",
    "a_filter_clause": "SELECT l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(sum(l_quantity) FILTER (WHERE l_tax = 0), 2) AS untaxed FROM lineitem GROUP BY l_linestatus",
    "a_stddev_var": "SELECT event_type, round(stddev(value), 6) AS sd, round(variance(value), 4) AS var FROM events GROUP BY event_type",
    "a_percentile_cont": "SELECT event_type, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS p25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY value), 6) AS p75 FROM events GROUP BY event_type",
    "a_string_agg": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "a_list_sorted": "SELECT n_regionkey, list_sort(list(n_nationkey)) AS keys FROM nation GROUP BY n_regionkey",
    "a_list_ordered": "SELECT n_regionkey, list(n_name ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey",
    "a_sum_over_count": "SELECT o_orderstatus, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus",
    "a_entropy": "SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type)",
    "a_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "a_cube": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "a_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "a_max_by": "SELECT c_nationkey, arg_max(c_custkey, c_acctbal) AS richest FROM customer GROUP BY c_nationkey",
    "a_fact_rollup": "SELECT COALESCE(a.k, b.k) AS part_key, COALESCE(a.sold, 0) AS sold, COALESCE(b.late, 0) AS late, CASE WHEN COALESCE(a.sold, 0) > 0 THEN round(COALESCE(b.late, 0) / a.sold, 6) ELSE 0 END AS late_rate FROM (SELECT l_partkey AS k, sum(l_quantity) AS sold FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey) a FULL OUTER JOIN (SELECT l_partkey AS k, sum(l_quantity) AS late FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) b ON a.k = b.k",
    # windows
    "wn_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "wn_rank_dense": "SELECT n_nationkey, CAST(rank() OVER (ORDER BY n_regionkey) AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY n_regionkey DESC) AS BIGINT) AS d FROM nation",
    "wn_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr FROM supplier",
    "wn_ntile": "SELECT event_type, event_id, CAST(ntile(10) OVER (PARTITION BY event_type ORDER BY value, event_id) AS BIGINT) AS bucket FROM events",
    "wn_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "wn_first_value": "SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_price FROM orders",
    "wn_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "wn_moving_avg_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
    "wn_range_frame": "SELECT s_suppkey, CAST(count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM supplier",
    "wn_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    # sorting, limits, set operations, common table expressions
    "s_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "s_limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "s_nulls_order": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 ORDER BY o.o_orderkey, c.c_custkey LIMIT 40",
    "s_nulls_first": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 ORDER BY o.o_orderkey ASC NULLS FIRST, c.c_custkey LIMIT 40",
    "s_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "s_union_all": "SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier",
    "s_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "s_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "s_cte_chain": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n",
    "s_recursive_cte": "WITH RECURSIVE up(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM up WHERE n < 20) SELECT n, n * n AS square FROM up",
    "s_derived_table": "SELECT d.status, d.n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) AS d WHERE d.n > 10",
    # scalar functions
    "f_string": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS BIGINT) AS len, trim('  ' || c_mktsegment || ' ') AS t, concat(c_name, NULL, '!') AS c, substr(c_name, 3, 4) AS s, replace(c_name, '0', 'o') AS r FROM customer",
    "f_math": "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(sqrt(l_quantity), 6) AS s, round(power(l_quantity, 2), 4) AS p, round(log(l_quantity), 6) AS lg, round(log2(l_quantity), 6) AS l2, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS m, CAST(l_linenumber // 2 AS BIGINT) AS half FROM lineitem",
    "f_date": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q, CAST(extract(dow FROM o_orderdate) AS BIGINT) AS dow, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate + INTERVAL '7 days' AS week FROM orders",
    "f_epoch": "SELECT event_id, round(epoch(ts), 3) AS seconds FROM events",
    "f_cast_try_cast": "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS whole, CAST(o_totalprice AS DECIMAL(18, 2)) AS exact, TRY_CAST(o_orderstatus AS INTEGER) AS nothing, o_orderkey::VARCHAR AS s FROM orders",
    "f_regexp": "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0+[1-3]$')",
    # pruning: equal answers with fewer files
    "o_prune_range": "SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 900",
    "o_prune_in": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 34, 1000000)",
    "o_prune_self_join": "SELECT a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey < 50 AND b.o_totalprice > 1000",
}


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, sf_dir: lake_of(spark, sf_dir, *used).sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(text) for name, text in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
