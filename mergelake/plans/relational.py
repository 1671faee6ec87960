"""Joins, aggregates, windows, set operations and functions, in SQL that both engines read alike.

Money is summed as decimals and returned as doubles, so that sums do not depend on the order of addition.
"""

from __future__ import annotations

from mergelake.plans.registry import both

_REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"

both("pricing_summary", f"""
SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base,
       CAST(SUM({_REVENUE}) AS DOUBLE) AS sum_disc, COUNT(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
both("shipping_priority", f"""
SELECT l_orderkey, CAST(SUM({_REVENUE}) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 50""")
both("local_supplier_volume", f"""
SELECT n_name, CAST(SUM({_REVENUE}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
both("forecast_revenue", "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
both("order_priority_exists", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
both("customer_distribution", "SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey) t GROUP BY c_count")
both("conditional_aggregate", "SELECT l_linestatus, CAST(SUM(CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(SUM(CASE WHEN l_returnflag NOT IN ('R', 'A') THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM lineitem GROUP BY l_linestatus")
both("supplier_part_count", "SELECT p_brand, p_type, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size NOT IN (1, 2, 3) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type")
both("large_orders_having", "SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY l_orderkey HAVING SUM(CAST(l_quantity AS DECIMAL(12,2))) > 150")
both("having_scalar_subquery", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) * 1.2 / COUNT(DISTINCT o_custkey) FROM orders)")
both("idle_customers_anti", "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > (SELECT AVG(CAST(c_acctbal AS DECIMAL(12,2))) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey")
both("full_outer_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey")
both("right_join", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
both("semi_join_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
both("theta_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
_MAYBE = "SELECT CASE WHEN s_nationkey > 20 THEN NULL ELSE s_nationkey END FROM supplier"
both("null_aware_not_in", f"SELECT n_nationkey, 'without nulls' AS side FROM nation WHERE n_nationkey NOT IN ({_MAYBE} WHERE s_nationkey BETWEEN 5 AND 15) UNION ALL SELECT n_nationkey, 'with nulls' FROM nation WHERE n_nationkey NOT IN ({_MAYBE} WHERE s_nationkey > 15)")
both("window_ranks", "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("window_frames", "SELECT event_id, LAG(event_id) OVER w AS before, LEAD(event_id, 2) OVER w AS later, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent, FIRST_VALUE(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
both("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3")
both("cube_counts", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("rollup_counts", "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
both("grouping_sets_counts", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
both("union_all_rows", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("except_keys", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
both("except_all_keys", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
both("string_functions", "SELECT p_partkey, UPPER(SUBSTRING(p_name, 1, 5)) AS head, LENGTH(p_name) AS n, ASCII(p_brand) AS a, REPLACE(p_type, ' ', '_') AS t, CASE WHEN p_name LIKE '%e%' THEN 'e' ELSE '-' END AS e FROM part WHERE p_brand NOT LIKE '%9'")
both("date_functions", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), EXTRACT(MONTH FROM o_orderdate)")
both("math_functions", "SELECT o_orderkey, MOD(o_orderkey, 7) AS m, ABS(o_custkey - 100) AS a, CAST(FLOOR(o_totalprice) AS BIGINT) AS f FROM orders")
both("min_max_avg", "SELECT l_suppkey, MIN(l_shipdate) AS first, MAX(l_quantity) AS most, AVG(l_quantity) AS mean, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
both("global_aggregate", "SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, MIN(ts) AS first, MAX(ts) AS last FROM events")
both("coalesce_nullif", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer")
both("correlated_max", "SELECT o_custkey, o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
