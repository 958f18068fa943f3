"""The remaining TPC-H shapes in the SQL dialect; the driver's tables have no partsupp, so line items stand in for it."""

from __future__ import annotations

from .sql_queries import _rounded, dialect

dialect("sql_q2", """WITH cheapest(p_key, low) AS (SELECT p.p_partkey, MIN(l.l_extendedprice) FROM db.lineitem AS l JOIN db.supplier AS s ON s.s_suppkey = l.l_suppkey JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey JOIN db.region AS r ON n.n_regionkey = r.r_regionkey JOIN db.part AS p ON p.p_partkey = l.l_partkey
    WHERE r.r_name = 'EUROPE' AND p.p_size < 16 AND p.p_type LIKE '.*ECONOMY' GROUP BY p.p_partkey)
    SELECT s.s_acctbal, s.s_name, n.n_name, p.p_partkey, l.l_extendedprice FROM db.part AS p JOIN db.lineitem AS l ON p.p_partkey = l.l_partkey JOIN db.supplier AS s ON s.s_suppkey = l.l_suppkey JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey JOIN db.region AS r ON n.n_regionkey = r.r_regionkey JOIN cheapest ON cheapest.p_key = p.p_partkey AND l.l_extendedprice = cheapest.low
    WHERE p.p_size < 16 AND r.r_name = 'EUROPE' AND p.p_type LIKE '.*ECONOMY' ORDER BY s.s_acctbal DESC, n.n_name, s.s_name, p.p_partkey LIMIT 100;""",
    "WITH offers AS (SELECT * FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND p_size < 16 AND p_type LIKE '%ECONOMY') SELECT s_acctbal, s_name, n_name, p_partkey, l_extendedprice FROM offers o WHERE l_extendedprice = (SELECT min(l_extendedprice) FROM offers i WHERE i.p_partkey = o.p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100", ["s_acctbal", "s_name", "n_name", "p_partkey", "l_extendedprice"])
dialect("sql_q4", "SELECT o_orderpriority, COUNT(o_orderkey) AS order_count FROM db.orders WHERE o_orderdate >= 852076800000 AND o_orderdate < 859852800000 AND EXISTS (SELECT l_orderkey FROM db.lineitem WHERE db.lineitem.l_orderkey = db.orders.o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority ORDER BY o_orderpriority;",
    "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority")
dialect("sql_q9", """WITH years(orderkey, orderyear) AS (SELECT o_orderkey, extract(o_orderdate, "year") FROM db.orders)
    SELECT t.nation, t.o_year, SUM(t.amount) AS sum_profit FROM (SELECT n.n_name AS nation, years.orderyear AS o_year, l.l_extendedprice * (1 - l.l_discount) - p.p_retailprice * l.l_quantity / 10 AS amount FROM db.part AS p JOIN db.lineitem AS l ON p.p_partkey = l.l_partkey JOIN db.supplier AS s ON s.s_suppkey = l.l_suppkey JOIN db.orders AS o ON o.o_orderkey = l.l_orderkey JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey JOIN years ON o.o_orderkey = years.orderkey WHERE p.p_name LIKE '.*ring.*') AS t GROUP BY t.nation, t.o_year ORDER BY t.nation, t.o_year DESC;""",
    "SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity / 10), 4) AS sum_profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%ring%' GROUP BY 1, 2", ["nation", "o_year", "sum_profit"])
dialect("sql_q11", """SELECT l.l_partkey, SUM(l.l_extendedprice) AS val FROM db.lineitem AS l JOIN db.supplier AS s ON l.l_suppkey = s.s_suppkey JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 3 GROUP BY l.l_partkey
    HAVING SUM(l.l_extendedprice) > (SELECT SUM(l.l_extendedprice) * 0.0015 FROM db.lineitem AS l JOIN db.supplier AS s ON l.l_suppkey = s.s_suppkey JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 3) ORDER BY val DESC;""",
    "WITH offers AS (SELECT l_partkey, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3) SELECT l_partkey, round(sum(l_extendedprice), 2) AS val FROM offers GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0015 FROM offers)", ["l_partkey", "val"])
dialect("sql_q12", "SELECT l.l_returnflag, SUM(CASE WHEN o.o_orderpriority = '1-URGENT' OR o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high, SUM(CASE WHEN o.o_orderpriority <> '1-URGENT' AND o.o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low FROM db.orders AS o JOIN db.lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE (l.l_returnflag = 'A' OR l.l_returnflag = 'R') AND o.o_orderdate < l.l_shipdate AND l.l_shipdate >= 820454400000 AND l.l_shipdate < 915148800000 GROUP BY l.l_returnflag ORDER BY l.l_returnflag;",
    "SELECT l_returnflag, CAST(count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS high, CAST(count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_returnflag", ["l_returnflag", "high", "low"])
dialect("sql_q16", """SELECT p.p_brand, p.p_type, p.p_size, COUNT(DISTINCT l.l_suppkey) AS supplier_cnt FROM db.lineitem AS l JOIN db.part AS p ON p.p_partkey = l.l_partkey
    WHERE p.p_brand <> 'Brand#4' AND p.p_partkey NOT IN (SELECT p_partkey FROM db.part WHERE p_type LIKE 'MED.*') AND (p.p_size = 3 OR p.p_size = 9 OR p.p_size = 14 OR p.p_size = 19 OR p.p_size = 36) AND l.l_suppkey NOT IN (SELECT s_suppkey FROM db.supplier WHERE s_acctbal < 0.0) GROUP BY p.p_brand, p.p_type, p.p_size ORDER BY supplier_cnt DESC, p.p_brand, p.p_type, p.p_size;""",
    "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MED%' AND p_size IN (3, 9, 14, 19, 36) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL", ["p_brand", "p_type", "p_size", "supplier_cnt"])
dialect("sql_q20", """WITH shipped(partkey, suppkey, val) AS (SELECT t.partkey, t.suppkey, 0.5 * t.q FROM (SELECT l_partkey AS partkey, l_suppkey AS suppkey, SUM(l_quantity) AS q FROM db.lineitem WHERE l_shipdate >= 820454400000 AND l_shipdate < 852076800000 GROUP BY l_partkey, l_suppkey) AS t)
    SELECT s.s_name, n.n_name FROM db.supplier AS s JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey IN (SELECT l.l_suppkey FROM db.lineitem AS l JOIN shipped ON shipped.suppkey = l.l_suppkey AND shipped.partkey = l.l_partkey WHERE l.l_partkey IN (SELECT p_partkey FROM db.part WHERE p_name LIKE 'small.*') AND l.l_quantity > shipped.val) AND n.n_regionkey < 4 ORDER BY s.s_name;""",
    "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 4 AND s_suppkey IN (SELECT l.l_suppkey FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, 0.5 * sum(l_quantity) AS val FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL) t ON t.l_suppkey = l.l_suppkey AND t.l_partkey = l.l_partkey WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%') AND l.l_quantity > val)", ["s_name", "n_name"])

for _name, _digits in {"sql_q9": {"sum_profit": 4}, "sql_q11": {"val": 2}}.items():
    _rounded(_name, _digits)
