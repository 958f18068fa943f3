"""The SQL dialect, stores, functions and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .model import KEY, value_columns, with_tags
from .operators.curve import curve_match
from .plans.cut import scratch
from .queries import keyed, query, table
from .session import Session
from .sources import files
from .streaming import windows as stream
from .udf import adapter, frames

_TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}


def session(spark: SparkSession, sf: str) -> Session:
    """A session with the driver's tables under the prefix ``db``; timestamps are epoch milliseconds, unique ids keep their column beside the key."""
    s = Session(spark, scratch(spark))
    for name, key in _TABLES.items():
        df = table(spark, sf, name)
        df = df.withColumns({c: S.timestamp_key(F.col(c), "ms") for c, t in df.dtypes if t == "timestamp_ntz"})
        if key:
            df = df.withColumn(KEY, F.col(key).cast("long"))
        s.mount(f"db.{name}", df)
    return s


def dialect(name: str, text: str, oracle: str, columns: list[str] | None = None):
    """Registers a statement of the dialect; the key and the prefixes of result columns are left out."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = session(spark, sf).sql(text)
        df = df.drop(KEY) if "AS KEY" not in text and "OVER WINDOW" not in text and KEY not in (columns or []) else df
        return df.toDF(*(columns or [c.rsplit(".", 1)[-1] for c in df.columns]))

    query(oracle, name)(run)


MS_1998_09_02 = 904694400000
dialect("sql_q1", f"""SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc_price, AVG(l_quantity) AS avg_qty, COUNT(l_quantity) AS count_order
    FROM db.lineitem WHERE l_shipdate <= {MS_1998_09_02} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus;""",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
dialect("sql_q3", f"""SELECT o.key, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM db.customer AS c JOIN db.orders AS o ON c.c_custkey = o.o_custkey JOIN db.lineitem AS l ON l.l_orderkey = o.o_orderkey
    WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < 795225600000 AND l.l_shipdate > 795225600000 GROUP BY o.key ORDER BY revenue DESC, o.key LIMIT 10;""",
    "SELECT o_orderkey AS orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY o_orderkey ORDER BY 2 DESC, 1 LIMIT 10", ["orderkey", "revenue"])
dialect("sql_q5", """SELECT n.n_name, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM db.customer AS c, db.orders AS o, db.lineitem AS l, db.supplier AS s, db.nation AS n, db.region AS r
    WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'
    GROUP BY n.n_name;""",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name")
dialect("sql_q6", "SELECT SUM(l_extendedprice * l_discount) AS revenue FROM db.lineitem WHERE l_shipdate >= 757382400000 AND l_shipdate < 788918400000 AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24;",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
dialect("sql_q7", """SELECT n1.n_name, n2.n_name, extract(l.l_shipdate, "year"), SUM(l.l_extendedprice * (1 - l.l_discount)) FROM db.supplier AS s JOIN db.lineitem AS l ON s.s_suppkey = l.l_suppkey JOIN db.orders AS o ON o.o_orderkey = l.l_orderkey JOIN db.customer AS c ON c.c_custkey = o.o_custkey JOIN db.nation AS n1 ON s.s_nationkey = n1.n_nationkey JOIN db.nation AS n2 ON c.c_nationkey = n2.n_nationkey
    WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1') GROUP BY n1.n_name, n2.n_name, extract(l.l_shipdate, "year");""",
    "SELECT n1.n_name AS supp, n2.n_name AS cust, CAST(year(l_shipdate) AS INTEGER) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1') GROUP BY ALL", ["supp", "cust", "y", "revenue"])
dialect("sql_q10", """SELECT c.c_custkey, c.c_name, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM db.customer AS c JOIN db.orders AS o ON c.c_custkey = o.o_custkey JOIN db.lineitem AS l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, c.c_custkey LIMIT 20;""",
    "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 20")
dialect("sql_q14", """SELECT 100.0 * SUM(CASE WHEN p.p_type LIKE 'PROMO.*' THEN l.l_extendedprice * (1 - l.l_discount) ELSE 0.0 END) / SUM(l.l_extendedprice * (1 - l.l_discount)) AS promo FROM db.lineitem AS l JOIN db.part AS p ON l.l_partkey = p.p_partkey;""",
    "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
dialect("sql_q17", "SELECT SUM(l.l_extendedprice) / 7.0 AS avg_yearly FROM db.lineitem AS l JOIN db.part AS p ON p.p_partkey = l.l_partkey WHERE p.p_size < 10 AND l.l_quantity < (SELECT AVG(i.l_quantity) FROM db.lineitem AS i WHERE i.l_partkey = p.p_partkey);",
    "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem l JOIN part p ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p.p_partkey)")
dialect("sql_q18", "SELECT o.o_orderkey, SUM(l.l_quantity) AS qty FROM db.orders AS o JOIN db.lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IN (SELECT l_orderkey FROM db.lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) GROUP BY o.o_orderkey;",
    "SELECT o_orderkey, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY o_orderkey")
dialect("sql_q22", "SELECT substring(c_mktsegment, 1, 2) AS code, COUNT(c_custkey) AS n, SUM(c_acctbal) AS total FROM db.customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM db.customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT o_orderkey FROM db.orders WHERE db.orders.o_custkey = db.customer.c_custkey AND o_totalprice > 400000) GROUP BY substring(c_mktsegment, 1, 2);",
    "SELECT substring(c_mktsegment, 1, 2) AS code, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY 1")
dialect("sql_wildcard", "SELECT * FROM db.region;", "SELECT r_regionkey, r_name FROM region")
dialect("sql_wildcard_count", "SELECT COUNT(*) FROM db.nation;", "SELECT count(n_nationkey) AS a, count(n_name) AS b, count(n_regionkey) AS c FROM nation", ["a", "b", "c"])
dialect("sql_key_filter", "SELECT value FROM db.events WHERE key >= 10 AND key < 60;", "SELECT value FROM events WHERE event_id >= 10 AND event_id < 60")
dialect("sql_like_not", "SELECT p_partkey FROM db.part WHERE NOT (p_type LIKE '.*SMALL' OR p_size > 25);", "SELECT p_partkey FROM part WHERE NOT (p_type LIKE '%SMALL' OR p_size > 25)")
dialect("sql_in_or_exists", "SELECT c_custkey FROM db.customer WHERE c_acctbal < 0 OR EXISTS (SELECT o_orderkey FROM db.orders WHERE db.orders.o_custkey = db.customer.c_custkey AND o_totalprice > 300000);",
    "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
dialect("sql_all", "SELECT c_custkey FROM db.customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM db.supplier);", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier)")
dialect("sql_any", "SELECT c_custkey FROM db.customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM db.supplier);", "SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier)")
dialect("sql_or_all", "SELECT c_custkey FROM db.customer WHERE c_nationkey = 3 OR c_acctbal >= ALL (SELECT s_acctbal FROM db.supplier WHERE s_nationkey < 5) OR c_custkey = ANY (SELECT o_custkey FROM db.orders WHERE o_totalprice > 480000);",
    "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5) OR c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
dialect("sql_q8", """SELECT extract(o.o_orderdate, "year") AS y, SUM(CASE WHEN n2.n_name = 'NATION_7' THEN l.l_extendedprice * (1 - l.l_discount) ELSE 0.0 END) / SUM(l.l_extendedprice * (1 - l.l_discount)) AS share FROM db.part AS p JOIN db.lineitem AS l ON p.p_partkey = l.l_partkey JOIN db.supplier AS s ON s.s_suppkey = l.l_suppkey JOIN db.orders AS o ON l.l_orderkey = o.o_orderkey JOIN db.customer AS c ON o.o_custkey = c.c_custkey JOIN db.nation AS n1 ON c.c_nationkey = n1.n_nationkey JOIN db.region AS r ON n1.n_regionkey = r.r_regionkey JOIN db.nation AS n2 ON s.s_nationkey = n2.n_nationkey
    WHERE r.r_name = 'ASIA' AND p.p_type = 'ECONOMY' GROUP BY extract(o.o_orderdate, "year");""",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_7' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'ASIA' AND p_type = 'ECONOMY' GROUP BY ALL", ["y", "share"])
dialect("sql_q13", "SELECT t.n AS n, COUNT(t.k) AS customers FROM (SELECT c.c_custkey AS k, COUNT(o.o_orderkey) AS n FROM db.customer AS c LEFT JOIN db.orders AS o ON c.c_custkey = o.o_custkey AND o.o_orderpriority != '1-URGENT' GROUP BY c.c_custkey) AS t GROUP BY t.n;",
    "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) GROUP BY n", ["n", "customers"])
dialect("sql_q15", """WITH revenue(supplier_no, total) AS (SELECT l_suppkey, SUM(l_extendedprice * (1 - l_discount)) FROM db.lineitem WHERE l_shipdate >= 820454400000 AND l_shipdate < 828316800000 GROUP BY l_suppkey)
    SELECT s.s_suppkey, s.s_name, revenue.total FROM db.supplier AS s JOIN revenue ON s.s_suppkey = revenue.supplier_no WHERE revenue.total >= (SELECT MAX(total) FROM revenue) - 100000 ORDER BY s.s_suppkey;""",
    "WITH revenue AS (SELECT l_suppkey AS supplier_no, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, round(total, 2) AS total FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total >= (SELECT max(total) FROM revenue) - 100000 ORDER BY 1", ["s_suppkey", "s_name", "total"])
dialect("sql_q19", "SELECT SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue FROM db.lineitem AS l, db.part AS p WHERE (p.p_partkey = l.l_partkey AND p.p_type IN ('SMALL', 'PROMO') AND l.l_quantity >= 1 AND l.l_quantity <= 11 AND p.p_size <= 15) OR (p.p_partkey = l.l_partkey AND p.p_type = 'LARGE' AND l.l_quantity >= 20 AND l.l_quantity <= 30 AND p.p_size > 15);",
    "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_type IN ('SMALL', 'PROMO') AND l_quantity BETWEEN 1 AND 11 AND p_size <= 15) OR (p_partkey = l_partkey AND p_type = 'LARGE' AND l_quantity BETWEEN 20 AND 30 AND p_size > 15)")
dialect("sql_q21", """SELECT s.s_name, COUNT(l1.l_orderkey) AS numwait FROM db.supplier AS s JOIN db.lineitem AS l1 ON s.s_suppkey = l1.l_suppkey JOIN db.orders AS o ON o.o_orderkey = l1.l_orderkey JOIN db.nation AS n ON s.s_nationkey = n.n_nationkey
    WHERE o.o_orderstatus = 'F' AND n.n_regionkey = 2 AND EXISTS (SELECT l2.l_orderkey FROM db.lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey != l1.l_suppkey) AND NOT EXISTS (SELECT l3.l_orderkey FROM db.lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey != l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s.s_name;""",
    "SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND n_regionkey = 2 AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s_name", ["s_name", "numwait"])
dialect("sql_select_subquery", "SELECT n_name, n_regionkey * (SELECT COUNT(r_regionkey) FROM db.region) AS x FROM db.nation;", "SELECT n_name, n_regionkey * (SELECT count(*) FROM region) AS x FROM nation")
dialect("sql_from_subquery", "SELECT t.s FROM (SELECT SUM(o_totalprice) AS s FROM db.orders GROUP BY o_orderpriority) AS t WHERE t.s > 100;", "SELECT round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderpriority")
dialect("sql_cte", "WITH big(k, n) AS (SELECT o_custkey, COUNT(o_orderkey) FROM db.orders GROUP BY o_custkey) SELECT k, n FROM big WHERE n > 14;", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14")
dialect("sql_set_ops", "SELECT s_nationkey AS k FROM db.supplier GROUP BY s_nationkey UNION SELECT n_nationkey AS k FROM db.nation GROUP BY n_nationkey EXCEPT SELECT c_nationkey AS k FROM db.customer GROUP BY c_nationkey INTERSECT SELECT n_regionkey AS k FROM db.nation GROUP BY n_regionkey;",
    "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer INTERSECT SELECT n_regionkey FROM nation)")
dialect("sql_distinct_order", "SELECT DISTINCT o_orderpriority FROM db.orders ORDER BY o_orderpriority DESC LIMIT 3;", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 DESC LIMIT 3")
dialect("sql_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM db.orders;", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
dialect("sql_sequence", "SELECT c_custkey, SEQUENCE(100, 2) AS seq FROM db.customer ORDER BY c_custkey;", "SELECT c_custkey, 100 + 2 * (row_number() OVER (ORDER BY c_custkey) - 1) AS seq FROM customer")
dialect("sql_downsample", "SELECT MAX(value) AS top, COUNT(user_id) AS n FROM db.events OVER WINDOW (SIZE 100 IN [0, 1000000000000000));", "SELECT event_id - event_id % 100 AS key, event_id - event_id % 100 AS window_start, event_id - event_id % 100 + 99 AS window_end, max(value) AS top, count(*) AS n FROM events GROUP BY 1, 2, 3", ["key", "window_start", "window_end", "top", "n"])
dialect("sql_downsample_slide", "SELECT COUNT(user_id) AS n FROM db.events OVER WINDOW (SIZE 100 IN [0, 1000000000000000) SLIDE 40);", "SELECT s AS key, s AS window_start, s + 99 AS window_end, count(*) AS n FROM (SELECT i * 40 AS s FROM range(0, (SELECT max(event_id) // 40 + 1 FROM events)) t(i)) w JOIN events e ON e.event_id >= s AND e.event_id < s + 100 GROUP BY s", ["key", "window_start", "window_end", "n"])
dialect("sql_last", "SELECT LAST(event_type) FROM db.events;", "SELECT max(event_id) AS key, 'db.events.event_type' AS path, max_by(event_type, event_id) AS value FROM events", ["key", "path", "value"])
dialect("sql_no_from", "SELECT 1 + 1 AS a, 7 / 2 AS b;", "SELECT 2 AS a, 3.5::DOUBLE AS b")
dialect("sql_using", "SELECT db.nation.n_name, db.region.r_name FROM db.nation JOIN db.region ON db.nation.n_regionkey = db.region.r_regionkey ORDER BY db.nation.n_name LIMIT 7;", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY 1 LIMIT 7")
dialect("sql_show_columns", "SHOW COLUMNS db.region.*, db.nation.n_name;", "SELECT 'db.nation.n_name' AS \"Path\", 'BINARY' AS \"Type\" UNION ALL SELECT 'db.region.r_name', 'BINARY' UNION ALL SELECT 'db.region.r_regionkey', 'INTEGER'")


def _rounded(name: str, digits: dict[str, int]) -> None:
    """Sums of doubles depend on the order of rows in their last digits; both sides are rounded."""
    from .queries import _QUERIES

    inner = _QUERIES[name]
    _QUERIES[name] = lambda spark, sf: inner(spark, sf).withColumns({c: F.round(c, d) for c, d in digits.items()})


for _name, _digits in {"sql_q1": {"sum_qty": 2, "sum_disc_price": 2, "avg_qty": 4}, "sql_q3": {"revenue": 2}, "sql_q5": {"revenue": 2}, "sql_q6": {"revenue": 2}, "sql_q7": {"revenue": 2}, "sql_q10": {"revenue": 2}, "sql_q14": {"promo": 4}, "sql_q17": {"avg_yearly": 4}, "sql_q22": {"total": 2}, "sql_q8": {"share": 6}, "sql_q15": {"total": 2}, "sql_q19": {"revenue": 2}, "sql_from_subquery": {"s": 2}}.items():
    _rounded(_name, _digits)


@query("SELECT r_name FROM region")
def sql_value2meta(spark, sf):
    s = session(spark, sf)
    s.mount("names", spark.createDataFrame([(0, "r_name"), (1, "")], "key long, suffix string"))
    return s.sql("SELECT VALUE2META(SELECT suffix FROM names) FROM db.region;").drop(KEY).toDF("r_name")


@query("SELECT event_id AS key, value FROM events WHERE event_id % 2 = 0 AND NOT (event_id >= 100 AND event_id < 200) UNION ALL SELECT event_id, -1.0 FROM events WHERE event_id % 2 = 1 AND NOT (event_id >= 100 AND event_id < 200)")
def store_upsert_delete(spark, sf):
    """Points are inserted, half of them again with other values, a range is deleted, and all is read back."""
    s = Session(spark, scratch(spark))
    events = keyed(table(spark, sf, "events"), "event_id").select(KEY, F.col("value").alias("ev.value"))
    s.store.insert(events)
    s.store.insert(events.where("key % 2 = 1").withColumn("ev.value", F.lit(-1.0)))
    s.sql("DELETE FROM ev.value WHERE key >= 100 AND key < 200;")
    s.sql("COMPACT;")
    return s.sql("SELECT value FROM ev;").toDF(KEY, "value")


@query("SELECT 2 * count(*) AS points FROM nation")
def store_count_points(spark, sf):
    s = Session(spark, scratch(spark))
    s.store.insert(keyed(table(spark, sf, "nation"), "n_nationkey").select(KEY, F.col("n_name").alias("n.name"), F.col("n_regionkey").alias("n.regionkey")))
    return s.sql("COUNT POINTS;").toDF("points")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_regionkey = 1")
def store_insert_select(spark, sf):
    s = session(spark, sf)
    s.sql("INSERT INTO copy (key, name) VALUES (SELECT n_name FROM db.nation WHERE n_regionkey = 1) TIME_OFFSET = 0;")
    return s.sql("SELECT name FROM copy;").toDF(KEY, "name")


@query("SELECT 0 AS key, 1 AS a UNION ALL SELECT 1, 2")
def store_tags(spark, sf):
    s = Session(spark, scratch(spark))
    s.sql("INSERT INTO t (key, a[host=x], a[host=y]) VALUES (0, 1, 10), (1, 2, 20);")
    return s.sql("SELECT a FROM t WITH host=x;").toDF(KEY, "a")


@query("SELECT n_nationkey AS key, n_name, n_regionkey FROM nation")
def source_csv_round_trip(spark, sf):
    path = scratch(spark)
    files.write_csv(table(spark, sf, "nation"), path, header=True)
    return files.read_csv(spark, path, key="n_nationkey", infer=True).select(KEY, "n_name", "n_regionkey")


@query("SELECT event_id AS key, cos(value) AS c, event_id + 1 AS k FROM events")
def udf_udtf(spark, sf):
    import math

    def both(data, args, kvargs):
        key, v = data[2][-2:]
        return [["c", "k"], ["DOUBLE", "LONG"], [math.cos(v), key + 1]]

    e = keyed(table(spark, sf, "events"), "event_id")
    out, _ = adapter.udtf(both, [(F.col(KEY), KEY), (F.col("value"), "value")], [], {}, [("c", "DOUBLE"), ("k", "LONG")])
    return e.select(KEY, *(c.alias(n) for c, n in out))


@query("SELECT n_nationkey + 1 AS key, n_regionkey AS v FROM nation")
def udf_key_add_one(spark, sf):
    """A row function sees the row's key and gives it another."""
    s = session(spark, sf)
    s.register_udtf("key_add_one", lambda data, args, kvargs: [["key", "v"], data[1], [data[2][0] + 1, data[2][1]]], [("v", "LONG")])
    return s.sql("SELECT key_add_one(n_regionkey) FROM db.nation;").toDF(KEY, "v")


@query("SELECT event_id AS key, value AS top FROM events ORDER BY value DESC, event_id LIMIT 1")
def udf_max_with_key(spark, sf):
    """A set function over keys and values gives its result a key."""

    def top(data, args, kvargs):
        # Rows stream past; none is kept but the best.
        return [["key", "top"], data[1], min(data[2:], key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]

    s = session(spark, sf)
    s.register_udaf("udf_max_with_key", top)
    return s.sql("SELECT udf_max_with_key(value) AS top FROM db.events;").toDF(KEY, "top")


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice > 400000 AND o_custkey % 7 < 3) AS n FROM orders GROUP BY o_orderpriority")
def udf_udaf_args(spark, sf):
    """A set function with two columns, a positional and a named argument."""

    def many(data, args, kvargs):
        return [["n"], ["DOUBLE"], [sum(r[1] > args[0] and r[2] % 7 < kvargs["least"] for r in data[2:])]]

    s = session(spark, sf)
    s.register_udaf("many", many, "bigint")
    return s.sql("SELECT o_orderpriority, many(o_totalprice, o_custkey, 400000, least=3) AS n FROM db.orders GROUP BY o_orderpriority;").toDF("o_orderpriority", "n")


@query("SELECT event_type, max(value) AS top FROM events GROUP BY event_type")
def udf_udaf(spark, sf):
    s = session(spark, sf)
    s.register_udaf("udf_max", lambda data, args, kvargs: [["m"], ["DOUBLE"], [max(r[1] for r in data[2:])]])
    return s.sql("SELECT event_type, udf_max(value) AS top FROM db.events GROUP BY event_type;").toDF("event_type", "top")


@query("SELECT r_regionkey, r_name FROM region")
def udf_udsf(spark, sf):
    s = session(spark, sf)
    s.register_udsf("reverse_rows", adapter.reverse_rows, "key long, `db.region.r_regionkey` int, `db.region.r_name` string")
    return s.sql("SELECT reverse_rows(r_regionkey, r_name) FROM db.region;").drop(KEY).toDF("r_regionkey", "r_name")


@query("SELECT max(value) - min(value) AS value FROM events")
def transform_job(spark, sf):
    from .jobs import Job

    s = session(spark, sf)
    s.register_transform("spread", frames.spread, "value double")
    job = Job([{"taskType": "sql", "sqlList": ["SELECT value AS value FROM db.events;"]}, {"taskType": "python", "pyTaskName": "spread", "dataFlowType": "batch"}])
    s.sources["db.events"] = s.sources["db.events"].drop(KEY)
    s.jobs.commit(job)
    if job.error:
        raise RuntimeError(job.error)
    return job.result


@query()
def curve_matching(spark, sf):
    return curve_match(keyed(table(spark, sf, "events"), "event_id").select(KEY, "value"), ["value"], [1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 1.0, 2.0])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_downsample(spark, sf):
    """The events as a file stream, counted in event-time windows."""
    static = spark.read.parquet(f"{sf}/events.parquet")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = stream.windowed(source.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 hour", [F.count("*").alias("n")])
    found = stream.run_to_table(out.select("window_start", "n"), scratch(spark))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


__all__ = ["dialect", "scratch", "session", "value_columns", "with_tags"]
