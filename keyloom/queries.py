"""Operator queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions.aggregates import aggregate
from .model import KEY, col
from .operators import joins as J
from .operators import relational as R
from .operators import series as X
from .operators import setops as U
from .operators.windows import downsample

#: The end of key intervals that take in whole tables.
WHOLE = 10**15
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def keyed(df: DataFrame, key: str) -> DataFrame:
    """A driver table as a keyed one, by a column that is known to be unique."""
    return df.select(F.col(key).cast("long").alias(KEY), *(c for c in df.columns if c != key))


def _events(spark, sf):
    return keyed(table(spark, sf, "events"), "event_id")


# --- projections, filters, shaping


@query("SELECT o_orderkey AS key, o_orderstatus, o_orderpriority FROM orders")
def project(spark, sf):
    return R.project(keyed(table(spark, sf, "orders"), "o_orderkey"), ["o_orderstatus", "o_orderp*"])


@query("SELECT 1 + 1 AS two, 7 / 2.0 AS half")
def select_without_from(spark, sf):
    return spark.range(1).select(F.lit(2).alias("two"), S.divide(F.lit(7), F.lit(2)).alias("half"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def filter_range(spark, sf):
    d = F.col("l_discount")
    return R.select(table(spark, sf, "lineitem"), (d >= 0.05) & (d <= 0.07) & (F.col("l_quantity") < 24)).select("l_orderkey", "l_extendedprice")


@query("SELECT event_id AS key, value FROM events WHERE event_id >= 100 AND event_id < 300")
def filter_key(spark, sf):
    return _events(spark, sf).where((F.col(KEY) >= 100) & (F.col(KEY) < 300)).select(KEY, "value")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey")
def filter_path_path(spark, sf):
    return R.select(table(spark, sf, "lineitem"), S.compare(F.col("l_partkey"), "<", F.col("l_suppkey"))).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > l_quantity * 1500")
def filter_expression(spark, sf):
    return R.select(table(spark, sf, "lineitem"), F.col("l_extendedprice") * (1 - F.col("l_discount")) > F.col("l_quantity") * 1500).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, '(PROMO|SMALL).*')")
def filter_like(spark, sf):
    return R.select(table(spark, sf, "part"), S.like(F.col("p_type"), "(PROMO|SMALL).*")).select("p_partkey", "p_type")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, sf):
    return R.select(table(spark, sf, "customer"), R.in_list(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in(spark, sf):
    return R.select(table(spark, sf, "customer"), R.in_list(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], negated=True)).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > 0.07 OR l_tax > 0.07")
def filter_wildcard_any(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("r.discount"), F.col("l_tax").alias("r.tax"))
    return R.select(df, R.wildcard_compare(df, "r.*", ">", 0.07)).select("l_orderkey", "l_linenumber", col("r.discount").alias("l_discount"), col("r.tax").alias("l_tax"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.05")
def filter_wildcard_all(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("r.discount"), F.col("l_tax").alias("r.tax"))
    return R.select(df, R.wildcard_compare(df, "r.*", ">", 0.05, all_of=True)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def top_k_offset(spark, sf):
    return R.limit(R.sort(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [(F.col("o_totalprice"), True), (F.col("o_orderkey"), False)]), 10, 5)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal), c_custkey")
def sort_expression(spark, sf):
    return R.sort(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [(F.abs("c_acctbal"), False), (F.col("c_custkey"), False)])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf):
    return R.distinct(keyed(table(spark, sf, "orders"), "o_orderkey"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT s_suppkey AS supplier_suppkey, s_name AS supplier_name FROM supplier")
def rename(spark, sf):
    return R.rename(table(spark, sf, "supplier").select("s_suppkey", "s_name"), {"s_*": "supplier_*"})


@query("SELECT o_orderkey AS key, o_custkey FROM orders")
def rename_as_key(spark, sf):
    return R.as_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def reorder(spark, sf):
    return R.reorder(table(spark, sf, "nation"), ["n_regionkey", "n_nationkey", "*"])


@query('SELECT r_regionkey AS "erp.r_regionkey", r_name AS "erp.r_name" FROM region')
def add_schema_prefix(spark, sf):
    return R.add_prefix(table(spark, sf, "region"), "erp")


@query("SELECT c_custkey, 10 + 5 * (row_number() OVER (ORDER BY c_custkey) - 1) AS seq FROM customer")
def add_sequence(spark, sf):
    return R.add_sequence(table(spark, sf, "customer").select("c_custkey"), [F.col("c_custkey")], "seq", 10, 5)


@query("SELECT n_nationkey, n_name FROM nation")
def remove_null_column(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", "n_name").withColumn("nothing", F.lit(None).cast("string"))
    return R.remove_null_columns(df)


@query("SELECT 'c_acctbal' AS \"Path\", 'DOUBLE' AS \"Type\" UNION ALL SELECT 'c_custkey', 'LONG' UNION ALL SELECT 'c_nationkey', 'INTEGER'")
def show_columns(spark, sf):
    df = table(spark, sf, "customer")
    return R.show_columns(df.select("c_custkey", "c_nationkey", "c_acctbal"), ["c_*"])


@query("SELECT r_name FROM region")
def value_to_selected_path(spark, sf):
    wanted = spark.createDataFrame([("r_name",), (None,), ("",)], "name string")
    return R.project(table(spark, sf, "region"), R.values_to_paths(wanted))


# --- aggregation


@query("SELECT count(l_orderkey) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def aggregate_global(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").agg(aggregate("count", c("l_orderkey")).alias("n"), F.round(aggregate("sum", c("l_quantity")), 2).alias("qty"), F.round(aggregate("avg", c("l_discount")), 6).alias("disc"), aggregate("min", c("l_shipdate")).alias("lo"), aggregate("max", c("l_shipdate")).alias("hi"))


@query("SELECT count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem")
def aggregate_distinct(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").agg(aggregate("count", c("l_suppkey"), distinct=True).alias("n"), aggregate("sum", c("l_linenumber"), distinct=True).alias("s"), aggregate("avg", c("l_linenumber"), distinct=True).alias("a"))


@query("SELECT event_type, first(value ORDER BY event_id) FILTER (value IS NOT NULL) AS first_value, last(value ORDER BY event_id) FILTER (value IS NOT NULL) AS last_value FROM events GROUP BY event_type")
def first_last_value(spark, sf):
    v = F.col("value")
    return _events(spark, sf).groupBy("event_type").agg(aggregate("first_value", v, F.col(KEY)).alias("first_value"), aggregate("last_value", v, F.col(KEY)).alias("last_value"))


@query("SELECT event_id AS key, 'event_type' AS path, event_type AS value FROM events WHERE event_id = (SELECT max(event_id) FROM events WHERE event_type IS NOT NULL) UNION ALL SELECT event_id, 'user_id', CAST(user_id AS VARCHAR) FROM events WHERE event_id = (SELECT max(event_id) FROM events WHERE user_id IS NOT NULL)")
def last_rows(spark, sf):
    return X.first_last(_events(spark, sf), "last", ["event_type", "user_id"])


@query("SELECT event_id AS key, 'event_type' AS path, event_type AS value FROM events WHERE event_id = (SELECT min(event_id) FROM events WHERE event_type IS NOT NULL)")
def first_rows(spark, sf):
    return X.first_last(_events(spark, sf), "first", ["event_type"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def tpch_q1(spark, sf):
    c = F.col
    price = c("l_extendedprice") * (1 - c("l_discount"))
    rows = table(spark, sf, "lineitem").where(c("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    return R.group_by(rows, [c("l_returnflag"), c("l_linestatus")], [F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.sum(price * (1 + c("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")])


@query("SELECT l_linenumber % 3 AS m, count(*) AS n FROM lineitem GROUP BY ALL")
def group_by_expression(spark, sf):
    return R.group_by(table(spark, sf, "lineitem"), [S.modulo(F.col("l_linenumber"), F.lit(3)).alias("m")], [F.count("*").alias("n")])


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_by_having(spark, sf):
    return R.group_by(table(spark, sf, "orders"), [F.col("o_custkey")], [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")], F.col("n") > 12)


# --- joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'")
def join_inner(spark, sf):
    o, c = table(spark, sf, "orders").where("o_orderstatus = 'F'"), table(spark, sf, "customer")
    return J.join(o, c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND s.s_acctbal > 5000")
def join_theta(spark, sf):
    return J.join(table(spark, sf, "supplier"), table(spark, sf, "nation"), (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > 5000)).select("s_suppkey", "n_nationkey")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority <> '1-URGENT' GROUP BY c.c_custkey")
def join_left_outer(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'")
    return J.join(table(spark, sf, "customer"), o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
def join_right_outer(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000")
    return J.join(o, table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_nationkey < c.c_nationkey")
def join_full_outer(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return J.join(s, c, (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") < F.col("c_nationkey")), "full").select("s_suppkey", "c_custkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("n.regionkey"), F.col("n_name").alias("n.name_n"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("r.regionkey"), F.col("r_name").alias("r.name_r"))
    return J.natural(n, r, prefixes=("n", "r")).select(col("n.name_n").alias("n_name"), col("r.name_r").alias("r_name"))


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def join_using(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n.nationkey"), F.col("n_name").alias("n.name"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("s.nationkey"), F.col("s_suppkey").alias("s.suppkey"))
    return J.using(n, s, ["nationkey"], "left", ("n", "s")).select(col("n.nationkey").alias("n_nationkey"), col("n.name").alias("n_name"), col("s.suppkey").alias("s_suppkey"))


@query("SELECT o_orderkey AS key, o_orderstatus, event_type FROM orders JOIN events ON o_orderkey = event_id")
def join_using_key(spark, sf):
    o = keyed(table(spark, sf, "orders"), "o_orderkey").select(KEY, "o_orderstatus")
    return J.using_key(o, _events(spark, sf).select(KEY, "event_type"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return J.cross_join(table(spark, sf, "region"), table(spark, sf, "nation")).select("r_name", "n_name")


@query("SELECT coalesce(a.c_custkey, b.o_orderkey) AS key, a.c_name AS name, b.o_orderstatus AS status FROM customer a FULL JOIN orders b ON a.c_custkey = b.o_orderkey")
def join_align_by_key(spark, sf):
    a = keyed(table(spark, sf, "customer"), "c_custkey").select(KEY, F.col("c_name").alias("name"))
    return J.align(a, keyed(table(spark, sf, "orders"), "o_orderkey").select(KEY, F.col("o_orderstatus").alias("status")))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def join_single_scalar(spark, sf):
    c = table(spark, sf, "customer")
    return J.single(c, c.agg(F.avg("c_acctbal").alias("mean"))).where(F.col("c_acctbal") > F.col("mean")).select("c_custkey")


@query("SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region FROM nation")
def join_single_correlated(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return J.single(table(spark, sf, "nation"), r, F.col("n_regionkey") == F.col("r_regionkey"), "region").select("n_name", "region")


@query("SELECT c_custkey, c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS flagged FROM customer")
def join_mark(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000")
    return J.mark(table(spark, sf, "customer"), big, [("c_custkey", "o_custkey")]).select("c_custkey", ((F.col("c_acctbal") < 0) | F.col("mark")).alias("flagged"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
def subquery_exists(spark, sf):
    large = table(spark, sf, "lineitem").where("l_quantity > 49")
    return J.exists(table(spark, sf, "orders"), large, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def subquery_not_exists(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 400000")
    return J.exists(table(spark, sf, "customer"), large, F.col("c_custkey") == F.col("o_custkey"), negated=True).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def subquery_in(spark, sf):
    return J.in_subquery(table(spark, sf, "part"), F.col("p_partkey"), table(spark, sf, "lineitem").where("l_discount > 0.09").select("l_partkey")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def subquery_not_in(spark, sf):
    return J.in_subquery(table(spark, sf, "part"), F.col("p_partkey"), table(spark, sf, "lineitem").where("l_discount > 0.09").select("l_partkey"), negated=True).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier)")
def subquery_any(spark, sf):
    return J.quantified(table(spark, sf, "customer"), F.col("c_acctbal"), ">", table(spark, sf, "supplier").select("s_acctbal")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < ALL (SELECT s_acctbal FROM supplier)")
def subquery_all(spark, sf):
    return J.quantified(table(spark, sf, "customer"), F.col("c_acctbal"), "<", table(spark, sf, "supplier").select("s_acctbal"), all_of=True).select("c_custkey")


# --- set operators


def _custkeys(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k2"))


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT l_suppkey FROM lineitem")
def union_all(spark, sf):
    return U.union(*_custkeys(spark, sf), all_rows=True)


@query("SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem")
def union_distinct(spark, sf):
    return U.union(*_custkeys(spark, sf))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def except_distinct(spark, sf):
    return U.except_(*_custkeys(spark, sf))


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def except_all(spark, sf):
    return U.except_(*_custkeys(spark, sf), all_rows=True)


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def intersect_distinct(spark, sf):
    return U.intersect(*_custkeys(spark, sf))


@query("SELECT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT l_suppkey FROM lineitem)")
def intersect_all(spark, sf):
    return U.intersect(*_custkeys(spark, sf), all_rows=True)


@query("SELECT r_name AS name, NULL::INTEGER AS n FROM region UNION ALL SELECT n_name, n_regionkey FROM nation")
def path_union(spark, sf):
    return R.union_paths(table(spark, sf, "region").select(F.col("r_name").alias("name")), table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("n")))


# --- windows and series


@query("SELECT event_id - event_id % 100 AS key, event_id - event_id % 100 AS window_start, event_id - event_id % 100 + 99 AS window_end, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def downsample_tumbling(spark, sf):
    return downsample(_events(spark, sf), 100, [F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total")], start=0, end=WHOLE)


@query("WITH b AS (SELECT min(event_id) AS lo FROM events) SELECT event_id - (event_id - lo) % 64 AS key, event_id - (event_id - lo) % 64 AS window_start, event_id - (event_id - lo) % 64 + 63 AS window_end, max(value) AS top FROM events, b GROUP BY 1, 2, 3")
def downsample_no_interval(spark, sf):
    return downsample(_events(spark, sf), 64, [F.max("value").alias("top")])


@query("SELECT s AS key, s AS window_start, s + 99 AS window_end, count(*) AS n FROM (SELECT i * 40 AS s FROM range(0, (SELECT max(event_id) // 40 + 1 FROM events)) t(i)) w JOIN events e ON e.event_id >= s AND e.event_id < s + 100 GROUP BY s")
def downsample_sliding(spark, sf):
    return downsample(_events(spark, sf), 100, [F.count("*").alias("n")], slide=40, start=0, end=WHOLE)


@query("SELECT event_id - event_id % 250 AS key, event_type, round(var_pop(value), 4) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def series_dev(spark, sf):
    return X.bucketed(_events(spark, sf), "value", "dev", 250, ["event_type"]).withColumn("value", F.round("value", 4))


@query("SELECT event_id - event_id % 250 AS key, list_sort(list(value))[CAST(floor(0.75 * (count(value) - 1)) AS BIGINT) + 1] AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def series_percentile(spark, sf):
    return X.bucketed(_events(spark, sf), "value", "percentile", 250, p=0.75)


@query("SELECT event_id - event_id % 50 AS key, last(value ORDER BY event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def series_last(spark, sf):
    return X.bucketed(_events(spark, sf), "value", "last", 50)


@query("SELECT key, user_id, round(d, 6) AS value FROM (SELECT event_id AS key, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events WHERE value IS NOT NULL) WHERE d IS NOT NULL")
def series_diff(spark, sf):
    return X.diff(_events(spark, sf).select(KEY, "user_id", "value"), "value", ["user_id"]).withColumn("value", F.round("value", 6))


@query("SELECT key, user_id, round(d, 6) AS value FROM (SELECT event_id AS key, user_id, (value - lag(value) OVER w) * 1000.0 / (event_id - lag(event_id) OVER w) AS d FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE d IS NOT NULL")
def series_rate(spark, sf):
    return X.rate(_events(spark, sf).select(KEY, "user_id", "value"), "value", 1000, ["user_id"]).withColumn("value", F.round("value", 6))


@query("SELECT key, user_id, round(d, 6) AS value FROM (SELECT event_id AS key, user_id, value * 1000.0 / (event_id - lag(event_id) OVER w) AS d FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE d IS NOT NULL")
def series_sampler(spark, sf):
    return X.sampler(_events(spark, sf).select(KEY, "user_id", "value"), "value", 1000, ["user_id"]).withColumn("value", F.round("value", 6))


@query("SELECT event_id AS key, value / 4.0 AS value FROM events WHERE value / 4.0 >= 10")
def series_div_filter(spark, sf):
    return X.filter_values(X.div(_events(spark, sf).select(KEY, "value"), "value", 4), "value", "gte", 10)


@query("SELECT event_id AS key, user_id, value FROM events WHERE event_id >= 50 AND event_id < 150")
def api_query_range(spark, sf):
    return X.query_range(_events(spark, sf), ["user_id", "value"], 50, 150)


@query('SELECT max(value) AS "max(value)", max(user_id) AS "max(user_id)" FROM events WHERE event_id >= 50 AND event_id < 450')
def api_aggregate_query(spark, sf):
    return X.aggregate_query(_events(spark, sf), ["value", "user_id"], "max", 50, 450)


# --- scalar expressions


@query("SELECT o_orderkey, o_orderkey / 7.0 AS q, o_orderkey % 7 AS m, -o_custkey AS neg, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE o_custkey / CAST(o_orderkey % 5 AS DOUBLE) END AS safe FROM orders")
def arithmetic(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(k, S.divide(k, F.lit(7)).alias("q"), S.modulo(k, F.lit(7)).alias("m"), (-c).alias("neg"), S.divide(c, k % 5).alias("safe"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band FROM orders")
def case_when(spark, sf):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", S.case_when([(S.compare(s, "=", F.lit("F")), F.lit(1)), (S.compare(s, "=", F.lit("O")), F.lit(2))], F.lit(0)).alias("code"), S.case_when([(p > 200000, F.lit("high")), (p > 100000, F.lit("mid"))]).alias("band"))


@query("SELECT p_partkey, substring(p_brand, 1, 5) AS b, CASE WHEN p_size = 0 THEN NULL ELSE p_retailprice / p_size END AS r FROM part")
def substring_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.substring(F.col("p_brand"), 1, 5).alias("b"), S.ratio(F.col("p_retailprice"), F.col("p_size")).alias("r"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders")
def extract_parts(spark, sf):
    ms = S.timestamp_key(F.col("o_orderdate"), "ms")
    return table(spark, sf, "orders").select("o_orderkey", *(S.extract(ms, p).alias(a) for p, a in (("year", "y"), ("month", "mo"), ("day", "d"), ("hour", "h"))))


@query("SELECT event_id, cos(value) AS c, pow(value, 2.0) AS p FROM events")
def native_functions(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", S.NATIVE["cos"](v).alias("c"), S.NATIVE["pow"](v, F.lit(2.0)).alias("p"))


def queries() -> dict[str, Query]:
    from . import sql_queries, tpch_queries  # noqa: F401  registers the dialect's queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import sql_queries, tpch_queries  # noqa: F401

    return dict(_SQL)
