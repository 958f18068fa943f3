"""What differs from plain SQL: names, nulls, patterns, division, windows, set operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import scalar as S
from keyloom.model import KEY, expand, matches, split_tags, tag_equals, tagged, with_tags, without_tags
from keyloom.operators import joins as J
from keyloom.operators import relational as R
from keyloom.operators import series as X
from keyloom.operators import setops as U
from keyloom.operators.curve import best_match, dtw
from keyloom.operators.windows import downsample


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_patterns_span_dots():
    assert matches("us.*", "us.d1.s1") and matches("*.s1", "us.d1.s1") and not matches("us.d2.*", "us.d1.s1")


def test_tags(spark):
    df = with_tags(spark.createDataFrame([(0, 1, 2)], "key long, s long, v long"), "s", {"t1": "v1"})
    assert tagged("s", {"t1": "v1"}) in df.columns and split_tags("s{t1=v1}") == ("s", {"t1": "v1"})
    assert expand(df, "*", tag_equals("t1", "*")) == ["s{t1=v1}"] and expand(df, "*", without_tags) == ["v"]


def test_division_and_modulo(spark):
    df = spark.createDataFrame([(7, 2), (1, 0), (-1, 0), (0, 0), (None, 1)], "a int, b int")
    out = [r[0] for r in df.select(S.divide(F.col("a"), F.col("b"))).collect()]
    assert out[:3] == [3.5, math.inf, -math.inf] and math.isnan(out[3]) and out[4] is None
    assert [r[0] for r in df.select(S.modulo(F.col("a"), F.col("b"))).collect()] == [1, None, None, None, None]


def test_like_is_a_full_match(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",), (None,)], "s string")
    assert [r[0] for r in df.select(S.like(F.col("s"), "a.")).collect()] == [True, False, False, False]


def test_comparisons_with_null_are_false(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert got(R.select(df, S.compare(F.col("a"), "!=", F.lit(5)))) == [(1,)]


def test_all_set_operators_keep_left_duplicates(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "a int, b int")
    right = spark.createDataFrame([(1, None)], "a int, b int")
    assert got(U.except_(left, right, all_rows=True)) == [(2, 5), (2, 5)]
    assert got(U.intersect(left, right, all_rows=True)) == [(1, None), (1, None)]
    with pytest.raises(ValueError):
        U.union(left, right.select("a"))


def test_not_in_is_not_blanked_by_a_null(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (None,)], "b int")
    assert got(J.in_subquery(left, F.col("a"), right, negated=True)) == [(1,)]
    assert got(J.in_subquery(left, F.col("a"), right)) == [(2,)]


@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("all_of", [True, False])
@pytest.mark.parametrize("values", [[], [2], [1, 3], [2, 2], [1, 2, 3]])
def test_quantified(spark, op, all_of, values):
    import operator

    f = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    left = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    right = spark.createDataFrame([(v,) for v in values], "b int")
    want = [(x,) for x in (1, 2, 3) if (all if all_of else any)(f(x, v) for v in values)]
    assert got(J.quantified(left, F.col("a"), op, right, all_of)) == want


def test_single_join_allows_one_match(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1, 10), (3, 30)], "b int, v int")
    assert got(J.single(left, right, F.col("a") == F.col("b"), "v")) == [(1, 10), (2, None)]
    twice = right.union(right)
    with pytest.raises(Exception, match="more than one row"):
        J.single(left, twice, F.col("a") == F.col("b"), "v").collect()


def test_align_and_using_key(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "key long, x int")
    b = spark.createDataFrame([(1, 5), (2, 6)], "key long, y int")
    assert got(J.align(a, b)) == [(0, 1, None), (1, 2, 5), (2, None, 6)]
    assert got(J.using_key(a, b)) == [(1, 2, 5)]


def test_as_key_rejects_repeated_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(Exception, match="more than once"):
        R.as_key(df, "a").collect()


def test_sliding_windows_without_interval(spark):
    df = spark.range(301, 600).select(F.col("id").alias(KEY), F.col("id").alias("v"))
    out = downsample(df, 100, [F.count("v").alias("n")], slide=50)
    assert [r.key for r in out.orderBy(KEY).collect()] == [301, 351, 401, 451, 501]


def test_first_and_last_rows_skip_nulls(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, 5, None), (2, 7, None)], "key long, a int, b string")
    assert got(X.first_last(df, "first")) == [(0, "b", "x"), (1, "a", "5")]
    assert got(X.first_last(df, "last")) == [(0, "b", "x"), (2, "a", "7")]


def test_remove_null_columns_and_paths(spark):
    df = spark.createDataFrame([(0, None, 1)], "key long, a int, b int")
    assert R.remove_null_columns(df).columns == [KEY, "b"]
    assert R.values_to_paths(spark.createDataFrame([("x", ""), (None, "y")], "a string, b string"), "p") == ["p.x", "p.y"]


def test_sequence_follows_the_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.s == 5 + 3 * r.x for r in R.add_sequence(df, [F.col("x")], "s", 5, 3).collect())


def test_dates_and_durations():
    assert S.date_nanos("2024-01-01 00:00:01") - S.date_nanos("2024/01/01") == 10**9
    assert S.duration("1h30m") == 5400 * 10**9 and S.duration("7") == 7


def test_curve_matching_agrees_with_plain_search():
    rng = np.random.default_rng(3)
    values, curve, band = rng.normal(size=60), rng.normal(size=9), 3
    from keyloom.operators.curve import normal

    plain = [dtw(normal(values[i : i + 9]), normal(curve), band) for i in range(52)]
    at, d = best_match(np.arange(60), values, curve, band)
    assert at == int(np.argmin(plain)) and abs(d - min(plain)) < 1e-9


def plain_match(keys, values, curve, band):
    from keyloom.operators.curve import normal

    n = len(curve)
    d = [dtw(normal(values[i : i + n]), normal(np.asarray(curve, float)), band) for i in range(len(values) - n + 1)]
    return (keys[int(np.argmin(d))], min(d)) if d else None


def test_curve_matching_in_chunks_agrees_with_plain_search(spark):
    from keyloom.operators.curve import curve_match

    rng = np.random.default_rng(4)
    curve = [1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 1.0, 2.0]
    columns = {"a": list(rng.normal(size=300)), "b": list(rng.normal(size=300)), "c": [1.0] * 300, "d": [1.0, None, *[None] * 291, *range(7)]}
    columns["a"][95:103] = [10 * v for v in curve]  # lies over the cut at 100
    columns["b"][40:48] = columns["b"][240:248] = curve
    columns["b"][3:200:9] = [None] * 22
    rows = [(-500 + 7 * i, *(None if columns[c][i] is None else float(columns[c][i]) for c in "abcd")) for i in range(300)]
    df = spark.createDataFrame(rows, f"{KEY} long, a double, b double, c double, d double").repartition(5)
    want = {}
    for k, c in enumerate("abcd"):
        known = [(r[0], r[1 + k]) for r in rows if r[1 + k] is not None]
        want[c] = plain_match([x for x, _ in known], np.array([v for _, v in known]), curve, 5)
    assert want["a"][0] == -500 + 7 * 95
    for chunk in (1, 20, 1000):
        found = {r.path: (r[KEY], r.distance) for r in curve_match(df, list("abcd"), curve, chunk=chunk).collect()}
        assert set(found) == set("abcd")
        for c in "abcd":
            assert found[c][0] == want[c][0] and abs(found[c][1] - want[c][1]) < 1e-9, (chunk, c)
    assert curve_match(df.limit(0), ["a"], curve).count() == 0 and curve_match(df.limit(7), ["a"], curve).count() == 0


def test_curve_matching_searches_all_events(spark):
    from keyloom.queries import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("value IS NOT NULL").orderBy("event_id").toPandas()
    at, d = plain_match(events.event_id.tolist(), events.value.to_numpy(float), [1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 1.0, 2.0], 5)
    (found,) = queries()["curve_matching"](spark, "/root/testdata/sf0.001").collect()
    assert at >= 400 and found[KEY] == at and abs(found.distance - d) < 1e-9


@pytest.mark.parametrize("per_range", [7, 1000])
def test_one_series_is_cut_into_ranges(spark, per_range):
    rows = [(3 * k + k % 2, None if k % 11 == 5 else float(k * k % 17)) for k in range(200)]
    df = spark.createDataFrame(rows, "key long, v double").repartition(3)
    full = [r for r in rows if r[1] is not None]
    pairs = list(zip(full, full[1:], strict=False))
    got = lambda out: [(r[0], round(r[1], 9)) for r in out.orderBy("key").collect()]
    assert got(X.diff(df, "v", per_range=per_range)) == [(b[0], b[1] - a[1]) for a, b in pairs]
    assert got(X.rate(df, "v", 10, per_range=per_range)) == [(b[0], round((b[1] - a[1]) * 10 / (b[0] - a[0]), 9)) for a, b in pairs]
    assert got(X.sampler(df, "v", 10, per_range=per_range)) == [(b[0], round(b[1] * 10 / (b[0] - a[0]), 9)) for a, b in pairs]
    assert got(X.diff(df.where("v IS NULL"), "v", per_range=per_range)) == []


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 1.0])
def test_percentiles_are_exact(spark, p):
    rows = [(k, "ab"[k % 2], None if k % 7 == 0 else float(k * k % 5)) for k in range(60)]
    found = X.bucketed(spark.createDataFrame(rows, "key long, g string, v double"), "v", "percentile", 20, ["g"], p=p)
    values = {}
    for k, g, v in rows:
        if v is not None:
            values.setdefault((k // 20 * 20, g), []).append(v)
    assert sorted(map(tuple, found.collect())) == sorted((*b, sorted(v)[int(p * (len(v) - 1))]) for b, v in values.items())
