"""The SQL dialect over the small tables of hand-made examples, the point store, users, jobs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from keyloom.jobs import Job, next_run
from keyloom.plans.lexer import SqlError
from keyloom.plans.parser import parse
from keyloom.session import Session
from keyloom.sources import files
from keyloom.udf import adapter, frames, rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def s(spark, tmp_path):
    out = Session(spark, f"file://{tmp_path}/store")
    out.sql("INSERT INTO test (key, a, b, c) VALUES (0, 1, 2.0, 'x'), (1, 2, 3.0, 'y'), (2, 3, NULL, 'x');")
    return out


def test_upsert_keeps_what_is_not_set(s):
    s.sql("INSERT INTO test (key, b) VALUES (2, 9.5), (5, 1.5);")
    assert got(s.sql("SELECT a, b FROM test;")) == [(0, 1, 2.0), (1, 2, 3.0), (2, 3, 9.5), (5, None, 1.5)]
    s.sql("COMPACT;")
    assert got(s.sql("SELECT a, b FROM test;")) == [(0, 1, 2.0), (1, 2, 3.0), (2, 3, 9.5), (5, None, 1.5)]


def test_delete_ranges_and_columns(s):
    s.sql("DELETE FROM test.a WHERE key >= 1 AND key < 2;")
    assert got(s.sql("SELECT a, c FROM test;")) == [(0, 1, "x"), (1, None, "y"), (2, 3, "x")]
    s.sql("DELETE COLUMNS test.c;")
    assert got(s.sql("SHOW COLUMNS test.*;")) == [("test.a", "LONG"), ("test.b", "DOUBLE")]
    assert got(s.sql("COUNT POINTS;")) == [(4,)]
    s.sql("CLEAR DATA;")
    assert got(s.sql("COUNT POINTS;")) == [(0,)]


def test_names_of_results(s):
    assert s.sql("SELECT a, COUNT(b) FROM test GROUP BY a;").columns == ["test.a", "count(test.b)"]
    assert s.sql("SELECT COUNT(*) FROM test;").columns == ["count(test.a)", "count(test.b)", "count(test.c)"]


def test_group_having_order(s):
    assert [tuple(r) for r in s.sql("SELECT c, SUM(a) AS t FROM test GROUP BY c HAVING SUM(a) > 1 ORDER BY t DESC;").collect()] == [("x", 4), ("y", 2)]


def test_not_is_pushed_to_leaves(s):
    assert got(s.sql("SELECT a FROM test WHERE NOT (b > 2.5);")) == [(0, 1)]
    assert got(s.sql("SELECT a FROM test WHERE a IN (1, 3) AND c LIKE 'x';")) == [(0, 1), (2, 3)]
    assert got(s.sql("SELECT a FROM test WHERE !(c LIKE 'x.*');")) == [(1, 2)]


def test_subqueries(s):
    assert got(s.sql("SELECT a FROM test WHERE a > (SELECT AVG(a) FROM test);")) == [(2, 3)]
    assert got(s.sql("SELECT t.a FROM test AS t WHERE EXISTS (SELECT a FROM test AS u WHERE u.a = t.a + 1);")) == [(0, 1), (1, 2)]
    assert got(s.sql("SELECT a FROM test WHERE a >= ALL (SELECT a FROM test);")) == [(2, 3)]


def test_as_key_and_value2meta(s):
    assert s.sql("SELECT a AS KEY, c FROM test;").columns == ["key", "test.c"]
    s.sql("INSERT INTO names (key, suffix) VALUES (0, 'a'), (1, 'nothing');")
    assert s.sql("SELECT VALUE2META(SELECT suffix FROM names) FROM test;").columns == ["key", "test.a"]


def test_joins_and_set_operators(s):
    s.sql("INSERT INTO other (key, a, d) VALUES (0, 1, 'p'), (7, 3, 'q');")
    assert got(s.sql("SELECT test.c, other.d FROM test JOIN other ON test.a = other.a;")) == [("x", "p"), ("x", "q")]
    assert got(s.sql("SELECT test.c, other.d FROM test NATURAL JOIN other;")) == [("x", "p"), ("x", "q")]
    assert got(s.sql("SELECT test.c, other.d FROM test JOIN other USING KEY;")) == [(0, "x", "p")]
    assert got(s.sql("SELECT a FROM test UNION SELECT a FROM other;")) == [(0, 1), (1, 2), (2, 3), (7, 3)]


def test_explain_and_errors(s):
    assert "Project" in " ".join(r[0] for r in s.sql("EXPLAIN LOGICAL SELECT a FROM test;").collect())
    for bad in ("SELECT FROM test;", "SELECT nothing FROM test;", "SELEC a FROM test;", "SELECT a FROM missing;"):
        with pytest.raises(SqlError):
            s.sql(bad)
    assert parse("SELECT a.*, -3 + b FROM t WHERE a &> 5 || key < 2024-01-01 ORDER BY KEY DESC LIMIT 3 OFFSET 1;").kind == "ordered"


def test_users_config_rules(s):
    s.sql("CREATE USER ann IDENTIFIED BY secret;")
    s.sql("GRANT READ, WRITE TO USER ann;")
    assert ("ann", "READ,WRITE") in got(s.sql("SHOW USER;"))
    s.sql("SET RULES ConstantFolding=OFF;")
    assert got(s.sql("SHOW RULES;")) == [("ConstantFolding", "OFF")]
    s.sql("SET RULES ConstantFolding=ON;")
    s.sql("DROP USER ann;")


def test_csv_in_and_out(s, tmp_path):
    s.sql(f"SELECT a, c FROM test INTO OUTFILE 'file://{tmp_path}/out' AS CSV WITH HEADER;")
    s.sql(f"LOAD DATA FROM INFILE 'file://{tmp_path}/out' AS CSV SKIPPING HEADER INTO loaded (key, a, c);")
    assert got(s.sql("SELECT a, c FROM loaded;")) == [(0, 1, "x"), (1, 2, "y"), (2, 3, "x")]


def test_functions(s):
    s.register_udtf("add_one", lambda data, args, kvargs: [["v"], ["LONG"], [data[2][1] + 1]], [("v", "LONG")])
    assert got(s.sql("SELECT add_one(a) FROM test;")) == [(0, 2), (1, 3), (2, 4)]
    s.register_udsf("transpose", adapter.transpose, "`0` double, `1` double, `2` double")
    assert got(s.sql("SELECT transpose(a) FROM test;")) == [(1.0, 2.0, 3.0)]
    assert got(s.sql("SHOW FUNCTIONS;")) == [("add_one", "UDTF"), ("transpose", "UDSF")]


def test_jobs(s):
    s.register_transform("mean", frames.mean, "a double")
    job = Job([{"taskType": "sql", "sqlList": ["SELECT a AS a FROM test GROUP BY a;"]}, {"taskType": "python", "pyTaskName": "mean"}])
    number = s.jobs.commit(job)
    assert job.error is None and got(job.result) == [(2.0,)]
    assert got(s.sql(f"SHOW TRANSFORM JOB STATUS {number};")) == [("FINISHED",)]
    from datetime import datetime

    now = datetime(2024, 1, 1, 12, 0, 0)
    assert next_run("every 10 second", now, False).second == 10 and next_run("after 5 minute", now, True).minute == 5
    assert next_run("at 11:00:00", now, True).day == 2


def test_api_queries(s):
    assert got(s.query_data(["test.a"], 1, 3)) == [(1, 2), (2, 3)]
    assert got(s.aggregate_query(["test.a"], "max", 0, 3)) == [(3,)]
    assert got(s.downsample_query(["test.a"], "sum", 0, 4, 2)) == [(0, 0, 1, 3), (2, 2, 3, 3)]
    assert [len(p) for p in s.fetch(s.sql("SELECT a FROM test;"), 2)] == [2, 1]


def test_stream_into_the_store(spark, s, tmp_path):
    from keyloom.streaming import windows

    spark.createDataFrame([(json.dumps({"path": "m.x", "timestamp": 5, "value": 1.5}),), ("junk",)], "value string").write.parquet(f"file://{tmp_path}/in")
    raw = windows.file_stream(spark, f"file://{tmp_path}/in", "value string")
    query = windows.ingest(windows.parse_messages(raw).select("key", F.col("value").alias("m.x")), s.store, f"file://{tmp_path}/cp")
    query.awaitTermination()
    assert got(s.sql("SELECT x FROM m;")) == [(5, 1.5)]


def test_schedules():
    from datetime import datetime

    from keyloom.jobs import cron_next

    now = datetime(2024, 1, 31, 12, 0, 0)  # a Wednesday
    assert cron_next("0 30 9 ? * mon-fri", now) == datetime(2024, 2, 1, 9, 30)
    assert cron_next("*/20 * * * * ?", now) == datetime(2024, 1, 31, 12, 0, 20)
    assert cron_next("0 0 0 29 feb ? 2028", now) == datetime(2028, 2, 29) and cron_next("0 0 0 30 2 ?", now) is None
    assert next_run("(0 0 13 * * ?)", now, True).hour == 13
    assert next_run("every '13:00:00' on mon,thu", now, True) == datetime(2024, 2, 1, 13)
    assert next_run("every 1 month", now, False) == datetime(2024, 2, 29, 12)
    assert next_run("every 3 minute starts '13:00:00' ends '14:00:00'", now, True).hour == 13
    assert next_run("every 3 hour ends '14:00:00'", now, False) is None
    with pytest.raises(ValueError):
        next_run("sometimes", now, True)


def test_a_job_may_go_on_after_a_failure(s):
    bad = [{"taskType": "sql", "sqlList": ["SELECT nothing FROM test;"]}]
    stops, goes_on = Job(bad), Job(bad, stop_on_failure=False)
    s.jobs.commit(stops), s.jobs.commit(goes_on)
    assert (stops.state, goes_on.state) == ("FAILED", "PARTIALLY_FAILED") and stops.error
    good = Job([{"taskType": "sql", "sqlList": ["SELECT a FROM test;"]}], schedule="after 0 second")
    s.jobs.commit(good)
    import time

    for _ in range(200):
        if good.state == "FINISHED":
            break
        time.sleep(0.1)
    assert good.runs == 1 and good.state == "FINISHED"


def test_quantified_and_marks_under_or(s):
    assert got(s.sql("SELECT a FROM test WHERE a = 1 OR a >= ALL (SELECT a FROM test);")) == [(0, 1), (2, 3)]
    assert got(s.sql("SELECT a FROM test WHERE a = 1 OR a < ANY (SELECT a FROM test WHERE a < 3);")) == [(0, 1)]
    assert got(s.sql("SELECT a FROM test WHERE b > 100 OR a = ANY (SELECT a FROM test WHERE c LIKE 'y');")) == [(1, 2)]
    assert got(s.sql("SELECT a FROM test WHERE b > 100 OR a != ALL (SELECT a FROM test WHERE c LIKE 'y');")) == [(0, 1), (2, 3)]
    assert got(s.sql("SELECT t.a FROM test AS t WHERE t.a = 2 OR t.a > ALL (SELECT u.a FROM test AS u WHERE u.c = t.c AND u.a < 3);")) == [(1, 2), (2, 3)]


def test_nulls_fail_comparisons_either_way(s):
    # b is null at key 2.
    assert got(s.sql("SELECT a FROM test WHERE b > 2.5 OR b <= 2.5;")) == [(0, 1), (1, 2)]
    assert got(s.sql("SELECT a FROM test WHERE NOT (b > 2.5 AND a > 0);")) == [(0, 1)]
    assert got(s.sql("SELECT a FROM test WHERE b NOT IN (2.0, 7.0);")) == [(1, 2)]
    assert got(s.sql("SELECT a, CASE WHEN b > 2.5 THEN 1 ELSE 0 END AS x FROM test;")) == [(0, 1, 0), (1, 2, 1), (2, 3, 0)]


def test_compaction_that_stops_half_way_brings_nothing_back(s):
    s.sql("DELETE FROM test.a WHERE key = 1;")
    fs_names = lambda: [n for n in s.store._names(s.store.path) if n.startswith("write=")]
    old, want = fs_names(), got(s.sql("SELECT a, b, c FROM test;"))
    s.store.read().write.parquet(f"{s.store.path}/write={s.store._next():012d}")
    for n in old:  # compaction removes these first
        assert got(s.sql("SELECT a, b, c FROM test;")) == want
        fs, p = s.store._fs(f"{s.store.path}/{n}")
        fs.delete(p, True)
    assert got(s.sql("SELECT a, b, c FROM test;")) == want
    s.sql("COMPACT;")
    assert got(s.sql("SELECT a, b, c FROM test;")) == want
    assert len({s.store._next() for _ in range(3)}) == 3


def test_set_functions_over_different_cases(s):
    found = s.sql("SELECT SUM(CASE WHEN a = 1 THEN 1 ELSE 0 END) AS x, SUM(CASE WHEN a <> 1 THEN 1 ELSE 0 END) AS y FROM test;")
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_set_functions_with_different_arguments(s):
    s.register_udaf("over", lambda data, args, kvargs: [["n"], ["LONG"], [sum(r[1] > args[0] for r in data[2:])]], "bigint")
    assert [tuple(r)[-2:] for r in s.sql("SELECT over(a, 0) AS x, over(a, 2) AS y FROM test;").collect()] == [(3, 1)]


def test_set_functions_see_rows_without_holding_them(s, monkeypatch):
    """Groups larger than what stays in memory go through a file; functions that go over their rows hold none."""
    monkeypatch.setattr(rows, "IN_MEMORY", 1000)
    n, spark = 50_000, s.spark
    s.mount("big", spark.range(n).selectExpr("id AS key", "id % 2 AS g", "IF(id = 7, NULL, CAST(id AS DOUBLE)) AS v", "CAST(id AS STRING) AS w"))

    def seen(data, args, kvargs):
        body = data[2:]
        assert not isinstance(data, list) and data[:2] == [["key", "big.v", "big.w"], ["LONG", "DOUBLE", "DOUBLE"]]
        assert len(data) == len(body) + 2 == n // 2 + 2 and data[2] == body[0] and list(reversed(body))[0] == body[-1] == data[len(data) - 1]
        assert [body[i] for i in range(0, len(body), 997)] == list(body[::997]) and not data[len(data) :]
        return [["n"], ["DOUBLE"], [sum(r[0] + int(r[2]) for r in data[2:]) + sum(r[1] is None for r in body)]]

    def held(data, args, kvargs):
        import tracemalloc

        tracemalloc.start()
        for r in data[2:]:
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return [["n"], ["DOUBLE"], [peak / len(data)]]

    s.register_udaf("seen", seen, "bigint")
    s.register_udaf("held", held)
    want = [(g, 2 * sum(range(g, n, 2)) + g) for g in (0, 1)]
    assert sorted(tuple(r) for r in s.sql("SELECT g, seen(v, w) AS n FROM big GROUP BY g;").collect()) == want
    # A row as a list takes over 100 bytes; two batches of 10,000 rows are held at most.
    monkeypatch.setattr(rows, "HELD", 1)
    s.mount("long", spark.range(0, 400_000, 1, 2).selectExpr("id AS key", "CAST(id AS DOUBLE) AS v"))
    assert s.sql("SELECT held(v) AS n FROM long;").first()[0] < 20
    with pytest.raises(ValueError, match="beside others"):
        s.sql("SELECT held(v), COUNT(v) FROM long;")


def test_documents_columns_and_saved_series(s, tmp_path):
    (tmp_path / "d.json").write_text('{"id": 7, "o": {"x": 1, "deep": {"y": "z"}}, "l": [1, 2]}\n{"id": 9, "o": {"x": 2}}\n')
    s.mount("doc", files.read_json(s.spark, str(tmp_path / "d.json"), key="id"))
    assert got(s.sql("SELECT o.x, o.deep.y, l FROM doc;")) == [(7, 1, "z", "[1,2]"), (9, 2, None, None)]
    s.insert_columns(["c.a", "c.b"], [4, 5], [[1, 2], ["u", None]])
    assert got(s.sql("SELECT a, b FROM c;")) == [(4, 1, "u"), (5, 2, None)]
    s.save_as(s.sql("SELECT a FROM c;"), "kept.a")
    assert got(s.sql("SELECT a FROM kept;")) == [(4, 1), (5, 2)]
