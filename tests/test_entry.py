import __spark_entry__ as entry


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values()) and all(s.strip() for s in sql.values())


def test_flagship_query_runs(spark):
    out = entry.entry(spark)
    assert {"feature", "usd", "calls", "unpriced_calls"} <= set(out.columns) and out.count() == 3
