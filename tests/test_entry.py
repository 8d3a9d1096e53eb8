import __spark_entry__ as entry_module


def test_flagship(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 6 and all(r.min_qty >= 10 for r in rows)


def test_catalogue():
    queries, twins = entry_module.queries(), entry_module.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 280
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in twins.values())
