import __spark_entry__ as entry


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns[0] == "l_returnflag"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
