import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")


def test_every_query_has_an_equivalent():
    assert set(E.queries()) - set(E._corpus()[0]) == set(E.oracle_sql()) - set(E._corpus()[1])


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - set(E._corpus()[1])))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)
