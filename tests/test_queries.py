"""Every registered endpoint query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidewell import plans


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracles())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, same):
    same(name, plans.queries()[name], plans.oracles()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["url"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_html_base64_on_large_keys(spark, tmp_path):
    """Keys as larger tables have them: the SQL bounds no port."""
    keys = [None, -1250, -7, -3, 0, 2, 14999, 64534, 64537, 64538, 64539, 64540, 98999, 99002, 899999, 2**40 + 4]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(own.execute(plans.oracles()["q_html_base64"]).fetchall())
    assert (64537, "http://9.9.37.7:65537") in want
    assert sorted(map(tuple, plans.queries()["q_html_base64"](spark, str(tmp_path)).collect())) == want
