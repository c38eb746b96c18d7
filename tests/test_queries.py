import __spark_entry__ as entry
import pytest
from oracle import assert_same

from rowanmill.plans import catalog

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql_twin(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF01).count() > 0  # the smallest tables have no two phones alike


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ordinal", "country", "leads_this_week", "total_leads"] and df.count() >= 4


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["clean_cells", "clean_dates", "clean_enums", "clean_social", "cell_keys"])
def test_cell_queries_read_all_orders(spark, name):
    assert catalog.QUERIES[name](spark, SF01).count() == spark.read.parquet(f"{SF01}/orders.parquet").count() > 2001
    assert_same(catalog.QUERIES[name](spark, SF01), catalog.ORACLE_SQL[name], SF01)


def test_address_parts_reads_all_orders(spark):
    assert catalog.QUERIES["address_parts"](spark, SF01).count() == spark.read.parquet(f"{SF01}/orders.parquet").count() > 501
    assert_same(catalog.QUERIES["address_parts"](spark, SF01), catalog.ORACLE_SQL["address_parts"], SF01)
