import pytest

from oracle_check import differences
from palimpsest.plans.oracle import ORACLE_SQL
from palimpsest.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_codec_query_round_trips(spark):
    assert QUERIES["codec_round_trip"](spark, SF).where("not same").count() == 0


def test_alias_chains_on_both_sides_of_the_first_key(spark, tmp_path):
    spark.range(-9, 13).withColumnRenamed("id", "p_partkey").toPandas().to_parquet(tmp_path / "part.parquet")
    got = QUERIES["alias_chains"](spark, str(tmp_path))
    assert differences(got, ORACLE_SQL["alias_chains"], str(tmp_path)) is None
    assert got.where("name = '0'").first()[1:] == ("1", -1)
