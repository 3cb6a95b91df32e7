import pytest

from corpusloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(catalogue.CASES))
def test_case_equals_sql(name, same_rows):
    same_rows(*catalogue.cases()[name])


def test_every_registered_query_reads_a_table(spark, tmp_path):
    from pyspark.errors import AnalysisException

    for name, query in QUERIES.items():
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            query(spark, str(tmp_path / "none"))
            raise AssertionError(name)


def test_every_sql_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


def test_rows_only_queries(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(5).count() > 0
