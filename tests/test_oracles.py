import pytest

from turfline.plans import app_queries, identity_queries, interval_queries, job_queries, metric_queries

from .support import DATA, check_oracle

MODULES = [metric_queries, app_queries, interval_queries, identity_queries, job_queries]
ORACLES = {name: (m.QUERIES[name], sql) for m in MODULES for name, sql in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    check_oracle(spark, *ORACLES[name])


def test_every_query_has_sql_or_a_test():
    without = {n for m in MODULES for n in m.QUERIES if n not in m.ORACLES}
    assert without == {"svd_vectors"}


def test_svd_vectors(spark):
    rows = metric_queries.svd_vectors(spark, DATA).collect()
    assert all(len(r["style_vec"]) == 32 and len(r["quality_vec"]) == 32 and not any(r["style_vec"][23:]) for r in rows)
