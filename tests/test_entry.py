"""Driver contract: entry() runs, registry keys are consistent."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"package_id", "grade"}
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_some_queries_run_on_smoke_data(spark):
    q = E.queries()
    for k in ["p1_credentials", "m4_typosquat", "r1_crontab", "grade_distribution"]:
        assert q[k](spark, E.SMOKE_DIR).count() > 0
