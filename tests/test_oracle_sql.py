"""Every oracle SQL runs in DuckDB on the smoke tables (no Spark needed)."""
import os

import duckdb

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_oracle_sql_runs():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{E.SMOKE_DIR}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sqls = E.oracle_sql()
    assert set(sqls) <= set(E.queries())
    for name, sql in sqls.items():
        rel = con.sql(sql)
        assert len(rel.columns) == len(set(rel.columns)), name
        rel.fetchall()
