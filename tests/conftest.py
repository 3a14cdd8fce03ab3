import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import build_session
    s = build_session("local[4]", app="vigil-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def make_files(spark):
    def build(files: dict, package: str = "pkg"):
        rows = [(package, p, len(c.encode()), c) for p, c in files.items()]
        return spark.createDataFrame(rows, "package_id string, path string, size long, content string")
    return build


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
