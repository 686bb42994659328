import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark import get_session
    s = get_session("local[*]", 8, app_name="tallyspark-tests")
    from tallyspark import checkpoint_dir
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tallyspark-test-")


def strings(spark, header, rows):
    """All-string DataFrame from rows (None stays NULL)."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    data = [tuple(None if v is None else str(v) for v in r) for r in rows]
    return spark.createDataFrame(data, schema)
