import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, app_name="tallyloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tallyloom.sources.tables import shop_tables_from_tpch
    return shop_tables_from_tpch(spark, SF_SMALL)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tallyloom-test-")
