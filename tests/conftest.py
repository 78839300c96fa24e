import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flotilla.session import build_session

    session = build_session("local[*]", 8, app_name="flotilla-tests")
    # The shared checkpoint folder comes from the session (spark-defaults);
    # a temporary one is set only when none is configured.
    if not session.sparkContext.getConf().get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flotilla-test-ckpt-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fleet01(spark):
    from flotilla.plans.catalog import Fleet
    from flotilla.plans.queries import AS_OF

    return Fleet(spark, SF01, AS_OF)


@pytest.fixture(scope="session")
def fleet001(spark):
    from flotilla.plans.catalog import Fleet
    from flotilla.plans.queries import AS_OF

    return Fleet(spark, SF001, AS_OF)
