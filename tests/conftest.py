import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from foldspark.session import local_session

    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def small_ranks(spark):
    """Force the bucketed rank paths on small data."""
    spark.conf.set("foldspark.rank.plainBytes", "1")
    spark.conf.set("foldspark.rank.hotRows", "10")
    yield
    spark.conf.unset("foldspark.rank.plainBytes")
    spark.conf.unset("foldspark.rank.hotRows")
