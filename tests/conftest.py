import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from segflow.session import GROUP_ROWS, local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(params=["plain", "blocks"])
def form(request, spark):
    """Both physical forms: small groups in one window, and hot groups cut into blocks."""
    spark.conf.set(GROUP_ROWS, "1000000" if request.param == "plain" else "40")
    yield request.param
    spark.conf.unset(GROUP_ROWS)
