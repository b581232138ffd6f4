import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sample_data import SF_DIR  # noqa: E402

from newsloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.log.level": "ERROR",
                                "spark.ui.showConsoleProgress": "false"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from newsloom.fixtures import Tables

    return Tables(spark, SF_DIR)
