import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievework.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
