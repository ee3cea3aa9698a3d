import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidelog import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    out = session.build(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
