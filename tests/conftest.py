import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from statuspulse.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        4, app="tests", **{"spark.driver.memory": "4g", "spark.checkpoint.dir": shared}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
