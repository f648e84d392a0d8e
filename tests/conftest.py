import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scriptloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-tests-")
    s = session.build("tests", partitions=4, **{"spark.checkpoint.dir": f"{folder}/shared", "spark.local.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    session.ship(s)
    yield s
    s.stop()
