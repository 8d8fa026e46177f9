import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gridweather import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session.build("tests", "8", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    yield session.prepare(made)
    made.stop()
