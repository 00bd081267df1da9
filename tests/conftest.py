import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wellkin import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session.local(8, "tests")
    yield made
    made.stop()
