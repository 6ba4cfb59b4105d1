import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

from check import session  # noqa: E402
from creditloom.plans.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return tune(session())
