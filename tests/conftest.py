import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidepanel.scale import clear_stages  # noqa: E402
from tidepanel.session import panel_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = panel_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_stages(session)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
