import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hearthline import HeatConfig  # noqa: E402
from hearthline.session import local_session, use_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("*", 4)
    use_folder(str(tmp_path_factory.mktemp("staged")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return HeatConfig()
