import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tramline.session import build_session

    s = build_session("tests", "local[8]", 4, str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
