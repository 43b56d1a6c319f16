import os

import pytest

from tracewell.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # one machine: a folder of its own is shared by all threads
    return build_session("tests", os.environ.get("TEST_CPUS", "8"), 4, shared=os.environ.get("TEST_SHARED_DIR") or str(tmp_path_factory.mktemp("shared")))
