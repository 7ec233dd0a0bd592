import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from footmark.session import local_session
    return local_session("4", {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})


@pytest.fixture(scope="session")
def rules():
    from footmark.functions.rules import default_rules
    return default_rules()
