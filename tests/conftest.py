import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from planspark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", master="local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g",
        "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    s.sparkContext.setLogLevel("ERROR")
    return s
