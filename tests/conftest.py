import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from canopyql.session import local_session

    os.environ.setdefault("CANOPYQL_DRIVER_MEMORY", "4g")
    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    # small tables: compiling stages takes longer than running them; registered queries run compiled in the oracle's comparison
    s.conf.set("spark.sql.codegen.wholeStage", os.environ.get("TEST_CODEGEN", "false"))
    yield s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
