import os
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from factloom.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), 4)
    # tiny tables: compiling a plan costs more than running it
    session.conf.set("spark.sql.codegen.wholeStage", os.environ.get("TEST_CODEGEN", "false"))
    return session
