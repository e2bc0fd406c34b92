import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fibrelark.session import local_session

    # Tables here are tiny: compiling plans would take longer than running them.
    session = local_session(cores=4, memory="4g", spark__sql__codegen__wholeStage="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
