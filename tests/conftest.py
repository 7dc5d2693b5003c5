import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    if not Path(DATA).is_dir():
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture()
def staging(spark, tmp_path):
    from millrace.staging import Staging

    return Staging(spark, str(tmp_path))
