import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strandline.session import local_session

    session = local_session(cores=8, partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
