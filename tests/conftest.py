import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    spark = local_session(8, 8, "6g")
    yield spark
    spark.stop()
