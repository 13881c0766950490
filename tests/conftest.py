import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import get_spark

    return get_spark(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
