import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from filigree import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s
