import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnloom.session import local_session  # noqa: E402
from turnloom.streaming.jobs import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("turnloom-tests", 8, partitions=3)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield s
    s.stop()


def make_turns(spark, conversations):
    """{conv: [(role, content), ...]} -> turns of one document "d"."""
    rows = [
        ("d", conv, pos, i, f"{conv}_t{i}", role, content)
        for pos, (conv, turns) in enumerate(conversations.items())
        for i, (role, content) in enumerate(turns)
    ]
    return spark.createDataFrame(
        rows, "doc_id string, conv_id string, conv_pos long, idx int, turn_id string, role string, content string"
    )


@pytest.fixture
def turns(spark):
    return lambda conversations: make_turns(spark, conversations)
