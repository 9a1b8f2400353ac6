import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from convolens.session import AS_OF_DEFAULT, get_spark  # noqa: E402

AS_OF = datetime.fromisoformat(AS_OF_DEFAULT)


@pytest.fixture(scope="session")
def spark():
    s = get_spark(app="convolens-tests", master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture
def make_messages(spark):
    """Build a message table from (phone, minutes_before_as_of, sender, text) rows."""

    def build(rows):
        data = []
        for i, (phone, minutes, sender, text) in enumerate(rows):
            data.append((phone, i, AS_OF - timedelta(minutes=minutes), sender, text))
        return spark.createDataFrame(
            data, "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string"
        )

    return build
