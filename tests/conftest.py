import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CLAIM = ("id string, seq bigint, subject string, slot string, value string, "
         "valid_from timestamp_ntz, recorded_at timestamp_ntz, revokes string")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from twoclock.session import build_session
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return datetime.fromisoformat(text)


@pytest.fixture
def claims(spark):
    """Claims from (subject, slot, value, valid_from, recorded_at, revoked row or None);
    ids and seq follow the order written."""
    def make(rows):
        out = []
        for n, (subject, slot, value, vf, ra, revokes) in enumerate(rows):
            out.append((f"c{n}", n + 1, subject, slot, value, day(vf), day(ra),
                        None if revokes is None else f"c{revokes}"))
        return spark.createDataFrame(out, CLAIM)
    return make
