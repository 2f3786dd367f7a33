"""Every registered query against its SQL."""

import pytest

from workload.compare import connect, differences
from workload.oracle import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem, rows, _ = differences(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert problem is None
    assert rows > 0


def test_the_entry_stands_without_the_training_data_operators(tmp_path):
    """A package those need is missing: the other queries are all there."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['pyarrow'] = None; sys.modules['ahocorasick'] = None; "
            f"sys.path.insert(0, {root!r}); import __spark_entry__ as e; "
            "q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, dealt, piped = done.stdout.split()
    assert int(count) > 100 and dealt == piped == "False"
