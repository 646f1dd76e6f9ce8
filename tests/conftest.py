import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kohorta.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def cohort(spark):
    """50 records, 30 Control and 20 Pathological, with one shifted and one duplicated feature."""
    import numpy as np

    rng = np.random.default_rng(42)
    rows = []
    for i in range(50):
        sick = i >= 30
        good = float(rng.normal(2.0 if sick else 0.0))
        rows.append((f"r{i:02d}", "Pathological" if sick else "Control", good, good + float(rng.normal(scale=0.01)),
                     float(rng.normal()), 5.0, float(rng.normal(scale=0.01))))
    return spark.createDataFrame(
        rows, "Record string, Diagnosed string, good double, copy double, noise double, constant double, tiny double")
