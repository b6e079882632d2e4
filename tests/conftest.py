import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from apronflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), "apronflow-tests")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample_flights(spark):
    rows = [
        (1, "FL001", "TunisAir", "T1", "T1-G1", 85.0, "Storm", 8, 1, 0),
        (2, "FL002", "Air France", "T2", "T2-G2", 20.0, "Clear", 14, 0, 1),
        (3, "FL003", "Emirates", "T3", "T3-G1", 5.0, "Clear", 10, 0, 0),
        (4, "FL004", "TunisAir", "T1", "T1-G2", 110.0, "Rain", 17, 1, 0),
        (5, "FL005", "Lufthansa", "T2", "T2-G1", 12.0, "Cloudy", 9, 1, 1),
    ]
    return spark.createDataFrame(
        rows,
        """seq INT, flight_id STRING, airline STRING, terminal STRING, gate STRING,
        delay_minutes DOUBLE, weather STRING, departure_hour INT, is_peak_hour INT, is_weekend INT""",
    )
