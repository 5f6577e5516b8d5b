import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


def pytest_configure(config):
    config.addinivalue_line("markers", "oracles: every query of the core with SQL against DuckDB; run by -m oracles only")


def pytest_collection_modifyitems(config, items):
    if "oracles" not in (config.getoption("-m") or ""):
        for item in items:
            if "oracles" in item.keywords:
                item.add_marker(pytest.mark.skip(reason="asked for by -m oracles"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
