import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def batch(spark, sf):
    """Parsed schedule, indexed matches with event targets and the feature table, built once."""
    from touchline.plans import features as ft
    from touchline.session import materialize
    from touchline.views import view

    schedule, events = view(spark, sf, "v_schedule"), view(spark, sf, "v_match_events")
    parsed = materialize(ft.parsed_matches(schedule))
    return {
        "schedule": schedule, "events": events, "parsed": parsed,
        "matches": materialize(ft.indexed_matches(parsed, events)),
        "table": materialize(ft.feature_table(schedule, events)),
    }
