import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from axisframe.session import ship

    return ship(session)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs, with further columns whose names clash with the operators' own."""

    def build(rows, **extra):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), i, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA + ", id long, component_id string, score int")

    return build
