import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{place}/shared")
        .config("spark.sql.warehouse.dir", f"{place}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


GRID = {"transform": (10.0, 0.0, 500000.0, 0.0, -10.0, 4200000.0), "crs": "EPSG:32633"}


@pytest.fixture
def raster(spark):
    """A function that makes rasters of arrays on the shared grid."""
    from gridloom import load_array

    return lambda array, **options: load_array(np.asarray(array), spark=spark, **(GRID | options))


@pytest.fixture
def gappy(raster):
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    a[:2, :2] = -9999
    return raster(a, nodata=-9999)
