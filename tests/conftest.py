import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from metrolens.session import get_session

    builder = (SparkSession.builder.master("local[4]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="metrolens-test-ckpt-")))
    builder.getOrCreate()
    s = get_session()
    yield s
    s.stop()


def trips_df(spark, rows):
    """rows: (time_in, time_out, station_in, station_out, line_in, line_out) with ISO strings."""
    import datetime as dt

    from metrolens import schemas

    def ts(x):
        return None if x is None else dt.datetime.fromisoformat(x)
    data = [(ts(a), ts(b), c, d, e, f) for a, b, c, d, e, f in rows]
    return spark.createDataFrame(data, schemas.TRIPS)
