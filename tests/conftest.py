import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master("local[*]")
               .appName("surveyspark-tests")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC"))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # Tests run locally: a scratch checkpoint folder only where none is set.
    from surveyspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="surveyspark-test-")
