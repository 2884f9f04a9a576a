import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tillpoint.session import get_session
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    s = get_session(master="local[*]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "8g", "spark.sql.warehouse.dir": warehouse})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from seed import seed_tables
    return seed_tables(spark)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
