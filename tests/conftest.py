import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])


@pytest.fixture(scope="session")
def spark():
    from tesela.session import ensure_checkpoint_dir, get_spark

    session = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ensure_checkpoint_dir(session)
    yield session
    session.stop()
