import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from shelfwatch.session import session

    s = session("tests", cores=8, shuffle_partitions=8, extra={"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh")), "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
