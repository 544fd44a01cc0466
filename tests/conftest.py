import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docmill.session import local_session

    base = tmp_path_factory.mktemp("spark")
    session = local_session(
        4,
        "4g",
        **{
            "spark.checkpoint.dir": f"file://{base}/shared",
            "spark.sql.warehouse.dir": f"file://{base}/warehouse",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
