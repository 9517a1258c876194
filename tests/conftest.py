import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quire.session import session

    spark = session(4, "4g")
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
