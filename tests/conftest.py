import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from memlake.session import build_session

    s = build_session("tests", memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    from tools.check import connect

    return connect(SF)


@pytest.fixture
def tables(spark):
    from memlake.plans.registry import Tables

    return Tables(spark, SF)
