import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tabscope.session import build_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return build_session(
        "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest tables."""
    return str(DATA / "sf0.001")


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    before = {}

    def put(values):
        for name, value in values.items():
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
