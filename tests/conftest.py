import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tickloom.session import GROUP_LIMIT_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", 8, {"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri()})
    yield session
    session.stop()


@pytest.fixture
def tight(spark):
    """Lets a task sort only a few rows per key, so that the split paths run."""
    spark.conf.set(GROUP_LIMIT_KEY, "16")
    yield spark
    spark.conf.unset(GROUP_LIMIT_KEY)
