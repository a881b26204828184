import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chronofold.sources.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", partitions=2)
    yield session
    session.stop()


_COLUMNS = (
    "record_id long, user_id long, task_name string, subtask string, tag string, date date, "
    "elapsed_s long"
)


@pytest.fixture
def make_records(spark):
    """Records from (date, task) or (date, task, seconds[, user, subtask, tag]) tuples."""

    def make(*rows):
        full = []
        for number, row in enumerate(rows):
            date, task, *rest = row
            seconds, user, subtask, tag = [*rest, *(300, 1, None, None)[len(rest) :]]
            full.append((number, user, task, subtask, tag, dt.date.fromisoformat(date), seconds))
        return spark.createDataFrame(full, _COLUMNS)

    return make
