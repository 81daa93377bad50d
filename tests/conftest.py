import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pinglake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})
    yield s


@pytest.fixture
def rows(spark):
    """Collect a frame as a sorted list of tuples."""

    def f(df, *cols):
        d = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in d.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))

    return f
