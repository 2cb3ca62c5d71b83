import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# the workers have to find the package and the functions that tests hand over
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("QUERN_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    s = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as a sorted list of tuples, nulls as they are."""

    def of(df, *columns):
        got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(got, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))

    return of
