import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronolake.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", spark__sql__shuffle__partitions="4", spark__default__parallelism="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    """Rows as sorted tuples; NULLs first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, tuple)) else (True, "", str(x)) for x in t))
