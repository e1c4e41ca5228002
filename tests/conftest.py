import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from doccat.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app="doccat-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect to a list of tuples in a stable order (tests only, tiny frames)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
