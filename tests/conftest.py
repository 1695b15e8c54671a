import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from matfold.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8, app_name="matfold-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples (ordered as returned)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
