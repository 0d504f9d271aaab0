import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (of the given columns), in the frame's order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
