import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerflow.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("ledgerflow-tests", cpus=4, shuffle_partitions=4, driver_memory="4g")
    checkpoint_dir(s)          # unset in tests: a scratch folder is registered
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples of the selected columns."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
