import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storelens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="storelens-test-ckpt-")
    extra = {"spark.checkpoint.dir": ckpt}
    partitions = 8
    if os.environ.get("STORELENS_TEST_SPREAD"):
        # every shuffle keeps all its partitions: no test may pass because
        # groups or blocks happened to share one
        extra["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
        partitions = 32
    s = build_session("local[*]", partitions, extra=extra)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (tests only)."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
