import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from logsift.session import build_session
    s = build_session("local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="logsift-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture
def nothing_stays_cached(spark):
    """What a test leaves persisted fails it."""
    kept = lambda: {str(k) for k in spark.sparkContext._jsc.getPersistentRDDs().keySet()}
    before = kept()
    yield
    assert kept() <= before


def lines_df(spark, sessions: dict[str, list[str]], stride: int = 1, offset: int = 0):
    """(session_id, ord, line) with ords ``offset + i * stride`` (sparse when stride > 1)."""
    rows = [(sid, offset + i * stride, line) for sid, ls in sessions.items() for i, line in enumerate(ls)]
    return spark.createDataFrame(rows, "session_id string, ord long, line string")


def fixture_lines(name: str) -> list[str]:
    with open(os.path.join(DATA, name), encoding="utf-8") as f:
        return f.read().splitlines()


def large_1000_lines() -> list[str]:
    """The 1000-line fixture the suite refers to, generated by its recipe."""
    out = []
    for i in range(1, 1001):
        if i % 75 == 0:
            msg, stream = f"ERROR: timeout on attempt {i}", "stderr"
        elif i % 50 == 0:
            msg, stream = "WARNING: memory high", "stderr"
        elif i % 10 == 0:
            msg, stream = f"DEBUG: step {i}", "stderr"
        else:
            msg, stream = f"request {i} ok", "stdout"
        out.append(f"[2025-01-15T14:{i // 60 % 60:02d}:{i % 60:02d}.000Z] [{stream}] {msg}")
    return out
