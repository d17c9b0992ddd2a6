from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from flowwatch.session import local_session  # noqa: E402
from flowwatch.sources import fixtures as fx  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "flowwatch-tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    return fx.read_events(spark, SMALL)


@pytest.fixture(scope="session")
def packets(events):
    return fx.packets(events)


def packet_rows(spark, rows):
    """Packets from (seq, ts in seconds, src, dest, protocol, size, sport, dport)."""
    from flowwatch.schemas import PACKET

    data = [(q, "cap0", int(t * 1_000_000), s, d, p, z, sp, dp) for q, t, s, d, p, z, sp, dp in rows]
    return spark.createDataFrame(data, PACKET)
