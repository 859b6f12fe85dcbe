from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g", spark__python__sql__dataFrameDebugging__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as dicts, in the given order."""
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
