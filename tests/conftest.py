"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from specimatrix.session import build  # noqa: E402


def pytest_configure(config):
    """Numeric warnings of the library are errors."""
    config.addinivalue_line("filterwarnings", "error::RuntimeWarning:specimatrix")


@pytest.fixture(scope="session")
def spark():
    return build("tests", cores=4, shuffle=4, **{"spark.driver.memory": "4g", "spark.sql.ansi.enabled": "true"})


@pytest.fixture(scope="session")
def rows():
    """A result as a sorted list of tuples."""
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
