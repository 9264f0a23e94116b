import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture
def db(spark):
    """A database of its own for the tables of one test."""
    name = "t_" + uuid.uuid4().hex[:12]
    spark.sql(f"CREATE DATABASE {name}")
    return name
