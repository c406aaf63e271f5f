from __future__ import annotations

import tempfile

import pytest

from depthspark import new_session


@pytest.fixture(scope="session")
def spark():
    session = new_session("local[8]", "tests", shuffle_partitions=4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.depthspark.width": "1024"})   # short blocks, so that small tables cross block borders too
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
