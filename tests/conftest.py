import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from pagesheaf.session import local_session  # noqa: E402

# Test modules build column expressions when they are imported, so the session comes first.
SESSION = local_session("pagesheaf-tests", 8)


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column over one row of named strings."""

    def run(column, **row):
        names = list(row) or ["x"]
        values = [row.get(n, "") for n in names]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(column.alias("v")).collect()[0].v

    return run


@pytest.fixture(scope="session")
def page(spark):
    def make(html, url="https://ws.notion.site/P-0123456789abcdef0123456789abcdef"):
        return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")

    return make
