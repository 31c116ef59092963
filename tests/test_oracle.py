"""Every registered query with SQL gives the rows of its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import verify  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = verify.compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "N_gt", "N_pred", "M", "DR", "RA", "FM"]
    assert not df.isEmpty()
