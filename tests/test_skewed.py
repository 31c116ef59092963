"""Queries on tables where one page, or one run, holds a third of the rows.

The limits are set so low that the plans for large groups are taken.
"""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import verify  # noqa: E402

from scriptoria.operators import components, lines, matching, metrics, scan  # noqa: E402

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "a01_page_score", "j05_candidate_pairs", "j07_greedy_match", "w01_annotation_ids", "w02_line_ids", "w03_reading_order",
    "w04_row_suppression", "w06_improvements", "w08_batch_plan", "j11_cyclic_pairs", "s10_selection_notes", "k01_coco_documents",
    "r02_instance_map", "r03_components", "a13_segment_affinity", "a23_average_precision",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    hot = {
        "lineitem": "case when row_number() over () % 3 = 0 then 1 else l_orderkey end as l_orderkey",
        "events": "case when event_id % 3 = 0 then 1 else user_id end as user_id",
    }
    for t in verify.TABLES.split():
        star = f"* replace ({hot[t]})" if t in hot else "*"
        con.execute(f"copy (select {star} from '{SOURCE}/{t}.parquet') to '{out}/{t}.parquet'")
    return str(out)


@pytest.fixture
def low_limits(monkeypatch):
    def lower(fn, old, new):
        monkeypatch.setattr(fn, "__defaults__", tuple(new if d == old else d for d in fn.__defaults__))

    for fn in (scan.prefix_scan, scan.row_numbers, lines.suppress_rows, metrics.improvements):
        lower(fn, scan.GROUP_LIMIT, 200)
    lower(matching.greedy_match, matching.FOLD_LIMIT, 100)
    lower(components.components, components.BAND_ROWS, 512)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_skewed_tables(spark, folder, low_limits, name):
    ok, note = verify.compare(spark, verify.connect(folder), folder, name)
    assert ok, note
