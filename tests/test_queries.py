"""Registered lattice queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from gridloom.functions.kernels import offsets
from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that are quick here; all others are held against their SQL at a larger scale by the driver.
FAST = ["csv_dedupe_first_per_key", "points_to_cells_weighted_mean", "circular_mean", "ledger_first_wins", "robust_unit", "rank_unit", "gaussian_smooth", "gradient_magnitude", "buffer_exclusion", "fold_dti", "dot_hits", "spacing_knn2", "roc_auc", "rank_lift", "sprt_sign", "jaccard_uniqueness", "format_audit"]
FAST += ["nearest_fill", "corridor_paint", "exact_duplicate", "raster_digest", "harmonic_rank_fusion", "cross_gradient", "implied_hit_rate", "nested_pair_solve", "left_rank_lift", "locked_cells", "negative_pools", "fused_strike", "heat_flow_csv", "wells_csv", "ratio_bands", "conductivity", "raster_box", "mask_digest", "fold_progress", "run_stamps"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_entry_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "poisson_emit" in entry.queries()


def test_nearest_fill_returns_every_cell(spark, con):
    """Brute force over the whole lattice."""
    sources = np.array(sorted(con.sql(registry.SQL["distance_to_mask"].rsplit("SELECT", 1)[0] + "SELECT r, c, px FROM lat WHERE dot AND px IS NOT NULL").fetchall()))
    got = {(x.r, x.c): x.px for x in registry.QUERIES["nearest_fill"](spark, SF).collect()}
    assert set(got) == {(r, c) for r in range(358) for c in range(50)}
    for (r, c), px in got.items():
        # sources are in order of row and column, and argmin takes the first of the nearest
        assert abs(px - sources[((sources[:, 0] - r) ** 2 + (sources[:, 1] - c) ** 2).argmin(), 2]) < 1e-6


def test_greedy_maxcover_takes_cells_of_the_whole_footprint(spark):
    rows = sorted(registry.QUERIES["greedy_maxcover"](spark, SF).collect(), key=lambda x: x.step)
    assert [x.step for x in rows] == list(range(1, 51)) and max(x.r for x in rows) >= 40
    assert all(a.gain >= b.gain for a, b in zip(rows, rows[1:], strict=False))


def painted(ends, steps):
    line, out = {}, {}
    for r, c in ends:
        a = math.radians(30 * (r % 6))
        for k in range(-steps, steps + 1):
            p = round(r - k * math.cos(a)), round(c + k * math.sin(a))
            line[p] = max(line.get(p, 0), 1 - abs(k) / (steps + 1))
    for (r, c), w in line.items():
        for i, j, d in offsets(3):
            out[r + i, c + j] = max(out.get((r + i, c + j), 0), w * (1 - d / 4))
    return out


def test_corridor_paint_starts_at_every_truth_cell(spark, con):
    """Brute force for all ends."""
    lat = registry.SQL["distance_to_mask"].rsplit("SELECT", 1)[0]
    ends = con.sql(lat + "SELECT r, c FROM lat WHERE truth").fetchall()
    want = painted(ends, 60)
    got = {(x.r, x.c): x.value for x in registry.QUERIES["corridor_paint"](spark, SF).collect()}
    assert set(got) == set(want) and all(abs(v - want[p]) < 1e-6 for p, v in got.items())


def test_blocked_oof_gbt_gives_a_probability_per_cell(spark):
    rows = registry.QUERIES["blocked_oof_gbt"](spark, SF).collect()
    assert sorted((x.r, x.c) for x in rows) == [(r, c) for r in range(2, 356) for c in range(2, 48)]
    assert all(0 <= x.prob <= 1 for x in rows) and {x.fold for x in rows} == {0, 1}
    assert all(len({x.prob for x in rows if x.fold == k}) > 2 for k in (0, 1))
