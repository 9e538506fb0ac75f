"""Distance join: equal to comparing all pairs, also at the date line and the poles; the plan joins by cell."""

import numpy as np
import pytest

from streetlens.constants import EARTH_RADIUS_M
from streetlens.operators import spatial
from streetlens.operators.spatial import near_pairs


def metres(a, b):
    lon1, lat1, lon2, lat2 = (np.radians(x) for x in (a[0], a[1], b[0], b[1]))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(min(1.0, h)))


def globe(seed, n):
    """Places everywhere, many of them at the poles, the date line and in one spot."""
    rng = np.random.default_rng(seed)
    lon, lat = rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lat[: n // 6] = rng.choice([90.0, -90.0, 89.9, -89.95, 89.0], n // 6)
    lon[n // 6: n // 3] = rng.choice([180.0, -180.0, 179.99, -179.98, 0.0, 539.9], n // 3 - n // 6)
    lon[n // 3: n // 2], lat[n // 3: n // 2] = -118 + rng.uniform(0, 0.2, n // 2 - n // 3), 34 + rng.uniform(0, 0.2, n // 2 - n // 3)
    return [(float(a), float(b)) for a, b in zip(lon, lat)]


BAD = [(None, 1.0), (1.0, None), (float("nan"), 0.0), (0.0, float("nan")), (0.0, 91.0), (float("inf"), 0.0)]


@pytest.fixture(scope="module")
def tables(spark):
    here, there = globe(1, 120), globe(2, 150)
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(here + BAD)], "point_id int, longitude double, latitude double")
    places = spark.createDataFrame([(f"b{i:03d}", *p, "x") for i, p in enumerate(there + BAD)], "source_id string, longitude double, latitude double, point string")
    return here, there, points.union(points.limit(5)).repartition(3), places.repartition(3)


@pytest.mark.parametrize("distance", [0.0, 3000.0, 60_000.0, 1_500_000.0, 9_000_000.0, 25_000_000.0])
def test_equals_all_pairs(tables, distance):
    here, there, points, places = tables
    want = {(i, f"b{j:03d}") for i, p in enumerate(here) for j, b in enumerate(there) if metres(p, b) <= distance}
    rows = near_pairs(points, places, distance).collect()
    assert len(rows) == len(want) and {(r.point.point_id, r.place.source_id) for r in rows} == want
    assert all(abs(r.distance_m - metres(here[r.point.point_id], there[int(r.place.source_id[1:])])) < 1e-3 for r in rows)


@pytest.mark.parametrize("k, rings", [(1, 1), (3, 3), (40, 4)])
def test_nearest(tables, k, rings):
    here, there, points, places = tables
    rows = near_pairs(points, places, 2_000_000, k, rings=rings).collect()
    got = {i: [] for i in range(len(here))}
    for r in rows:
        got[r.point.point_id].append((round(r.distance_m, 6), r.place.source_id))
    for i, p in enumerate(here):
        near = sorted(d for b in there if (d := metres(p, b)) <= 2_000_000)[:k]
        found = sorted(got[i])
        assert len({name for _, name in found}) == len(found) == len(near)
        assert np.allclose([d for d, _ in found], near, atol=1e-3)
        # of places at one distance the smaller ids
        for d, name in found:
            closer = [f"b{j:03d}" for j, b in enumerate(there) if abs(metres(p, b) - d) < 1e-9 and f"b{j:03d}" < name]
            assert all(c in {n for _, n in found} for c in closer) or d < 1e-6 or abs(abs(p[1]) - 90) < 1e-9


def test_a_full_cell_is_shared_out(spark, tables, monkeypatch):
    here, there, points, places = tables
    whole = {(r.point.point_id, r.place.source_id) for r in near_pairs(points, places, 60_000).collect()}
    monkeypatch.setattr(spatial, "CELL_ROWS", 3)
    assert {(r.point.point_id, r.place.source_id) for r in near_pairs(points, places, 60_000).collect()} == whole


def test_the_plan_has_no_nested_loop(tables):
    _, _, points, places = tables
    plan = near_pairs(points, places, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(tables):
    _, _, points, places = tables
    assert near_pairs(points.limit(0), places, 5000, 2).collect() == [] and near_pairs(points, places.limit(0), 5000).collect() == []


def test_the_nearest_are_ranked_where_they_are_compared(spark, tables, monkeypatch):
    _, _, points, places = tables
    compared, rank = [], spatial.top_n_per_group
    monkeypatch.setattr(spatial, "top_n_per_group", lambda df, keys, *args, **kw: compared.append((list(keys), rank(df, keys, *args, **kw))) or compared[-1][1])
    monkeypatch.setattr(spatial, "MOST_RINGS", 2)
    near_pairs(points, places, 60_000, 2, rings=1)
    keys, ranked = compared[0]
    assert "point" in keys and "cell_row" in keys
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan
    prepared = ranked._jdf.queryExecution().executedPlan().toString()
    above = prepared[:prepared.index("SortMergeJoin")]
    assert "Window" in above and "Exchange" not in above


def test_dense_places_begin_on_a_finer_grid(spark):
    dense = spark.range(4000).selectExpr("struct(id AS source_id, id % 200 / 10.0D AS longitude, id DIV 200 / 10.0D AS latitude) AS place")
    assert spatial._rings(dense, 300_000, 5, 3) > 3
    assert spatial._rings(dense.limit(2), 300_000, 5, 3) == 3


def test_lonely_places_need_no_finer_grid_for_one(spark):
    lonely = spark.range(9).selectExpr("struct(id AS source_id, id * 20.0D AS longitude, 0.0D AS latitude) AS place")
    assert spatial._rings(lonely, 300_000, 1, 1) == 1
