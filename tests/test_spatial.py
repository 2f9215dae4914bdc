import numpy as np
import pandas as pd

from shutterloom.operators import places, spatial


def test_near_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_ROWS", 40)
    rng = np.random.default_rng(1)
    lat = np.concatenate([rng.uniform(-0.1, 0.1, 150), 89.99 + rng.uniform(0, 0.01, 40), rng.uniform(10, 10.1, 60)])
    lon = np.concatenate([rng.uniform(-0.1, 0.1, 150), rng.uniform(-180, 180, 40), np.where(rng.random(60) < 0.5, -179.98, 179.98)])
    df = pd.DataFrame({"city_id": np.arange(len(lat)), "latitude": lat, "longitude": lon, "pos": "clash", "id": "clash", "cell": 1})
    df.loc[[3, 4, 5], ["latitude", "longitude"]] = [1.0, 1.0]  # one position
    df = pd.concat([df, df.iloc[:7]])  # repeated rows
    got = {(r.id_a, r.id_b) for r in spatial.near_pairs(spark.createDataFrame(df), "city_id", "latitude", "longitude", 3.0).collect()}
    u = df.drop_duplicates("city_id")
    la, lo, ids = u.latitude.to_numpy(), u.longitude.to_numpy(), u.city_id.to_numpy()
    want = {(int(ids[i]), int(ids[j])) for i in range(len(u)) for j in range(i + 1, len(u)) if spatial.haversine_km(la[i], lo[i], la[j], lo[j]) <= 3.0}
    assert got == want and len(want) > 100


def test_points_that_are_no_case(spark):
    rows = [(1, None, 1.0), (2, 1.0, None), (3, 91.0, 0.0), (4, 0.0, 181.0), (5, float("nan"), 0.0), (None, 0.0, 0.0), (6, 0.0, 0.0), (7, -999.0, 999.0)]
    df = spark.createDataFrame(rows, "c long, la double, lo double")
    assert spatial.near_pairs(df, "c", "la", "lo", 3.0).count() == 0
    assert spatial.near_pairs(df.limit(0), "c", "la", "lo", 3.0).count() == 0


def test_regions(spark, monkeypatch):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 10.0), (3, 0.0, 179.0), (4, 0.0, -179.0), (5, 5.0, 10.0), (6, 20.0, 20.0)], "i long, la double, lo double")
    boxes = [("A", [0.0, 0.0, 10.0, 10.0]), ("B", [10.0, 0.0, 20.0, 10.0]), ("C", [170.0, -5.0, -170.0, 5.0]), ("D", None), ("E", [0.0, None, 1.0, 1.0]), ("F", [20.0, 20.0, 20.0, 20.0]), ("G", [1.0, 1.0, 2.0]), (None, [0.0, 0.0, 90.0, 90.0]), ("A", [0.0, 0.0, 10.0, 10.0])]
    regions = spark.createDataFrame(boxes, "code string, bbox array<double>")
    want = {(1, "A"), (2, "A"), (2, "B"), (3, "C"), (4, "C"), (5, "A"), (5, "B"), (6, "F")}
    run = lambda: sorted((r.id, r.key) for r in spatial.in_regions(pts, "i", "la", "lo", regions, "code", "bbox").collect())
    assert run() == sorted(want)
    monkeypatch.setattr(spatial, "REGION_VERTICES", 16)  # more blocks than one, read from the shared folder
    assert run() == sorted(want)
    assert spatial.in_regions(pts, "i", "la", "lo", regions.limit(0), "code", "bbox").count() == 0


def test_nearest_place_over_the_date_line_and_pole(spark):
    pts = spark.createDataFrame([("a", 0.0, 179.9), ("b", 89.9, 0.0), ("c", 50.0, 50.0)], "id string, lat double, lon double")
    near = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.9, 180.0), (3, 0.0, 179.0)], "place_id long, lat double, lon double")
    got = {r.id: (r.place_id, round(r.km, 1)) for r in places.nearest_place(pts, near).collect()}
    assert got == {"a": (1, 22.2), "b": (2, 22.2)}


def test_polygons_with_holes_against_shapes(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(rng.uniform(-5, 15, (400, 2)))] + [(900, 0.0, 5.0), (901, 5.0, 5.0), (902, 4.0, 4.0), (903, 10.0, 0.0)]
    square, hole, tri = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]], [[-4.0, -4.0], [14.0, -4.0], [-4.0, 14.0]]
    rings = [("S", 0, 0, square), ("S", 0, 1, hole), ("T", 0, 0, tri), ("T", 1, 0, [[20.0, 20.0], [21.0, 20.0], [20.0, 21.0]]), (None, 0, 0, square), ("U", 0, 0, None), ("V", 0, 0, [[1.0, 1.0]])]
    df = spark.createDataFrame(pts, "i long, la double, lo double")
    got = {(r.id, r.key) for r in spatial.in_polygons(df, "i", "la", "lo", spark.createDataFrame(rings, "code string, part int, ring int, points array<array<double>>")).collect()}
    inside = {"S": lambda y, x: 0 <= x <= 10 and 0 <= y <= 10 and not (4 < x < 6 and 4 < y < 6), "T": lambda y, x: x >= -4 and y >= -4 and x + y <= 10}
    assert got == {(i, k) for i, y, x in pts for k, f in inside.items() if f(y, x)}


def test_nearest_other_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_ROWS", 30)
    rng = np.random.default_rng(5)
    q = np.vstack([rng.uniform(-0.3, 0.3, (120, 2)), rng.uniform(40, 44, (40, 2)), [[80.0, 10.0]]])
    p = np.vstack([rng.uniform(-0.3, 0.3, (80, 2)), rng.uniform(40, 44, (20, 2)), [[42.0, 41.0], [42.0, 41.0]]])
    a = spark.createDataFrame([(float(x), float(y)) for x, y in q] + [(float(q[0][0]), float(q[0][1]))], "lat double, lon double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "key long, lat double, lon double")
    got = {(r.lat, r.lon): (r.key, round(r.km, 6)) for r in spatial.nearest_other(a, b, 90.0).collect()}
    want = {}
    for x, y in q:
        d = spatial.haversine_km(x, y, p[:, 0], p[:, 1])
        if d.min() <= 90:
            want[float(x), float(y)] = (int(np.argmin(np.round(d, 9))), round(float(d.min()), 6))
    assert got == want and len(want) > 100
    assert spatial.nearest_other(a.limit(0), b, 90.0).count() == 0 and spatial.nearest_other(a, b.limit(0), 90.0).count() == 0


def test_pairs_come_in_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1.0 + i * 1e-5, 1.0) for i in range(60)], "c long, la double, lo double")
    whole = spatial.near_pairs(df, "c", "la", "lo", 3.0).count()
    monkeypatch.setattr(spatial, "PAIR_CHUNK", 10)
    assert spatial.near_pairs(df, "c", "la", "lo", 3.0).count() == whole == 60 * 59 // 2
