"""Points near other points, and the regions that hold them.

*Near points.* Positions become three-dimensional unit vectors, so distance on the sphere is chord length and neither
the poles nor the 180th meridian is a special case. A k-d split tree is fitted on a bounded sample of positions
(``SPLIT_SAMPLE``); every position goes to its own cell and, as a halo copy, to each cell within the chord radius.
Each cell then answers its own positions from a local k-d tree, and pairs are verified by the haversine formula.
Rows that share one position are grouped first, so a position held by a third of all rows is one point of the tree;
their pairs come from joins.

*Nearest of others.* The same index over both sets answers, for growing radii, the points that have found nothing yet.

*Regions.* A plane sweep over the edges of polygons with holes and of boxes: points are sorted along one axis, each edge
is active for the run of points between its ends, and counts as crossed by those above it; an odd number of crossings is
inside. Points on an edge are inside.

Defined results: rows with a null id, without both coordinates, with non-finite or out-of-range coordinates are no
case; exact repeats of a row count once; null, short or non-finite boxes hold nothing; min_lon > max_lon crosses the
180th meridian; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.session import cut_lineage, stored_blocks

EARTH_KM = 6371.0088
#: Rows of the sample on which the k-d splits are fitted, four a cell between these bounds; the index holds every row.
SPLIT_SAMPLE = (16_384, 262_144)
#: Positions aimed at in one cell, and the most cells (the split tree is sent to the tasks: 16 bytes a cell).
CELL_ROWS = 6000
MAX_CELLS = 1 << 16
#: Region vertices sent to the tasks at once; more lie in the shared folder in blocks of this size.
REGION_VERTICES = 200_000
#: Pairs that a task holds at once.
PAIR_CHUNK = 500_000


def valid_points(rows: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    lat, lon = F.col(lat_col).cast("double"), F.col(lon_col).cast("double")
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), lat.alias("lat"), lon.alias("lon"))
        .where(F.col("id").isNotNull() & F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))
        .where(~F.isnan("lat") & ~F.isnan("lon"))
        .distinct()
    )


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def haversine_km(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


class SplitTree:
    """A complete binary tree of axis-aligned median splits, in heap order; leaves are the cells."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.levels = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis = np.zeros((1 << self.levels) - 1, np.int8)
        self.at = np.zeros((1 << self.levels) - 1)
        parts = [sample]
        for level in range(self.levels):
            nxt = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(part):
                    axis = int(np.argmax(np.ptp(part, axis=0)))
                    self.axis[node], self.at[node] = axis, float(np.median(part[:, axis]))
                side = part[:, self.axis[node]] < self.at[node]
                nxt += [part[side], part[~side]]
            parts = nxt

    def cells_of(self, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, cell, is it the point's own cell) for every cell within ``radius`` of a point."""
        index, node, own = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.levels):
            away = points[index, self.axis[node]] - self.at[node]
            right = away >= 0
            near = np.abs(away) <= radius
            index = np.concatenate([index, index[near]])
            node = np.concatenate([2 * node + 1 + right, 2 * node[near] + 1 + ~right[near]])
            own = np.concatenate([own, np.zeros(int(near.sum()), bool)])
        return index, node - ((1 << self.levels) - 1), own


class LocalTree:
    """A k-d tree over one cell: median splits down to leaves of at most ``leaf`` points, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = 48) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left child, right child (-1 at a leaf)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        if len(points):
            self._build(0, len(points), leaf)

    def _build(self, start: int, stop: int, leaf: int) -> int:
        me = len(self.nodes)
        own = self.points[self.order[start:stop]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.nodes.append((start, stop, -1, -1))
        self.low.append(low)
        self.high.append(high)
        if stop - start > leaf and (high > low).any():
            axis, mid = int(np.argmax(high - low)), (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(own[:, axis], mid)]
            left = self._build(start, start + mid, leaf)
            self.nodes[me] = (start, stop, left, self._build(start + mid, stop, leaf))
        return me

    def leaves(self) -> Iterator[int]:
        return (i for i, n in enumerate(self.nodes) if n[2] < 0)

    def near_box(self, low: np.ndarray, high: np.ndarray, radius: float) -> list[int]:
        """Leaves whose box lies within ``radius`` of the given box."""
        out, todo = [], [0] if self.nodes else []
        while todo:
            i = todo.pop()
            gap = np.maximum(0, np.maximum(self.low[i] - high, low - self.high[i]))
            if float(gap @ gap) <= radius * radius:
                if self.nodes[i][2] < 0:
                    out.append(i)
                else:
                    todo += self.nodes[i][2:]
        return out

    def pairs(self, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of index pairs (a, b), a != b, within chord ``radius``; every ordered pair comes once."""
        for i in self.leaves():
            a = self.order[self.nodes[i][0] : self.nodes[i][1]]
            b = np.concatenate([self.order[self.nodes[j][0] : self.nodes[j][1]] for j in self.near_box(self.low[i], self.high[i], radius)])
            for s in range(0, len(b), 65536):
                part = b[s : s + 65536]
                d = self.points[a][:, None, :] - self.points[part][None, :, :]
                x, y = np.nonzero(np.einsum("abi,abi->ab", d, d) <= radius * radius)
                keep = a[x] != part[y]
                yield a[x][keep], part[y][keep]


    def best(self, others: np.ndarray, keys: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """For each point the number of the nearest of ``others`` within chord ``radius`` (-1: none) and its squared chord;
        ties within rounding go to the smaller key."""
        near, far = np.full(len(self.points), -1), np.full(len(self.points), np.inf)
        tree = LocalTree(others)
        for i in self.leaves():
            a = self.order[self.nodes[i][0] : self.nodes[i][1]]
            hit = tree.near_box(self.low[i], self.high[i], radius)
            b = np.concatenate([tree.order[tree.nodes[j][0] : tree.nodes[j][1]] for j in hit]) if hit else np.empty(0, int)
            b = b[np.argsort(keys[b], kind="stable")]
            for s in range(0, len(b), 65536):
                part = b[s : s + 65536]
                d = self.points[a][:, None, :] - others[part][None, :, :]
                d = np.einsum("abi,abi->ab", d, d)
                least = d.min(axis=1)
                first = np.argmax(d <= least[:, None] + 1e-18, axis=1)
                better = (least < far[a] - 1e-18) & (least <= radius * radius)
                near[a[better]], far[a[better]] = part[first[better]], least[better]
        return near, far


def chord_of(km: float) -> float:
    return 2 * math.sin(min(km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12


def fit_splits(spots: DataFrame, n: int) -> SplitTree:
    """The k-d splits of ``n`` positions (lat, lon), from a bounded sample of them."""
    cells = min(MAX_CELLS, max(1, math.ceil(n / CELL_ROWS)))
    size = max(SPLIT_SAMPLE[0], min(SPLIT_SAMPLE[1], 4 * cells))
    taken = spots.select("lat", "lon").orderBy(F.xxhash64("lat", "lon")).limit(size).toPandas()
    return SplitTree(unit_vectors(taken["lat"].to_numpy(), taken["lon"].to_numpy()), cells)


def _by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of one cell after another, out of batches in which cells stand together."""
    held: list[pd.DataFrame] = []
    for b in batches:
        cuts = [0, *(np.nonzero(np.diff(b["cell"].to_numpy()))[0] + 1).tolist(), len(b)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            part = b.iloc[lo:hi]
            if held and held[0]["cell"].iloc[0] != part["cell"].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def near_spots(rows: DataFrame, id_col: str, lat_col: str, lon_col: str, km: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each row's position (id, lat, lon), and the pairs of different positions at most ``km`` apart, once
    each (pos_a, lat_a, lon_a, pos_b, lat_b, lon_b), where pos is the smallest id at a position. Rows of one position are
    near each other and need no pairs: with members this is the whole result, without all pairs of crowded positions."""
    points = cut_lineage(valid_points(rows, id_col, lat_col, lon_col))
    spots = cut_lineage(points.groupBy("lat", "lon").agg(F.min("id").alias("pos")))  # combined before the shuffle
    tree, chord = fit_splits(spots, spots.count()), chord_of(km)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, cell, own = tree.cells_of(unit_vectors(b["lat"].to_numpy(), b["lon"].to_numpy()), chord)
            yield pd.DataFrame({"cell": cell, "own": own, "pos": b["pos"].to_numpy()[i], "lat": b["lat"].to_numpy()[i], "lon": b["lon"].to_numpy()[i]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _by_cell(batches):
            lat, lon, pos, own = (cell[c].to_numpy() for c in ("lat", "lon", "pos", "own"))
            out, many = [], 0
            for a, b in LocalTree(unit_vectors(lat, lon)).pairs(chord):
                keep = own[a] & (pos[a] <= pos[b])  # equal only where one id stands at two positions
                a, b = a[keep], b[keep]
                keep = haversine_km(lat[a], lon[a], lat[b], lon[b]) <= km
                out.append((a[keep], b[keep]))
                many += len(out[-1][0])
                if many >= PAIR_CHUNK:
                    yield pairs(lat, lon, pos, out)
                    out, many = [], 0
            if out:
                yield pairs(lat, lon, pos, out)

    def pairs(lat, lon, pos, out) -> pd.DataFrame:
        a, b = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"pos_a": pos[a], "lat_a": lat[a], "lon_a": lon[a], "pos_b": pos[b], "lat_b": lat[b], "lon_b": lon[b]})

    spotted = spots.mapInPandas(place, "cell long, own boolean, pos long, lat double, lon double").repartition("cell").sortWithinPartitions("cell")
    return points, spotted.mapInPandas(search, "pos_a long, lat_a double, lon_a double, pos_b long, lat_b double, lon_b double")


def near_pairs(rows: DataFrame, id_col: str, lat_col: str, lon_col: str, km: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of two different ids at most ``km`` apart by great circle."""
    points, met = near_spots(rows, id_col, lat_col, lon_col, km)
    a = points.select(F.col("id").alias("x"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = points.select(F.col("id").alias("y"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    apart = met.join(a, ["lat_a", "lon_a"]).join(b, ["lat_b", "lon_b"])
    same = a.join(b, (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b")) & (F.col("x") < F.col("y")))
    both = apart.select("x", "y").unionByName(same.select("x", "y"))
    return both.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def nearest_other(points: DataFrame, others: DataFrame, km: float, first_km: float = 3.0) -> DataFrame:
    """(lat, lon, key, km): for each position the nearest of ``others`` (key, lat, lon) within ``km``; ties go to the smaller
    key. Radii grow sixfold, and each round has only the positions that have found nothing yet, in cells of their own."""
    left = cut_lineage(points.select("lat", "lon").distinct())
    held = cut_lineage(others.groupBy("lat", "lon").agg(F.min("key").alias("key")))
    out, radius = None, min(first_km, km)
    key_type = others.schema["key"].dataType.simpleString()
    while True:
        n = left.count()
        if not n and out is not None:
            return out
        tree, chord = fit_splits(left, n), chord_of(radius)

        def place(batches: Iterator[pd.DataFrame], tree=tree, chord=chord) -> Iterator[pd.DataFrame]:
            for b in batches:
                i, cell, own = tree.cells_of(unit_vectors(b["lat"].to_numpy(), b["lon"].to_numpy()), chord)
                keep = own | b["key"].notna().to_numpy()[i]  # positions ask in their own cell, others are there in a halo
                i, cell = i[keep], cell[keep]
                yield pd.DataFrame({"cell": cell, "lat": b["lat"].to_numpy()[i], "lon": b["lon"].to_numpy()[i], "key": b["key"].iloc[i].reset_index(drop=True), "asks": b["asks"].to_numpy()[i]})

        def search(batches: Iterator[pd.DataFrame], chord=chord, radius=radius) -> Iterator[pd.DataFrame]:
            for cell in _by_cell(batches):
                q, p = cell[cell["asks"]].reset_index(drop=True), cell[~cell["asks"]].reset_index(drop=True)
                if len(q) and len(p):
                    near, _ = LocalTree(unit_vectors(q["lat"].to_numpy(), q["lon"].to_numpy())).best(unit_vectors(p["lat"].to_numpy(), p["lon"].to_numpy()), p["key"].to_numpy(), chord)
                    q, p = q[near >= 0], p.iloc[near[near >= 0]]
                    away = haversine_km(q["lat"].to_numpy(), q["lon"].to_numpy(), p["lat"].to_numpy(), p["lon"].to_numpy())
                    keep = away <= radius
                    yield pd.DataFrame({"lat": q["lat"].to_numpy()[keep], "lon": q["lon"].to_numpy()[keep], "key": p["key"].to_numpy()[keep], "km": away[keep]})

        both = left.select("lat", "lon", F.lit(None).cast(key_type).alias("key"), F.lit(True).alias("asks")).unionByName(held.select("lat", "lon", "key", F.lit(False).alias("asks")))
        kind = f"cell long, lat double, lon double, key {key_type}, asks boolean"
        cells = both.mapInPandas(place, kind).repartition("cell").sortWithinPartitions("cell")
        found = cut_lineage(cells.mapInPandas(search, f"lat double, lon double, key {key_type}, km double"))
        out = found if out is None else out.unionByName(found)
        if radius >= km:
            return out
        left = cut_lineage(left.join(found, ["lat", "lon"], "left_anti"), replaces=left)
        radius = min(km, radius * 6)


class Sweep:
    """A plane sweep over the edges of regions; a region is a list of rings, of which odd numbers around a point hold it."""

    def __init__(self, regions: list[tuple[object, list[np.ndarray]]]) -> None:
        self.keys, self.edges = [], []
        for key, rings in regions:
            ends = [np.concatenate([r, r[:1]]) for r in rings if len(r) >= 2]
            if ends:
                e = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in ends])
                turned = e[:, 0] > e[:, 2]
                e[turned] = e[turned][:, [2, 3, 0, 1]]  # from left to right
                self.keys.append(key)
                self.edges.append(e)

    def hits(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, index of the region) of closed regions."""
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], y[order]
        point, region = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, e in enumerate(self.edges):
            lo, hi = np.searchsorted(xs, e[:, 0].min(), "left"), np.searchsorted(xs, e[:, 2].max(), "right")
            if lo == hi:
                continue
            crossed, on = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
            first, last, end = np.searchsorted(xs, e[:, 0], "left") - lo, np.searchsorted(xs, e[:, 2], "left") - lo, np.searchsorted(xs, e[:, 2], "right") - lo
            for (x1, y1, x2, y2), a, b, c in zip(e, first, last, end):
                if a == c:
                    continue
                h = ys[lo + a : lo + c]
                if x1 == x2:  # upright edges part nothing, but hold the points on them
                    on[a:c] |= (h >= min(y1, y2)) & (h <= max(y1, y2))
                    continue
                level = y1 + (y2 - y1) * ((xs[lo + a : lo + c] - x1) / (x2 - x1)) if y1 != y2 else np.full(c - a, y1)
                on[a:c] |= h == level
                crossed[a:b] += level[: b - a] < h[: b - a]
            p = np.nonzero(on | (crossed % 2 == 1))[0]
            point.append(order[lo + p])
            region.append(np.full(len(p), k))
        return np.concatenate(point), np.concatenate(region)


def _box_rings(box) -> list[np.ndarray] | None:
    v = [float("nan") if e is None else float(e) for e in box]
    if len(v) != 4 or not all(map(math.isfinite, v)) or v[1] > v[3]:
        return None
    spans = [(v[0], v[2])] if v[0] <= v[2] else [(v[0], 180.0), (-180.0, v[2])]
    return [np.array([(w, v[1]), (e, v[1]), (e, v[3]), (w, v[3])]) for w, e in spans if w <= e]


def _polygon_rings(rings) -> list[np.ndarray] | None:
    out = []
    for ring in rings:
        p = np.array([[float(c) for c in q[:2]] for q in ring if q is not None and len(q) >= 2 and q[0] is not None and q[1] is not None], float).reshape(-1, 2)
        if len(p) >= 3 and np.isfinite(p).all():
            out.append(p[:-1] if (p[0] == p[-1]).all() else p)
    return out or None


def _held(points: DataFrame, areas: DataFrame, rings_of: Callable) -> DataFrame:
    """(id, key) of points in the regions ``areas`` (key, shape, vertices); points are read once."""
    vertices = areas.agg(F.sum("vertices")).first()[0] or 0
    blocks = max(1, math.ceil(vertices / REGION_VERTICES))

    def sweep_of(part: pd.DataFrame) -> Sweep:
        return Sweep([(k, r) for k, r in ((k, rings_of(s)) for k, s in zip(part["key"], part["shape"])) if r])

    if blocks == 1:
        sweeps = [sweep_of(areas.select("key", "shape").toPandas())]  # of bounded size
        read = lambda: sweeps
    else:
        _, frames = stored_blocks(areas.select("key", "shape"), blocks)
        read = lambda: map(sweep_of, frames())

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sweep in read():
                p, q = sweep.hits(b["lon"].to_numpy(), b["lat"].to_numpy())
                yield pd.DataFrame({"id": b["id"].to_numpy()[p], "key": np.array(sweep.keys, object)[q] if len(q) else np.empty(0, object)})

    return points.mapInPandas(visit, "id long, key string").distinct()


def in_regions(rows: DataFrame, id_col: str, lat_col: str, lon_col: str, regions: DataFrame, key_col: str, box_col: str) -> DataFrame:
    """(id, key): each point with the key of every box [min_lon, min_lat, max_lon, max_lat] that holds it, edges included."""
    areas = regions.select(F.col(key_col).cast("string").alias("key"), F.col(box_col).alias("shape"), F.lit(8).alias("vertices")).where("key is not null and shape is not null").distinct()
    return _held(valid_points(rows, id_col, lat_col, lon_col), areas, _box_rings)


def in_polygons(rows: DataFrame, id_col: str, lat_col: str, lon_col: str, polygons: DataFrame) -> DataFrame:
    """(id, key): each point with the code of every region that holds it, edges included; polygons: (code, part, ring, points)
    with points as [lon, lat], rings after the first of a part are holes. Parts of a region do not overlap."""
    parts = polygons.where("code is not null and points is not null").groupBy(F.col("code").alias("key"), "part").agg(F.collect_list("points").alias("shape"), F.sum(F.size("points")).alias("vertices"))
    return _held(valid_points(rows, id_col, lat_col, lon_col), parts, _polygon_rings)
