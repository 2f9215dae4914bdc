import random

import pytest

from shutterloom.operators import hierarchy
from shutterloom.operators.components import components


def brute(links):
    out = {}
    for start in links:
        seen, node = [], start
        while True:
            if node in seen:
                out[start] = (min(seen[seen.index(node) :]), -1)
                break
            seen.append(node)
            up = links[node]
            if up is None or up not in links:
                out[start] = (node, len(seen) - 1)
                break
            node = up
    return out


def rows(spark, links):
    return spark.createDataFrame([(k, v, "x", None) for k, v in links.items()], "id long, merged_into_id long, parent string, stop long")


def solved(spark, links, spacing=8):
    found = hierarchy.resolve(rows(spark, links), "id", "merged_into_id", spacing).collect()
    assert len(found) == len(links)
    return {r.id: (r.root_id, r.depth) for r in found}


CASES = {
    "chain": {i: i - 1 if i else None for i in range(150)},
    "self": {1: 1, 2: 1, 3: 2},
    "ring": {**{i: (i + 1) % 40 for i in range(40)}, 100: 7, 101: 100, 102: 101},
    "small ring": {5: 6, 6: 5, 7: 6, 8: 7},
    "dangling": {1: 99, 2: 1, 3: 2, 4: None},
    "star": {**{i: 0 for i in range(1, 60)}, 0: None},
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert solved(spark, CASES[name]) == brute(CASES[name])


@pytest.mark.parametrize("spacing", [3, 1000])
def test_random_forests_and_rings(spark, spacing):
    rng = random.Random(spacing)
    links = {i: rng.choice([None, rng.randrange(300), rng.randrange(300), 10_000]) for i in range(200)}
    assert solved(spark, links, spacing) == brute(links)


def test_paths_and_descendants(spark):
    links = CASES["chain"] | {500: 501, 501: 500}
    want = brute(links)
    for r in hierarchy.paths(rows(spark, links), "id", "merged_into_id").collect():
        if want[r.id][1] < 0:
            assert r.path is None
        else:
            assert r.path[0] == r.root_id and r.path[-1] == r.id and len(r.path) == r.depth + 1
            assert all(links[b] == a for a, b in zip(r.path, r.path[1:]))
    below = {(r.ancestor_id, r.descendant_id): r.distance for r in hierarchy.descendants(rows(spark, CASES["dangling"]), "id", "merged_into_id").collect()}
    assert below == {(1, 2): 1, (1, 3): 2, (2, 3): 1}


def test_nulls_repeats_and_empty(spark):
    kind = "id long, merged_into_id long"
    df = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (3, 2), (3, None)], kind)
    assert {(r.id, r.root_id, r.depth) for r in hierarchy.resolve(df, "id", "merged_into_id").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}
    empty = spark.createDataFrame([], kind)
    assert hierarchy.resolve(empty, "id", "merged_into_id").count() == 0
    assert hierarchy.paths(empty, "id", "merged_into_id").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
