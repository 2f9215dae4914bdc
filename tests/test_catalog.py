import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shutterloom.functions import predicates as P
from shutterloom.operators import boxes, catalog, ranking, text, vectors
from shutterloom.plans import catalogue
from shutterloom.plans.search import search, suggest
from shutterloom.sources import listing
from shutterloom.streaming.sync import ObservationSync


def test_dayparts_and_null_times(spark):
    df = spark.createDataFrame([(h, datetime(2024, 1, 6, h)) for h in range(24)] + [(99, None)], "h int, ts timestamp_ntz")
    hours = lambda p: {r.h for r in df.where(P.daypart(F.col("ts"), p)).collect()}
    assert hours("night") == {21, 22, 23, 0, 1, 2, 3} and hours("dawn") == {4, 5, 6}
    assert df.where(P.weekday_in(F.col("ts"), (5,))).count() == 24


def test_bigrams(spark):
    df = spark.createDataFrame([("강아지 x 사",), ("강",), ("",), (None,)], "t string")
    assert [r.b for r in df.select(P.bigrams(F.col("t")).alias("b")).collect()] == [["강아", "아지", "지사"], [], [], []]


def test_fusion_scores_and_reasons(spark):
    ch = lambda *ids: spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id long, rank long")
    got = {r.id: r for r in ranking.fuse({"ocr": ch(1, 2), "clip": ch(2, 3), "shadow": ch(3, 2)}, ranking.weights("mixed")).collect()}
    assert got[2].hits == 3 and got[2].score == 1.0 and got[2].reason == "ocr+clip" and got[3].reason == "clip+shadow"
    assert all(0 < r.score <= 1 for r in got.values())
    assert ranking.weights("mixed", empty_clip=True)["clip"] == 0.0
    assert abs(sum(ranking.weights("ocr").values()) - 1) < 1e-12


def test_burst_takes_first_place_and_keeps_null_times(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at, 0.1, 1), (2, at, 0.9, 2), (3, None, 0.5, 3), (4, None, 0.5, 4)], "id long, ts timestamp_ntz, score double, pos int")
    assert {(r.id, r.pos) for r in ranking.burst(df, "ts", "score", "pos").collect()} == {(2, 1), (3, 3), (4, 4)}
    assert {r.id for r in ranking.day_cap(df, "ts", [F.col("pos")], 1).collect()} == {1, 3, 4}


def test_merge_then_unmerge_is_the_identity(spark):
    faces = spark.createDataFrame([(1, 3, None), (2, 3, 9), (3, 1, None), (4, None, None)], "file_id long, person_id long, merged_from long")
    merged = catalog.merge_people(faces, 3, 1)
    assert {(r.file_id, r.person_id, r.merged_from) for r in merged.collect()} == {(1, 1, 3), (2, 1, 9), (3, 1, None), (4, None, None)}
    back = catalog.unmerge_people(catalog.merge_people(faces.where("merged_from is null"), 3, 1), 3, 1)
    assert {tuple(r) for r in back.collect()} == {(1, 3, None), (3, 1, None), (4, None, None)}


def test_upsert_outcomes(spark):
    kind = "file_id string, path string"
    got = catalog.upsert(spark.createDataFrame([("a", "/1"), ("b", "/2"), ("c", "/3"), ("d", "/4")], kind), spark.createDataFrame([("a", "/1"), ("b", "/9"), ("e", "/3")], kind))
    assert {r.file_id: r.outcome for r in got.collect()} == {"a": "refreshed", "b": "moved", "c": "replaced", "d": "kept", "e": "created"}


def test_missing_needs_a_whole_walk(spark):
    files = spark.createDataFrame([("a", "/r/1", "thumb_done"), ("b", "/r/2", "thumb_done"), ("c", "/s/1", "thumb_done"), ("d", "/r/3", "missing"), ("e", "/r/4", "excluded")], "file_id string, path string, status string")
    seen = spark.createDataFrame([("/r/1",), ("/r/3",)], "path string")
    same = catalog.mark_missing(files, seen, ["/r"], walked=5)
    assert same.collect() == files.collect()
    got = {r.file_id: r.status for r in catalog.mark_missing(files, seen, ["/r"], walked=500).collect()}
    assert got == {"a": "thumb_done", "b": "missing", "c": "archived", "d": "metadata_done", "e": "excluded"}


def _by_flooding(edges):
    near, left, out = {}, set(), {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left = set(near)
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        out |= {n: min(seen) for n in seen}
        left -= seen
    return out


def test_alias_clusters_take_every_edge(spark, tmp_path):
    import random

    rng = random.Random(7)
    rows = [(rng.randrange(41, 200), rng.randrange(60, 400), 1.0) for _ in range(120)]  # all outside the sample
    rows += [(500, 1000 + i, 2.0) for i in range(300)] + [(600 + i, 5000 + i, 3.0) for i in range(40)] + [(601 + i, 5000 + i, 3.0) for i in range(40)]  # a hub and a chain
    rows += [(n, n, 7.0) for n in range(900, 910)]  # equal keys of a supplier and a part
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["alias_clusters"](spark, str(tmp_path)).collect()
    assert {r.node: r.component for r in got} == _by_flooding([(2 * s, 2 * p + 1) for s, p, _ in rows])
    assert len(got) == len({r.node for r in got})


def test_labels_are_followed_through_merges(spark, tmp_path):
    rows = [
        (1, "Anna", '["Annie", " ANN "]', 2), (2, "Berta", None, 4), (4, "Dora", "[]", None),  # a chain 1 -> 2 -> 4
        (3, "anna ", "not json", None), (5, "Emil", '["Dora"]', 9), (9, "Fritz", '["Annie"]', 99),  # a visible namesake, a link that ends
        (11, "Gerd", None, 12), (12, "Hans", None, 11), (13, None, '["Inge"]', 11), (14, "  ", '["", "Jo"]', None),  # a cycle
    ]
    spark.createDataFrame(rows, "id long, display_name string, aliases_json string, merged_into_id long").write.parquet(f"{tmp_path}/people.parquet")
    got = {r.name: r.person_id for r in catalogue.QUERIES["resolve_labels"](spark, str(tmp_path)).collect()}
    assert got == {
        "Anna": 3, "anna ": 3, "Annie": 4, " ANN ": 4, "Berta": 4, "Dora": 4, "Emil": 9, "Fritz": 9,
        "Gerd": 11, "Hans": 11, "Inge": 11, "Jo": 14, "nobody at all": -1,
    }


def test_greedy_boxes(spark):
    kind = "file_id long, id long, x double, y double, width double, height double"
    old = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 2.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], kind)
    new = spark.createDataFrame([(1, 7, 1.8, 0.0, 10.0, 10.0), (1, 8, 0.5, 0.0, 10.0, 10.0), (2, 9, 50.0, 50.0, 1.0, 1.0)], kind)
    assert {(r.old_id, r.new_id) for r in boxes.greedy_match(old, new).collect()} == {(2, 7), (1, 8)}


def test_centroids_and_absorption_do_not_move_twice(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None), (3, [3.0, 0.0])], "g long, v array<double>")
    got = {r.group: [round(x, 6) for x in r.centroid] for r in vectors.mean_vectors(df, "g", "v").collect()}
    assert got == {1: [0.707107, 0.707107], 3: [1.0, 0.0]}
    c = spark.createDataFrame([(1, True, [1.0, 0.0]), (2, False, [0.9, 0.1]), (3, False, [0.0, 1.0])], "id long, named boolean, centroid array<double>")
    assert [(r.from_id, r.into_id) for r in vectors.absorb(c).collect()] == [(2, 1)]
    online = vectors.cluster_online(spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.9, 0.1]), ("a", 3, [0.0, 1.0])], "s string, i long, v array<double>"), "s", "i", "v")
    assert {r.id: r.cluster for r in online.collect()} == {1: "person-000001", 2: "person-000001", 3: "person-000002"}


LIBRARY = [
    (1, "the old bridge at dusk", datetime(2023, 7, 1, 18), [("place", "river"), ("auto_scene", "sunset")], 0),
    (2, "receipt of the bakery", datetime(2023, 7, 2, 9), [("custom", "receipt")], 0),
    (3, None, datetime(2022, 7, 2, 9), [("person", "Anna"), ("place", "beach")], 1),
    (4, "bridge and dog", None, [("auto_object", "dog")], 0),
]


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame(LIBRARY, "id long, text string, taken timestamp_ntz, tags array<struct<tag_type: string, tag_value: string>>, people long")


def test_search_answers_filters_and_fallbacks(library):
    ask = lambda q, tags=None: [r.id for r in search(library, q, date(2024, 6, 1), tags).collect()]
    assert set(ask("bridge")) == {1, 4}
    assert ask("bridge without dog") == [1]
    assert ask("receipt") == [2]
    assert ask("Anna", {"person": {"Anna"}}) == [3]
    assert ask("receiptz") == [2]  # a tag near in spelling
    assert ask("  ") == []


def test_suggestions(spark):
    tags = spark.createDataFrame([("car",), ("cat",), ("cat",), ("vacation",), ("person-000001",)], "tag_value string")
    log = spark.createDataFrame([("Cat", 3, datetime(2024, 1, 1)), ("castle", 2, datetime(2024, 1, 2)), ("cab", 0, datetime(2024, 1, 3))], "query string, result_count long, at timestamp_ntz")
    assert [r.suggestion for r in suggest(tags, log, "ca").collect()] == ["cat", "car", "vacation", "castle"]


def test_bm25_counts_null_texts_as_rows(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "fox"), (3, None), (4, "")], "id long, t string")
    got = {r.id: r.score for r in text.bm25(docs, "id", "t", ["red"]).collect()}
    assert set(got) == {1} and got[1] < 0


def test_listing_gazetteer_and_lexicon(spark, tmp_path):
    (tmp_path / "r" / "sub").mkdir(parents=True)
    (tmp_path / "r" / "a.jpg").write_bytes(b"x" * 10)
    (tmp_path / "r" / "sub" / "b.PNG").write_bytes(b"y")
    (tmp_path / "r" / "c.txt").write_bytes(b"z")
    got = {r.relative: r.size for r in listing.scan(spark, [str(tmp_path / "r")], content=True).collect()}
    assert got == {"a.jpg": 10, "sub/b.PNG": 1}
    line = "\t".join(["5", "Town", "Town", "", "10.5", "20.5", "P", "PPL", "XX", "", "07"])
    (tmp_path / "g.tsv").write_text(line + "\n" + line.replace("10.5", "north") + "\nshort\trow\n")
    assert [(r.place_id, r.lat, r.admin1) for r in listing.gazetteer(spark, str(tmp_path / "g.tsv")).collect()] == [(5, 10.5, "07")]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"properties": {"code": "XX"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    assert [(r.code, len(r.points)) for r in listing.polygons(spark, str(tmp_path / "p.json")).collect()] == [("XX", 4)]
    assert listing.lexicon(str(tmp_path / "absent.json")) == {}


def test_stream_moves_observations_on(spark, tmp_path):
    kind = "path string, size long, mtime_ns long, seen_at timestamp_ntz"
    now = datetime(2024, 1, 1, 12)
    ns = int(datetime(2024, 1, 1, 11, 59).timestamp()) * 10**9
    src = str(tmp_path / "in")
    sync = lambda: ObservationSync(spark, src, kind, str(tmp_path / "state"), str(tmp_path / "cp"))
    spark.createDataFrame([("/a", 1, ns, now), ("/b", 1, ns - 10**12, now)], kind).write.parquet(src)
    sync().start().awaitTermination()
    assert {r.path: r.status for r in sync().state().collect()} == {"/a": "waiting_stable", "/b": "ready"}
    spark.createDataFrame([("/a", 1, ns, datetime(2024, 1, 1, 12, 10))], kind).write.mode("append").parquet(src)
    sync().start().awaitTermination()
    assert {r.path: r.status for r in sync().state().collect()} == {"/a": "ready", "/b": "ready"}


def test_search_log(spark, tmp_path):
    listing.log_search(spark, str(tmp_path / "log"), [("q" * 600, "hybrid", "visual", 3, datetime(2024, 1, 1))])
    assert len(spark.read.parquet(str(tmp_path / "log")).first()["query"]) == 512
