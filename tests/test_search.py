from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from shutterloom.operators import catalog, text, vectors
from shutterloom.plans import planner
from shutterloom.plans import search as S

TODAY = date(2024, 6, 12)
KIND = "id long, text string, taken timestamp_ntz, tags array<struct<tag_type: string, tag_value: string>>, people long, embedding array<double>"


def library(spark):
    at = lambda d: datetime(2024, 1, d, 12)
    rows = [
        (1, "the old bridge at dawn", at(1), [("place", "Riverside")], 0, [1.0, 0.0]),
        (2, "bridge, old and low", at(2), [("custom", "bridge")], 0, [0.9, 0.1]),
        (3, "receipt from the market", at(3), [("auto_screen", "document")], 0, [0.0, 1.0]),
        (4, None, at(4), [("person", "Anna")], 1, None),
        (5, "강아지 사진", at(5), [], 2, [0.5, 0.5]),
        (6, "nothing", None, None, None, []),
        (7, "Anna and Ben at the market", at(7), [("person", "Anna"), ("person", "Ben")], 2, [0.1, 0.9]),
    ]
    return spark.createDataFrame(rows, KIND)


def ids(df):
    return [r.id for r in df.orderBy("pos", "id").collect()]


def test_tags_come_before_words_and_words_before_letters(spark):
    lib = library(spark)
    assert ids(S.search(lib, "old bridge", TODAY, {}))[:2] == [1, 2]  # the phrase in the text, then the tag
    assert ids(S.search(lib, "bridge", TODAY, {}))[0] == 2  # the tag itself
    assert ids(S.search(lib, "강아지사진", TODAY, {})) == [5]  # pairs of characters
    assert ids(S.search(lib, "", TODAY)) == [] == ids(S.search(lib, " ?! ", TODAY)) and ids(S.search(lib.limit(0), "bridge", TODAY)) == []


def test_synonyms_vectors_and_corrections(spark):
    lib = library(spark)
    assert ids(S.search(lib.withColumn("tags", F.when(F.col("id") == 3, F.array(F.struct(F.lit("custom").alias("tag_type"), F.lit("Invoice").alias("tag_value")))).otherwise(F.col("tags"))), "receipt", TODAY, {}))[0] == 3
    found = S.search(lib, "quiet corner", TODAY, {}, encode=lambda q: [1.0, 0.0])
    assert ids(found)[:2] == [1, 2] and {r.reason for r in found.collect()} == {"clip"}
    assert [(r.id, r.used) for r in S.search(lib, "bridgez", TODAY, {}).collect()][0] == (2, "bridge")


def test_people_lead_to_the_files_that_show_them(spark):
    lib = library(spark)
    people = spark.createDataFrame([(10, "Annabel", None), (11, "Anna", 10), (12, "Ben", None)], "id long, label string, merged_into_id long")
    faces = spark.createDataFrame([(5, 10), (7, 12)], "id long, person_id long")
    assert ids(S.search(lib, "Anna photos", TODAY, {"person": {"Anna"}}, people=people, faces=faces)) == [5]
    assert ids(S.search(lib, "Anna photos", TODAY, {"person": {"Anna"}})) == [4, 7, 5]  # by tags alone, fewer people first, then others with faces
    assert [r.id for r in S.resolve_people(people, ["ann", "x"]).collect()] == [10]


def test_hidden_promoted_parts_and_order(spark):
    lib = library(spark)
    hidden = spark.createDataFrame([(1,)], "id long")
    assert 1 not in ids(S.search(lib, "old bridge", TODAY, {}, hidden=hidden))
    rows = {r.id: r for r in S.search(lib, "old bridge", TODAY, {}, promoted=hidden).collect()}
    assert {p.stage for p in rows[1].parts} >= {"channels", "text", "promoted"}
    assert [r.id for r in S.search(lib, "oldest at the market", TODAY, {}).collect()] == [1, 3, 7]


def test_one_pass_over_the_library(spark, tmp_path):
    library(spark).write.parquet(str(tmp_path / "library"))
    lib = spark.read.parquet(str(tmp_path / "library"))
    seen = S.judged(lib, planner.make("old bridge", TODAY), None)
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_the_stored_index_scores_like_the_texts(spark, tmp_path):
    lib = library(spark)
    index = text.TextIndex(spark, str(tmp_path / "index"))
    index.rebuild(lib, "id", "text")
    show = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
    assert show(index.bm25(["bridge", "market", "absent"])) == show(text.bm25(lib, "id", "text", ["bridge", "market", "absent"])) != []
    plan = index.postings(["bridge"])._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ids(S.search(lib, "old bridge", TODAY, {}, index=index)) == ids(S.search(lib, "old bridge", TODAY, {}))


def test_vocabulary_is_bounded_by_the_query(spark):
    got = S.vocabulary(library(spark), "anna at the river")
    assert got == {"person": {"Anna"}, "place": {"Riverside"}}


def test_result_cache(spark):
    now = [0.0]
    cache, calls = S.ResultCache(60, 2, lambda: now[0]), []
    make = lambda k: lambda: calls.append(k) or spark.range(k)
    assert len(cache.get(("a",), make(1))) == 1 and len(cache.get(("a",), make(5))) == 1 and calls == [1]
    now[0] = 61.0
    assert len(cache.get(("a",), make(2))) == 2
    cache.get(("b",), make(3)), cache.get(("c",), make(4))
    assert len(cache.get(("a",), make(6))) == 6  # the oldest went


def test_missing_guards():
    good = catalog.may_mark_missing
    assert good(2, 1, 0, 100) and good(0, 0, 0, 100)
    assert not good(2, 0, 0, 100) and not good(2, 2, 1, 100) and not good(2, 2, 0, 99)


def test_classes_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)] + [(90, None), (91, [1.0])], "id long, v array<double>")
    classes = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(20)] + [(50, None), (51, [])], "group long, centroid array<double>")
    show = lambda: sorted((r.id, r.key, round(r.similarity, 9)) for r in vectors.closest_centroid(rows, "id", "v", classes).collect())
    whole = show()
    monkeypatch.setattr(vectors, "CLASS_BLOCK", 3)
    assert show() == whole and len(whole) == 50
