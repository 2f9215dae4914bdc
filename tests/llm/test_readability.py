from pathlib import Path

import pytest

from shutterloom.llm import readability as R

DATA = Path("/root/testdata/sf0.1")
EASY = "The cat sat. It was red. We ran to the sun. A dog came. "
HARD = "Notwithstanding considerable methodological uncertainty, interdisciplinary investigators nevertheless characterised institutional accountability as fundamentally contingent upon organisational transparency. "
DOC = "doc_id long, text string, lang string, language int, words int"


def test_syllables():
    assert [R.syllables(w, "en") for w in ("cat", "table", "make", "banana", "readable", "hmm")] == [1, 2, 1, 3, 3, 1]
    assert R.syllables("강아지", "ko") == 3 and R.syllables("Brücke", "de") == 2 and R.syllables("belle", "fr") == 1


@pytest.mark.parametrize(
    "language, words",
    [
        ("en", "museum-3 idea-3 create-2 science-2 radio-3 table-2 whole-1 wanted-2 walked-1 boxes-2 tea-1 nation-2 special-2 client-2 friend-1 language-2 actual-3 poem-2 patient-2 chaos-2 quiet-2 society-4 million-2 houses-2 cities-2"),
        ("de", "museum-3 theater-3 radio-3 nation-3 bauer-2 neue-2 haus-1 liebe-2 idee-2 schauen-2 quelle-2"),
        ("fr", "poète-2 musée-2 maison-2 créer-2 théâtre-2 photos-2 crier-2 poésie-3 parlent-1 vie-1 nuit-1"),
    ],
)
def test_hyphenation_patterns(language, words):
    for word, n in (w.rsplit("-", 1) for w in words.split()):
        assert R.syllables(word, language) == int(n), word


def test_order_and_edge_cases(spark):
    rows = [(1, EASY, "en"), (2, HARD, "EN-us"), (3, None, "en"), (4, "", None), (5, "123 456", "xx"), (6, EASY * 3000, "en"), (7, "word", None), (1, EASY, "en"), (None, EASY, "en"), (8, "<p>" + HARD + "</p>&nbsp;", None), (9, "강아지가 좋아요. 우리는 산에 갔어요.", "en")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], DOC)
    got = R.reading_levels(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[1].grade < 5 < by[2].grade and abs(by[6].grade - by[1].grade) < 1
    assert [by[i].grade for i in (3, 4, 5)] == [None] * 3 and by[9].language == "ko" and abs(by[8].grade - by[2].grade) < 1
    assert R.reading_levels(df.limit(0)).count() == 0


def test_labels_are_cleaned(spark):
    rows = [(1, 3), (1, 5), (1, 99), (2, None), (3, 0), (4, 18), (None, 4)]
    got = {r.doc_id: r.grade for r in R.clean_labels(spark.createDataFrame(rows, "doc_id long, grade int")).collect()}
    assert got == {1: 4.0, 4: 18.0}
    docs = spark.createDataFrame([(1, EASY, "en", 1, 1)], DOC)
    assert R.reading_levels(docs, spark.createDataFrame([], "doc_id long, grade int")).count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_held_out_labels(spark):
    import numpy as np

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/reading_labels.parquet")
    half = R.F.pmod(R.F.xxhash64("doc_id"), R.F.lit(2))
    kept = R.clean_labels(labels.where(half == 1))
    pairs = R.reading_levels(docs, labels.where(half == 0)).join(R.clean_labels(labels.where(half == 1)).withColumnRenamed("grade", "human"), "doc_id").where("grade is not null").toPandas()
    assert len(pairs) > 50 and np.corrcoef(pairs.grade, pairs.human)[0, 1] > 0.8 and np.abs(pairs.grade - pairs.human).mean() < 2
