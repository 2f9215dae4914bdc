from pathlib import Path

import pytest

from shutterloom.llm import mixing

pytestmark = pytest.mark.skipif(not Path(mixing.VOCABULARY).exists(), reason="no public vocabulary here")
DOC = "doc_id long, text string, source string, tokens string, _wanted int"
MIX = "mix_name string, source string, target_weight double, max_repeats int"


def docs(spark):
    rows = [(i, f"word {i} " * (5 + i % 7), "Big Source", "c", 0) for i in range(600)]
    rows += [(1000 + i, f"little {i} text", " small_source ", "c", 0) for i in range(20)]
    rows += [(2000 + i, f"other {i} text here", "other", "c", 0) for i in range(200)]
    rows += [(3000, None, "other", "c", 0), (3001, "", "other", "c", 0), (3002, "x", None, "c", 0), (None, "null id", "other", "c", 0)]
    return spark.createDataFrame(rows, DOC)


def targets(spark):
    rows = [("m", "big-source", 2.0, None), ("m", "SMALL SOURCE", 1.0, 3), ("m", "other", 1.0, 1), ("m", "absent", 4.0, 2), ("z", "other", float("nan"), 1), ("z", "big source", -1.0, 1), (None, "other", 1.0, 1), ("y", "other", 1.0, 0), ("w", "other", 0.5, 2), ("w", "Other", 0.5, 1)]
    return spark.createDataFrame(rows, MIX)


def test_shares_caps_and_missing_sources(spark):
    got = {(r.mix_name, r.source): r for r in mixing.report(docs(spark), targets(spark)).collect()}
    m = {s: r for (n, s), r in got.items() if n == "m"}
    assert m["absent"].actual_share == 0 and abs(m["absent"].target_share - 0.5) < 1e-9
    for s, share in (("big-source", 0.5), ("small-source", 0.25), ("other", 0.25)):
        assert abs(m[s].actual_share - share) < 0.03
    assert m["small-source"].most_repeats <= 3 and m["other"].most_repeats <= 1
    assert all(r.selected_docs == 0 for (n, _), r in got.items() if n in ("z", "y"))
    assert got["w", "other"].most_repeats == 1 and got["w", "other"].selected_docs == 201


def test_positions_are_ordered_and_follow_the_schedule(spark):
    rows = mixing.mix(docs(spark), targets(spark)).collect()
    m = [r for r in rows if r.mix_name == "m"]
    assert [r.position for r in m] == sorted(r.position for r in m) and 0 <= m[0].position and m[-1].position <= 1
    assert len({(r.doc_id, r.copy) for r in m}) == len(m)
    half = lambda s, early: sum(r.tokens for r in m if r.source == s and (r.position < 0.5) == early)
    assert half("big-source", False) > half("big-source", True)  # longer documents later
    for early in (True, False):  # the schedules add up at every time
        assert abs(sum(half(s, early) for s in ("big-source", "small-source", "other")) / sum(r.tokens for r in m) - 0.5) < 0.05


def test_a_given_budget_fills_up_capped_sources(spark):
    whole = sum(r.tokens for r in mixing.with_tokens(docs(spark)).where("source = 'big-source'").collect())
    got = {r.source: r for r in mixing.report(docs(spark), targets(spark).where("mix_name = 'm'"), total_tokens=3 * whole).collect()}
    assert got["small-source"].most_repeats == 3 and got["other"].most_repeats == 1
    assert abs(sum(r.selected_tokens for r in got.values()) / (3 * whole) - 1) < 0.02


def test_registered_mixes_take_as_much_as_their_sources_hold(spark, tmp_path):
    from shutterloom.llm import queries

    extra = spark.createDataFrame([("m", "unweighted", 0.0, 5)], MIX)
    targets(spark).unionByName(extra).write.parquet(f"{tmp_path}/mix_targets.parquet")
    more = docs(spark).unionByName(spark.createDataFrame([(5000 + i, "not asked for " * 40, "unweighted", "c", 0) for i in range(40)], DOC))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: r for r in queries.QUERIES["p8_report"](spark, str(tmp_path)).collect() if r.mix_name == "m"}
    whole = sum(got[s].held_tokens for s in ("big-source", "small-source", "other"))
    assert abs(sum(r.selected_tokens for r in got.values()) / whole - 1) < 0.02
    assert got["unweighted"].selected_tokens == 0 < got["unweighted"].held_tokens
    assert got["small-source"].most_repeats == 3 and got["small-source"].selected_tokens == 3 * got["small-source"].held_tokens
    assert got["small-source"].actual_share < got["small-source"].target_share
    mixed = [r for r in queries.QUERIES["p8_mix"](spark, str(tmp_path)).collect() if r.mix_name == "m"]
    assert sum(r.tokens for r in mixed) == sum(r.selected_tokens for r in got.values())


def test_ranges_give_the_same_streams(spark, monkeypatch):
    sized = mixing.with_tokens(docs(spark)).where("tokens > 0 and doc_id is not null")
    held = sized.groupBy("source").agg({"tokens": "sum", "*": "count"}).toDF("source", "a", "b")
    held = sized.groupBy("source").agg(mixing.F.sum("tokens").alias("tokens"), mixing.F.count("*").alias("docs"))
    run = lambda: {r.doc_id: r.upto for r in mixing._streams(sized, held).collect()}
    one = run()
    monkeypatch.setattr(mixing, "RANGE_ROWS", 37)
    assert run() == one and one


def test_inverse_of_the_schedule(spark):
    df = spark.createDataFrame([(t / 20, c / 10) for t in range(21) for c in (-5, 0, 5)], "t double, c double")
    t, c = mixing.F.col("t"), mixing.F.col("c")
    assert all(abs(r.a - r.t) < 1e-9 for r in df.select("t", mixing.schedule_inverse(t + c * (t * t - t), c).alias("a")).collect())


def test_empty_tables(spark):
    assert mixing.mix(docs(spark).limit(0), targets(spark)).count() == 0
    assert mixing.mix(docs(spark), targets(spark).limit(0)).count() == 0
    assert mixing.report(docs(spark).limit(0), targets(spark)).where("selected_tokens > 0").count() == 0
