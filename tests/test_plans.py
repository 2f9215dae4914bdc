from datetime import date

import pytest

from shutterloom.plans import dates, planner

TODAY = date(2024, 6, 12)  # a Wednesday


@pytest.mark.parametrize(
    "said, first, last",
    [
        ("photos from today", "2024-06-12", "2024-06-12"),
        ("yesterday", "2024-06-11", "2024-06-11"),
        ("last 3 days", "2024-06-09", "2024-06-12"),
        ("this week", "2024-06-10", "2024-06-12"),
        ("last week", "2024-06-03", "2024-06-09"),
        ("last month", "2024-05-01", "2024-05-31"),
        ("beach last year", "2023-01-01", "2023-12-31"),
        ("summer last year", "2023-01-01", "2023-12-31"),
        ("winter 2021", "2020-12-01", "2021-02-28"),
        ("2 years ago", "2022-01-01", "2022-12-31"),
        ("march 2 years ago", "2022-03-01", "2022-03-31"),
        ("3 months ago", "2024-03-01", "2024-03-31"),
        ("1 week ago", "2024-06-03", "2024-06-09"),
        ("this weekend", "2024-06-15", "2024-06-16"),
        ("christmas 2019", "2019-12-20", "2019-12-31"),
        ("first half 2020", "2020-01-01", "2020-06-30"),
        ("in 2018", "2018-01-01", "2018-12-31"),
        ("작년 여름", "2023-06-01", "2023-08-31"),
        ("3일 전", "2024-06-09", "2024-06-09"),
    ],
)
def test_dates(said, first, last):
    assert dates.parse(said, TODAY) == (date.fromisoformat(first), date.fromisoformat(last))


def test_no_date():
    assert dates.parse("old bridge", TODAY) is None


@pytest.mark.parametrize("said, want", [("alone", (1, 1)), ("three of us", (3, 3)), ("group photo", (2, None)), ("at least 4 people", (4, None)), ("more than two people", (3, None)), ("at most 3 people", (None, 3)), ("fewer than 3 people", (None, 2)), ("2 people", (2, 2)), ("5명 이상", (5, None)), ("bridge", (None, None))])
def test_face_count(said, want):
    assert planner.face_count(said) == want


def test_plan_requirements_and_intent():
    p = planner.make("Anna at the beach last summer without dog", TODAY, {"person": {"Anna"}})
    assert p.persons == ("Anna",) and "beach" in p.places and p.excluded == ("dog",) and "person" in p.needs and p.days
    assert planner.make("receipt", TODAY).intent == "ocr"
    assert planner.make("receipt from the beach", TODAY).intent == "mixed"
    assert planner.make("sunset", TODAY).intent == "visual"
    both = planner.make("Anna and Ben", TODAY, {"person": {"Anna", "Ben"}})
    assert both.all_persons and both.needs == {"person"}
    assert not planner.make("Anna or Ben", TODAY, {"person": {"Anna", "Ben"}}).all_persons
    assert planner.make("recipt", TODAY).text == "receipt"


def test_conditions_beside_a_date_and_unknown_words():
    p = planner.make("bridge last year without receipt weekend", TODAY)
    assert p.weekdays == (5, 6) and p.excluded == ("receipt",) and p.keywords == "bridge" and p.days == (date(2023, 1, 1), date(2023, 12, 31))
    assert planner.make("notebook is not far from market", TODAY).excluded == ()
    assert planner.make("평일 오전 학교", TODAY).weekdays == (0, 1, 2, 3, 4) and planner.make("평일 오전 학교", TODAY).daypart == "morning"
    assert planner.make("강아지 없는 공원", TODAY).excluded == ("강아지",)
    assert planner.tokenise("바다여행사진 엄마이랑아빠") == ("바다", "여행", "사진", "엄마", "아빠")
    assert planner.make("카메라 seoul", TODAY).places == ("서울",)
    assert planner.make("old riverside walk", TODAY, {"place": {"Riverside Park"}}).places == ("riverside",)


def test_the_router_weighs_hits():
    p = planner.make("quiet corner", TODAY)
    assert planner.route(p, word_hits=1, ocr_hits=1) == ("ocr", "auto-word-match")
    assert planner.route(planner.make("sunset", TODAY), word_hits=1, ocr_hits=1)[1] == "auto-word-match"


def test_exact_tag_switches_dates_off():
    assert planner.make("summer 2020", TODAY, {"visual": {"Summer 2020"}}).days is None


@pytest.mark.parametrize("said, how", [("receipt", ("ocr", "planner-ocr")), ("family with a receipt", ("hybrid", "auto-mixed")), ("family", ("semantic", "auto-face")), ("vacation", ("semantic", "auto-travel")), ("birthday", ("semantic", "auto-celebration")), ("sunset", ("semantic", "planner-visual")), ("ab-12", ("ocr", "auto-code")), ("quiet corner", ("hybrid", "fallback"))])
def test_route(said, how):
    assert planner.route(planner.make(said, TODAY)) == how
    assert planner.route(planner.make(said, TODAY), "semantic") == ("semantic", "manual")
