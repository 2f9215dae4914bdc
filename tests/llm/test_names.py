import pytest

from shutterloom.llm import names

KIND = "id long, display_name string, aliases_json string, core string, entity long"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    out = {}
    for r in names.entities(df).collect():
        out.setdefault(r.entity, set()).add(r.id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("name", ["", "   ", None, "Person 12", "인물 7", "unnamed", "Unknown", "Uncle Bob", "the birthday kid", "Kate", "Priscilla D.", "me", "person-000012", "?!"])
def test_nobody(name):
    assert names.Lexicon().parse(name) == []


@pytest.mark.parametrize("a, b", [("abcd", "abd"), ("abd", "abcd"), ("abcd", "abxd"), ("abcd", "abdc"), ("a", "a"), ("abcd", "xabcd")])
def test_one_slip(a, b):
    assert names.slips(a, b)


@pytest.mark.parametrize("a, b", [("abcd", "ab"), ("abcd", "axyd"), ("abcd", "dcba"), ("abcd", "abdcx")])
def test_more_than_one_slip(a, b):
    assert not names.slips(a, b)


def test_alignment():
    assert names.Lexicon().align(["smith", "robert"], ["bob", "smith"]) < 0.2
    assert names.Lexicon().align(["smith", "r"], ["robert", "smith"]) <= 0.2
    assert names.Lexicon().align(["smith", "robert"], ["smith", "alice"]) >= 0.5
    assert names.Lexicon().align([], ["x"]) == 1.0


def test_variants_of_one_person_and_namesakes(spark):
    rows = [
        (1, "Robert Wendelgrad", None),
        (2, "Bob Wendelgrad", "[]"),
        (3, "WENDELGRAD, Robert J.", ""),
        (4, "Róbert_Wendelgrad", "null"),
        (5, "Robert Wendlegrad", "not json at all 12"),
        (6, "R. Wendelgrad", '["Dad"]'),
        (7, "Person 9", '["Bobby Wendelgrad"]'),
        (8, "Robert Wendelgrad-Hollmanns", None),
        (9, "Capt. Robert Wendelgrad (family)", None),
        (10, "Alice Wendelgrad", None),
        (11, "Robert Otherlings", None),
        (12, "RobertWendelgrad", None),
        (13, "unnamed", None),
        (14, None, None),
        (None, "Robert Wendelgrad", None),
        (1, "Robert Wendelgrad", None),
    ]
    assert groups(spark, rows) == [[1, 2, 3, 4, 5, 6, 7, 8, 9, 12], [10], [11]]


def test_doubtful_initials_stay_alone(spark):
    rows = [(1, "Robert Wendelgrad", None), (2, "Rachel Wendelgrad", None), (3, "R. Wendelgrad", None)]
    assert groups(spark, rows) == [[1], [2], [3]]


def test_all_words_of_a_name_are_aligned(spark):
    rows = [
        (1, "Giovanni Wendelgrad", None), (2, "Gio Wendelgrad", None),  # a beginning that no list has
        (3, "Robert James Dorlenkamp", None), (4, "Robert J. Dorlenkamp", None), (5, "Robert Karl Dorlenkamp", None),  # another middle name
        (6, "Fiorenzo Talbervinck", None), (7, "Fiorenz Talbervink", None),  # a slip in both
        (8, "Fiorella Talbervinck", None),
    ]
    assert groups(spark, rows) == [[1, 2], [3, 4], [5], [6, 7], [8]]


def test_slips_in_short_tokens(spark):
    rows = [(1, "Robert Smith", None), (2, "Robert Smth", None), (3, "Alice Kern", None), (4, "Alice Kenr", None), (5, "Timo Wendelgrad", None), (6, "Tiom Wendelgrad", None), (7, "Robert Voss", None), (8, "Robert Vogt", None), (9, "Alice Voss", None), (10, "Robert Kim", None), (11, "Robert Lim", None), (12, "Thomas Berg", None), (13, "Thomas Beg", None)]
    assert groups(spark, rows) == [[1, 2], [3, 4], [5, 6], [7], [8], [9], [10], [11], [12, 13]]


def test_doubtful_beginnings_stay_alone(spark):
    rows = [(1, "Giovanni Wendelgrad", None), (2, "Giordano Wendelgrad", None), (3, "Gio Wendelgrad", None), (4, "Gio Wendel", None)]
    assert groups(spark, rows) == [[1], [2], [3], [4]]


def test_alignment_of_many_words():
    many = "abel bruno cesar dario enzo fabio guido hugo italo".split()
    assert names.Lexicon().align(many, [*reversed(many), "luca"]) == 0.0
    assert names.Lexicon().same_words(" ".join(many), " ".join([*many[:-1], "luca"])) is False


def test_organisations(spark):
    rows = [(1, "Melgundhaven Football Club", None), (2, "The Melgundhaven Footbal Club", None), (3, "Football Club Melgundhaven", None), (4, "Melgundhaven FC", None), (5, "Melgundhaven Chamber Choir", None), (6, "Ch. Choir of Melgundhaven", None)]
    assert groups(spark, rows) == [[1, 2, 3, 4], [5, 6]]


def test_pairs_empty_and_long_names(spark):
    df = spark.createDataFrame([(1, "x" * 50_000 + " Robert", None, "", 0), (2, "Robert " + "x" * 50_000, None, "", 0)], KIND)
    assert [tuple(r) for r in names.same_pairs(df).collect()] == [(1, 2)]
    assert names.same_pairs(df.limit(0)).count() == 0


def test_similar_tokens_of_every_length(spark):
    import random

    rng = random.Random(4)
    near = []
    for n in (5, 9, 63, 64, 65, 66, 200):
        t = "".join(rng.choice("abcdefgh") for _ in range(n))
        for _ in range(12):
            i = rng.randrange(n - 1)
            near.append((t, rng.choice([t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[:i] + "z" + t[i + 1 :], t[:i] + t[i + 1] + t[i] + t[i + 2 :]])))
    tokens = sorted({t for pair in near for t in pair if len(t) >= 5})
    got = {tuple(r) for r in names.similar_tokens(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == {(a, b) for a in tokens for b in tokens if a != b and names.slips(a, b)}


def test_names_no_list_has(spark):
    rows = [
        (1, "Priya Natarajan", None), (2, "Priscilla Natarajan", None), (3, "Natarajan, Priya", None),
        (4, "Mia Kern", None), (5, "Mia Kren", None),
        (6, "Mary Ann van der Berg", None), (7, "Mary van der Berg", None), (8, "Ann van der Graaf", None),
        (9, "김민준", None), (10, "김 민준", None), (11, "김민중", None), (12, "민준", None), (13, "엄마", None),
        (14, "Acme Ltd", None), (15, "ACME Limited", None), (16, "Acme Inc", None),
        (17, "Tom Wolf", None), (18, "Tom Wolff", None), (19, "Tom Park", None), (20, "Tom Prak", None),
    ]
    assert groups(spark, rows) == [[1, 3], [2], [4, 5], [6, 7], [8], [9, 10], [11], [14, 15], [16], [17, 18], [19, 20]]


def test_a_lexicon_of_ones_own(spark):
    rows = [(1, "Giuseppe Wendelgrad", None), (2, "Beppe Wendelgrad", None), (3, "Capo Wendelgrad", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    assert names.same_pairs(df).count() == 0
    known = names.Lexicon(short={"giuseppe": "beppe peppe"}, roles=["capo"])
    assert [tuple(r) for r in names.same_pairs(df, known).collect()] == [(1, 2)]
