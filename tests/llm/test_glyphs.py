import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterloom.llm import glyphs


def forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, form string")
    return [r.out for r in glyphs.with_form(df, "form", "out").orderBy("i").collect()]


SAME = [
    ("ＩＭＧ＿００１．ｊｐｇ", "IMG_001.jpg"),
    ("Cafe\u0301", "Café"),
    ("a\u00a0b\u2009c\u3000d", "a b c d"),
    ("so\u00adft\u200b\ufeff", "soft"),
    ("Вirthdаy", "Birthday"),
    ("ﬁne oﬃce", "fine office"),
    ("\u1112\u1161\u11ab", "한"),
    ("a‑b‐c－d", "a-b-c-d"),
    ("ё", "ë"),
    ("e\u200b\u0301", "é"),
    ("ӏοѕѕ", "loss"),
    ("\u212b", "Å"),
    ("\ufefc\ufe8d", "\u0644\u0627\u0627"),
    ("\ufb50", "\u0671"),
    ("ᎪᏟꓐ"[0] + "Ꮯ" + "ꓐ", "ACB"),
]
APART = [("a", "A"), ("e", "é"), ("0", "O"), ("l", "1"), ("a b", "a  b"), ("rn", "m"), ("x²", "x2"), ("и", "й"), ("I", "l")]


def test_same_and_apart(spark):
    got = forms(spark, [t for pair in SAME + APART for t in pair])
    for n, (a, b) in enumerate(SAME + APART):
        assert (got[2 * n] == got[2 * n + 1]) == (n < len(SAME)), (a, b, got[2 * n], got[2 * n + 1])


def test_nulls_blanks_and_long_texts(spark):
    assert forms(spark, [None, "", "\u200b", "a\tb", "é" * 200_000]) == [None, "", "", "a b", "é" * 200_000]
    df = spark.createDataFrame([], "form string, out int")
    assert glyphs.with_form(df, "form", "out").count() == 0


def test_against_a_plain_python_form(spark):
    table = str.maketrans(glyphs._SINGLE)

    def plain(t):
        t = "".join(" " if unicodedata.category(c) == "Zs" or c in "\t\n\r" else c for c in t if unicodedata.category(c) != "Cf").translate(table)
        for a, b in glyphs._SEVERAL.items():
            t = t.replace(a, b)
        return unicodedata.normalize("NFC", t)

    texts = []

    @settings(max_examples=200, database=None)
    @given(st.text(alphabet=st.sampled_from("abIl0 éñАаеоКкпй가한하Ａａ０ﬁﬃ\u0301\u0308\u200b\u00ad\u00a0\u2010写"), max_size=12))
    def collect(t):
        texts.append(t)

    collect()
    assert forms(spark, texts) == [plain(t) for t in texts]


@pytest.fixture
def tables(spark):
    obs = spark.createDataFrame([(1, "/a/Café.jpg", "c"), (2, "/a/Cafe\u0301.jpg", "c"), (3, None, "c"), (4, "/a/cafe.jpg", "c"), (2, "/a/Cafe\u0301.jpg", "c")], "id long, current_path string, form string")
    files = spark.createDataFrame([("f", "/a/Café.jpg", "Café.jpg", "c"), ("g", "/a/Café.jpg", "Ｃafé.jpg", "c"), ("h", None, "x", "c"), ("n", "/a/Café.jpg", None, "c")], "file_id string, current_path string, filename string, o_path string")
    return obs, files


def test_same_looking(tables):
    got = sorted((r.obs_id, r.file_id) for r in glyphs.same_looking(*tables).collect())
    assert got == [(1, "g"), (1, "n"), (2, "f"), (2, "g"), (2, "n")]
    assert glyphs.same_looking(tables[0].limit(0), tables[1]).count() == 0


def test_expression_is_one_line_of_sql():
    assert re.match(r"CASE WHEN .* END$", glyphs.form_sql("x"), re.S)
