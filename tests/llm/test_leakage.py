import pickle
import random

import numpy as np
import pytest

from shutterloom.llm import leakage

WORDS = "amber bellows cracked dune ember falcon granite harbour indigo juniper kettle lantern marble nettle orchard pewter quarry raven saddle timber umber velvet willow yarrow zephyr anchor basil cedar dahlia elder".split()
INTRO = "Answer the question below using only the facts that the passage states and nothing else. "


def item(n):
    rng = random.Random(n)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) + str(n % 7) * (k % 9 == 0) for k in range(40))


ITEMS = [(n, (INTRO if n % 2 else "") + item(n), "suite", "A") for n in range(12)] + [(50, None, "s", "A"), (51, "too short", "s", "A"), (52, "", "s", None)]
FILL = "Yesterday we walked along the river and took many pictures of the old town before it rained. "


def found(spark, docs, items=ITEMS, **how):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, word_share int")
    e = spark.createDataFrame(items, "item_id long, text string, suite string, answer string")
    return sorted((r.doc_id, r.item_id) for r in leakage.find(d, e, answer_col="answer", **how).collect())


def index_of(spark, items):
    e = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, answer string")
    return pickle.loads(leakage.index_blocks(e)[0].first().data)


def leaked(index, text):
    return [x[1] for x in index.leaks([leakage.words(text)])]


def test_items_of_every_length(spark):
    rng = random.Random(9)
    letters = "bcdfghklmnprstvz"
    vocabulary = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    long = {n: [rng.choice(vocabulary) for _ in range(n)] for n in (100, 129, 200, 400, 900, 3000, 10_000)}
    index = index_of(spark, [(n, " ".join(w)) for n, w in long.items()])
    fill = FILL * 40
    for n, w in long.items():
        assert leaked(index, fill + " ".join(w) + " " + fill) == [n]
        assert leaked(index, fill + " ".join(w[n // 3 : n // 3 + int(0.6 * n)]) + " " + fill) == [n]  # a part
        assert leaked(index, fill + " ".join(x for k, x in enumerate(w) if k % 3) + " " + fill) == [n]  # thinned out
        assert leaked(index, fill + " ".join(w[: int(0.3 * n)]) + " " + fill) == []
        assert leaked(index, fill + " ".join(rng.sample(w, n)) + " " + fill) == []  # out of order


def test_layouts_and_encodings(spark):
    t = item(3)
    w = t.split()
    docs = [
        (1, FILL + t + FILL),
        (2, FILL + "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, 40, 5))),
        (3, "<p>" + " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)) + "</p>"),
        (4, FILL + "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "\u3000" for c in t)),
        (5, FILL + t.replace("e", "е").replace(" ", "\u00a0").replace("a", "a\u200b")),
        (6, FILL + " ".join(x for i, x in enumerate(w) if i % 6)),
        (7, FILL + t.upper()),
        (8, FILL + " ".join(w[:24])),
        (9, t.replace("o", "0").replace("l", "1")),
        (1, FILL + t + FILL),
        (10, '{"text": "' + t.replace(" ", "\\u0020") + '"}'),
    ]
    assert found(spark, docs) == [(i, 3) for i in range(1, 11)]


def test_no_cases(spark):
    w = item(3).split()
    mixed = w[:]
    random.Random(1).shuffle(mixed)
    apart = (" " + FILL * 3).join(w)
    docs = [(1, None), (2, ""), (3, "   "), (4, INTRO * 3), (5, " ".join(w[:9])), (6, " ".join(mixed)), (7, apart), (8, FILL * 5), (None, item(3)), (9, " ".join(random.Random(9).choice(WORDS) for _ in range(60)))]
    assert found(spark, docs) == []
    assert found(spark, []) == []


def test_very_long_texts_and_several_items(spark):
    assert found(spark, [(1, FILL * 4000 + item(2) + FILL * 4000 + item(5))]) == [(1, 2), (1, 5)]


def test_blocks_do_not_change_the_result(spark):
    instruction = " ".join(f"instruction{k} word" for k in range(15)) + " "
    rng = random.Random(4)
    own = {n: " ".join("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(15)) for n in range(9)}
    items = [(n, instruction + own[n], "s", None) for n in range(6)] + [(n, own[n], "s", "") for n in range(6, 9)]
    docs = [(n, FILL + own[n] + FILL) for n in range(9)] + [(20, instruction), (21, FILL + instruction + own[1][:20])]
    whole = found(spark, docs, items)
    assert whole == [(n, n) for n in range(9)]
    assert leakage.index_blocks(spark.createDataFrame([(i, t, None) for i, t, _, _ in items], "item_id long, text string, answer string"), 300)[1] > 3
    assert found(spark, docs, items, block_chars=300) == whole
    assert found(spark, docs, ITEMS, block_chars=500) == found(spark, docs, ITEMS)


def test_copies_of_an_item_are_no_instruction(spark):
    items = [(n, item(3), "s", None) for n in range(4)]
    assert found(spark, [(1, FILL + item(3))], items) == [(1, n) for n in range(4)]


def test_an_answer_makes_up_for_missing_words(spark):
    items = [(1, item(3), "s", "the heron stood beside seventeen bottles"), (2, item(4), "s", "B")]
    part = {n: " ".join(item(n).split()[:18]) + " " for n in (3, 4)}  # 18 of 40 words
    docs = [(1, FILL + part[3] + FILL), (2, FILL + part[3] + "The heron stood beside 17 bottles, seventeen bottles. " + FILL), (3, part[4] + "B"), (4, "the heron stood beside seventeen bottles")]
    assert found(spark, docs, items) == [(2, 1)]


def test_long_words_tags_and_comments(spark):
    rng = random.Random(2)
    long = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(30)) for _ in range(10)]
    slipped = " ".join(w[:25] + "x" + w[26:] for w in long)
    tagged = f"<p style='{'x' * 5000}'>" + item(3).replace(" ", "<!-- " + "y " * 3000 + "--> ", 3)
    assert found(spark, [(1, slipped), (2, tagged)], [(1, " ".join(long), "s", None), (2, item(3), "s", None)]) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("n", [4, 5, 6, 8, 39, 40, 41, 42, 60])
def test_slips_of_words(n):
    rng = random.Random(n)
    w = "".join(rng.choice("abdfghk") for _ in range(n))
    for i in range(n):
        for other in (w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]):
            if min(len(other), n) >= 5:
                assert leakage._near(w, other) and set(leakage._keys(w)) & set(leakage._keys(other)), (w, other)


def test_wand_retrieves_what_plain_scoring_does(spark):
    index = index_of(spark, [(i, t) for i, t, _, _ in ITEMS if t])
    rng = random.Random(5)
    for _ in range(50):
        terms = np.array(sorted(rng.sample(range(len(index.vocab)), 25)))
        plain = {}
        for block in index.post:
            for t in terms.tolist():
                for d, x in block.get(t, ()):
                    plain[d] = plain.get(d, 0) + x
        for level in (0.05, 0.2, 0.4):
            assert sorted(index.wand(terms, np.arange(len(index.post)), level)) == sorted(d for d, x in plain.items() if x >= level)


def test_empty_item_table(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert leakage.find(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leakage.find(d.limit(0), spark.createDataFrame([(1, item(1))], "item_id long, text string")).count() == 0
