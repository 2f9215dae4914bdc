"""Reading level of documents from classic readability formulas.

Sentences, words, letters, syllables and long words are counted with syllable rules in the manner of hyphenation for
each language: a syllable is a group of vowels, patterns say where a break parts neighbouring vowels (muse-um, cre-ate,
po-ète) and which endings are mute, and each Hangul block is a syllable. Several formulas turn them into grade estimates; each is put on the scale of the human grades by a straight line
per language, fitted on a bounded sample of labelled documents, and their median is the reading level.

Defined results: documents without a letter (null, blank, digits only) have a null grade; rows with a null id are left
out; every row of a repeated document counts by itself; labels that are null, outside 1 to 18 or without a document are
ignored and several labels of one document count as their median; without labels the formulas count as they are; texts
of any length are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.session import cut_lineage, release

#: Labelled documents on which the lines are fitted at most, and those a language needs for lines of its own.
CALIBRATION_DOCS = 50_000
CALIBRATION_LEAST = 12
#: Grades by which a label may be off the first line.
OUTLIER = 4.0
LANGUAGES = ("en", "de", "fr", "ko")
# Frequent short words that tell the languages apart.
_COMMON = {
    "en": "the and of to is was in that it with for on this we my are he she they you not but from have had were at by as be his her or our their there which when what all one out so up if into then some would could been has who more",
    "de": "der die das und ist nicht ein eine wir den im zu von mit sich wird auf für als dem des es auch sie er ich war sind bei aus nach wie hat noch nur oder aber über einen einer zum zur dass wenn man so um am bis ihre sein",
    "fr": "le la les des et est une un du nous dans que pour au il sur qui ne pas se ce plus par avec je vous elle sont aux mais ou cette son sa ses ils tout leur deux comme été où très sans même après être fait était",
}
_VOWEL = "aeiouyäöüàâáéèêëîïíôóùûúœæ"
_CONSONANT = "bcdfghjklmnpqrstvwxzßçñ"
#: Breaks between neighbouring vowels, written like hyphenation patterns: a digit stands between two letters, the largest
#: digit of all patterns that fit decides, odd is a break, even is none; a full stop is the edge of the word.
_PATTERNS = {
    "en": "i1a i1o i1u ti2a ti2o si2o si2a ci2a ci2o ci2u gi2o gi2a xi2o xi2u lli2o ni2o i2age i1et i1ent i1ence ci2en ti2en .sci3e"
    " u1a qu2a gu2a e1um e1us. cre1a ide1a are1a e1o. e1os. e1or e1og e1ous re1ali e1ing y1ing o1ing a1o u1ou u1ity u1el. o1em o1et"
    " i1er. i1est. pi2er. ti2er. u1in. ue2",
    "de": "i1o i1a i1u i1ö e1um e1us. e1a e1o u1e u1a u1o u1ö u1ä qu2e qu2a qu2o qu2ä ei1e o1e o1a a1o y1a y1e",
    "fr": "é1a é1â é1e é1i é1o é1u o1è o1é a1é a1ï o1ï a1ë o1ë u1é qu2é gu2é qu2è gu2è a1o a2oû cri1e bri1e pri1e tri1e vri1e gri1e pli1e bli1e",
}
_SIBILANT = ("s", "z", "x", "c", "g", "ch", "sh")


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?:\s|$)|\n\s*(?=[A-ZÀ-ÖØ-Þ\d])")
_TAG = re.compile(r"<[A-Za-z/!][^<>]*>|&#?\w{1,8};")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_HANGUL = re.compile("[가-힣]")
_GROUP = re.compile(f"[{_VOWEL}]+")
_MEMO = 200_000


def _levels(language: str) -> dict[str, list[tuple[int, int]]]:
    """The letters of each pattern with the places and sizes of its digits."""
    out = {}
    for p in _PATTERNS.get(language, "").split():
        letters = re.sub(r"\d", "", p)
        out[letters] = [(len(re.sub(r"\d", "", p[: m.start()])), int(m[0])) for m in re.finditer(r"\d", p)]
    return out


_LEVELS = {k: _levels(k) for k in _PATTERNS}
_LONGEST = max(len(p) for levels in _LEVELS.values() for p in levels)


def _breaks(word: str, language: str) -> set[int]:
    """Places in ``word`` where the language's patterns part two letters."""
    found: dict[int, int] = {}
    edged, levels = f".{word}.", _LEVELS.get(language, {})
    for i in range(len(edged)):
        for n in range(2, min(_LONGEST, len(edged) - i) + 1):
            for at, size in levels.get(edged[i : i + n], ()):
                found[i + at - 1] = max(found.get(i + at - 1, 0), size)
    return {at for at, size in found.items() if size % 2}


def _mute(head: str, tail: str, language: str) -> bool:
    """Whether an e between ``head`` and ``tail`` at the end of a word is not spoken."""
    voiced = head[-1:] == "l" and head[-2:-1] not in _VOWEL  # ta-ble
    if language == "en":
        return tail == "" and not voiced or tail == "s" and not voiced and not head.endswith(_SIBILANT) or tail == "d" and not voiced and not head.endswith(("t", "d"))
    return language == "fr" and (tail in ("", "s") or tail == "nt" and not head.endswith("m"))


def syllables(word: str, language: str) -> int:
    """Groups of vowels, parted where the language's patterns break them, without a mute ending; each Hangul block is a
    syllable; one at least."""
    blocks = len(_HANGUL.findall(word))
    groups = list(_GROUP.finditer(word))
    apart = _breaks(word, language) if any(len(g[0]) > 1 for g in groups) else ()
    starts = [k for g in groups for k in range(g.start(), g.end()) if k == g.start() or k in apart]
    n = len(starts)
    if n > 1 and word[starts[-1]] == "e" and groups[-1].end() == starts[-1] + 1 and _mute(word[: starts[-1]], word[starts[-1] + 1 :], language):
        n -= 1
    return max(1, blocks + n)


def _shape(word: str, language: str) -> tuple[int, int, int, int, int]:
    """(letters, syllables, long, of many syllables, of one syllable)"""
    n, letters = syllables(word, language), sum(map(str.isalpha, word))
    if language == "ko":  # names in other letters say nothing about the level
        return (letters, n, int(n >= 4), int(n >= 5), int(n <= 2)) if _HANGUL.search(word) else (3, 3, 0, 0, 0)
    return letters, n, int(letters >= 7), int(n >= 3), int(n == 1)


def _language(words: Counter, said: str | None) -> str:
    blocks = sum(n for w, n in words.items() if "가" <= w[0] <= "힣")
    if blocks > 0.3 * sum(words.values()):
        return "ko"
    hits = {k: sum(words[w] for w in common) for k, common in _COMMON_WORDS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] else (said or "").strip().lower()[:2] if (said or "").strip().lower()[:2] in LANGUAGES else "en"


_COMMON_WORDS = {k: v.split() for k, v in _COMMON.items()}
_MEASURES = "doc_id long, language string, sentences double, words double, letters double, syllables double, long double, poly double, single double"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, dict[str, tuple[int, int, int, int, int]]] = {k: {} for k in LANGUAGES}
    for b in batches:
        out = []
        for doc, text, said in zip(b["doc_id"], b["text"], b["lang"]):
            text = text or ""
            if "<" in text or "&" in text:
                text = _TAG.sub(" ", text)
            if not text.isascii():
                text = _INVISIBLE.sub("", text)
            words = Counter(_WORD.findall(text.lower()))
            language = _language(words, said)
            known, sums = memo[language], [0, 0, 0, 0, 0]
            if len(known) > _MEMO:
                known.clear()
            for w, n in words.items():
                f = known.get(w)
                if f is None:
                    f = known[w] = _shape(w, language)
                for i in range(5):
                    sums[i] += n * f[i]
            out.append((doc, language, max(1, len(_STOP.findall(text))), sum(words.values()), *sums))
        yield pd.DataFrame(out, columns=["doc_id", "language", "sentences", "words", "letters", "syllables", "long", "poly", "single"])


def measures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, sentences, words, letters, syllables, long, poly, single) of every document.

    Counted in Arrow batches: the features of a word are worked out once and remembered, which costs a tenth of one
    regular-expression pass over the text for each feature.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id is not null")
    return rows.mapInPandas(_measure, _MEASURES)


def formulas() -> dict[str, Column]:
    """Grade estimates, by their usual constants, over the columns of ``measures``."""
    w, s = F.col("words"), F.col("sentences")
    per = w / s
    return {
        "flesch_kincaid": 0.39 * per + 11.8 * F.col("syllables") / w - 15.59,
        "gunning_fog": 0.4 * (per + 100 * F.col("poly") / w),
        "smog": 1.043 * F.sqrt(30 * F.col("poly") / s) + 3.1291,
        "coleman_liau": 5.88 * F.col("letters") / w - 29.6 * s / w - 15.8,
        "automated_index": 4.71 * F.col("letters") / w + 0.5 * per - 21.43,
        "lix": (per + 100 * F.col("long") / w) / 5 - 2,
        "wiener": 0.1935 * 100 * F.col("poly") / w + 0.1672 * per + 0.1297 * 100 * F.col("long") / w - 0.0327 * 100 * F.col("single") / w - 0.875,
    }


def _lines(measured: DataFrame, labels: DataFrame) -> dict[tuple[str, str], tuple[float, float]]:
    """(language, formula) to slope and intercept; the language "" stands for all.

    Fitted twice: the second time without the labels that lie ``OUTLIER`` grades or more off the first line.
    """
    names = list(formulas())
    both = cut_lineage(measured.where("words > 0").select("doc_id", "language", *[c.alias(n) for n, c in formulas().items()]).join(labels, "doc_id"))

    def fit(first: dict[tuple[str, str], tuple[float, float]]) -> dict[tuple[str, str], tuple[float, float]]:
        rows = both.unionByName(both.withColumn("language", F.lit("")))
        fits = []
        for n in names:
            near = F.lit(True)
            for (lang, name), (a, b) in first.items():
                if name == n:
                    near = near & ((F.col("language") != lang) | (F.abs(F.col("grade") - (a * F.col(n) + b)) < OUTLIER))
            y = F.when(near, F.col("grade"))
            fits += [F.regr_slope(y, F.col(n)).alias(f"a_{n}"), F.regr_intercept(y, F.col(n)).alias(f"b_{n}")]
        out = {}
        for r in rows.groupBy("language").agg(F.count("*").alias("n"), *fits).collect():  # one row a language
            for n in names:
                if r.n >= CALIBRATION_LEAST and r[f"a_{n}"] is not None:
                    out[r.language, n] = (r[f"a_{n}"], r[f"b_{n}"])
        return out

    lines = fit(fit({}))
    release(both)
    return lines


def clean_labels(labels: DataFrame, id_col: str = "doc_id", grade_col: str = "grade") -> DataFrame:
    """(doc_id, grade): the median of the possible grades of a document, for a bounded sample of documents."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("double").alias("grade")).where("doc_id is not null and grade between 1 and 18")
    return rows.groupBy("doc_id").agg(F.median("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCS)


def reading_levels(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, language, words, sentences, grade, spread): the median of the grade estimates and their range."""
    lines: dict[tuple[str, str], tuple[float, float]] = {}
    if labels is not None:
        known = F.broadcast(clean_labels(labels))  # at most CALIBRATION_DOCS rows of two numbers
        lines = _lines(measures(documents.join(known.select("doc_id"), "doc_id", "left_semi")), known)
    grades = []
    for name, raw in formulas().items():
        scaled = F.when(F.lit(False), raw)
        for lang in LANGUAGES:
            if (lang, name) in lines:
                a, b = lines[lang, name]
                scaled = scaled.when(F.col("language") == lang, a * raw + b)
        a, b = lines.get(("", name), (1.0, 0.0))
        grades.append(F.greatest(F.lit(1.0), F.least(F.lit(18.0), scaled.otherwise(a * raw + b))))
    ordered = F.when(F.col("words") > 0, F.array_sort(F.array(*grades)))
    return (
        measures(documents)
        .withColumn("_g", ordered)
        .select(
            "doc_id",
            "language",
            F.col("words").cast("long").alias("words"),
            F.col("sentences").cast("long").alias("sentences"),
            F.round(F.col("_g")[len(grades) // 2], 3).alias("grade"),
            F.round(F.col("_g")[len(grades) - 1] - F.col("_g")[0], 3).alias("spread"),
        )
    )
