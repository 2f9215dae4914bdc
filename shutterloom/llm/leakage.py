"""Held-out test items that leak, whole or in part, into training documents.

Items form a BM25 inverted index whose impacts are divided by the item's score for its own words, so one threshold
serves items of every length; items longer than ``PART`` words are indexed in overlapping parts. Every passage of every
document (overlapping windows over the whole text) is a query: the largest impacts of its terms bound what any block of
items can score, and block-max WAND retrieves all items above the threshold from the blocks that can reach it. Retrieved
items are verified against the text around the passage, over a stretch that grows with the item: their own words must be
met in order and close together, by count and by weight. An answer longer than a letter is looked for next to the
stretch; where it is carried, somewhat less of the question is enough.

Instructions, document frequencies and lengths are worked out over all items before these are cut into index blocks of
bounded size, and whether two words match depends on these two words alone, so blocks do not change the result.

Before that, text is brought to plain words: markup and escapes are undone, characters that look alike are mapped,
invisible ones removed, quoting and line breaks ignored, and single-character slips matched through folds and deletes.

Defined results: null and blank texts carry nothing; items that are null or shorter than ``MIN_WORDS`` own words are no
case (an instruction shared by several different items is not their own); every row of a repeated document counts by
itself; rows with a null id are left out; a null, blank or one-letter answer proves nothing; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.llm.glyphs import LOOKALIKES
from shutterloom.session import cut_lineage

MIN_WORDS = 8
#: Share of a part's BM25 weight a passage must reach to be verified, and the shares of an item verified in order.
RETRIEVE = 0.33
COUNT_SHARE = 0.5
WEIGHT_SHARE = 0.4
#: Shares that are enough where this share of an answer of two words or more stands by.
ANSWER_SHARE, COUNT_BY_ANSWER, WEIGHT_BY_ANSWER = 0.8, 0.4, 0.3
WINDOW, STRIDE = 256, 128
#: Longest run of an item's words that is retrieved as one: some window holds any such run whole.
PART = 128
K1, B = 1.2, 0.75
#: Entries of the table of block maxima at most, and blocks at most.
MAXIMA, BLOCKS = 4_000_000, 64
#: Characters of items in one index block (an item longer than this is a block of its own size).
BLOCK_CHARS = 4_000_000
#: Characters of documents that are held as words at once (a longer document is handled alone).
CHUNK_CHARS = 2_000_000
#: An opening that at least this many different items share, of at least this many words, is an instruction.
SHARED_BY, SHARED_WORDS = 3, 6
#: Letters from which a word is indexed by its halves instead of all that is left after deleting one letter.
LONG_WORD = 40
_MEMO = 200_000

_TAG = re.compile(r"</?([a-zA-Z]+)[^<>]*>")
_INLINE = frozenset("b i u a em strong span font sub sup small mark".split())
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x3100) if unicodedata.combining(chr(c))) + "︠-︯]+")
_WORD = re.compile(r"[a-z0-9]+|[^\W_a-z0-9]+")
_LOOK = str.maketrans(LOOKALIKES)
_LOOKS = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
_FOLD = str.maketrans("0135cqij", "olesegll")


def _without_comments(text: str) -> str:
    out, at = [], 0
    while True:
        start = text.find("<!--", at)
        end = text.find("-->", start + 4) if start >= 0 else -1
        if end < 0:
            return "".join([*out, text[at:]])
        out += [text[at:start], " "]
        at = end + 3


def plain(text: str) -> str:
    """Lower-case text without markup, escapes, invisible characters, look-alikes and accents."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[1].lower() in _INLINE else " ", _without_comments(text))
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text).replace("\\n", "\n").replace("\\t", " ").replace("\\r", " ")
    if "%" in text:
        text = _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        if _LOOKS.search(text):
            text = text.translate(_LOOK)
    return text.lower()


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text).replace("-\n", "-")) if text else []


def _folded(w: str) -> str:
    return w.replace("rn", "m").replace("vv", "w").translate(_FOLD)


def _keys(f: str) -> list[str]:
    """Keys of a folded word that it shares with any word one slip apart."""
    n = len(f)
    if n < 5:
        return [f]
    out = [f, *(f[:i] + f[i + 1 :] for i in range(n))] if n <= LONG_WORD + 1 else []
    if n >= LONG_WORD:  # a slip leaves the first or the last part of a long word as it is
        out += [f"{m}{side}{part}" for m in (n - 1, n, n + 1) for side, part in (("<", f[: m // 2 - 1]), (">", f[n - m // 2 + 2 :]))]
    return out


def _near(f: str, g: str) -> bool:
    """Whether two folded words share what is left after deleting at most one letter of each."""
    if f == g:
        return True
    if min(len(f), len(g)) < 5 - (len(f) != len(g)) or abs(len(f) - len(g)) > 1:
        return False
    i, j = 0, 0
    while i < min(len(f), len(g)) and f[i] == g[i]:
        i += 1
    while j < min(len(f), len(g)) - i and f[-1 - j] == g[-1 - j]:
        j += 1
    x, y = f[i : len(f) - j], g[i : len(g) - j]
    return len(x) <= 1 and len(y) <= 1 or len(x) == len(y) and (x[1:] == y[:-1] or x[:-1] == y[1:])


class ItemIndex:
    """Inverted index of one block of items in block-max form, with the statistics of all items."""

    def __init__(self, ids: list[int], own: list[list[str]], answers: list[list[str]], idf: dict[str, float], mean: float) -> None:
        self.ids = ids
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(w for ws in [*own, *answers] for w in ws))}
        self.seq = [np.array([self.vocab[w] for w in ws], np.int32) for ws in own]
        self.answer = [np.array([self.vocab[w] for w in ws], np.int32) for ws in answers]
        self.idf = np.array([idf.get(w, 0.0) for w in self.vocab])
        parts = [(d, s[k : k + PART]) for d, s in enumerate(self.seq) for k in range(0, max(1, len(s) - PART // 2), PART // 2)]
        self.item = [d for d, _ in parts]  # the item of each part
        post: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, (_, s) in enumerate(parts):
            tf = Counter(s.tolist())
            imp = {t: self.idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(s) / mean)) for t, f in tf.items()}
            whole = sum(imp.values()) or 1.0
            for t, x in imp.items():
                post[t].append((d, x / whole))
        blocks = min(BLOCKS, max(1, MAXIMA // max(1, len(self.vocab))), max(1, len(parts)))
        size = math.ceil(max(1, len(parts)) / blocks)  # parts in one block
        self.most = np.zeros((max(1, len(self.vocab)), math.ceil(max(1, len(parts)) / size)), np.float32)  # largest impact of a term in each block
        self.post: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(self.most.shape[1])]
        for t, p in post.items():
            for d, x in p:
                self.post[d // size][t].append((d, x))
                self.most[t, d // size] = max(self.most[t, d // size], x)
        self.weight = [self.idf[s] for s in self.seq]
        self.open()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("folds", "cuts", "forms", "memo", "retrieved")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def open(self) -> None:
        """Tables by which words of documents are looked up."""
        self.cuts: dict[str, list[int]] = defaultdict(list)
        self.folds = [_folded(w) for w in self.vocab]
        for (w, k), f in zip(self.vocab.items(), self.folds):
            if len(w) >= 3 and not w.isdigit():
                for c in set(_keys(f)):
                    self.cuts[c].append(k)
        self.memo: dict[str, int] = {}
        self.forms: list[tuple[int, tuple[int, ...]]] = [(-1, ())]  # of each code: the equal term, the terms a slip apart
        self.retrieved: list[np.ndarray] = [np.empty(0, np.int32)]

    def code(self, w: str) -> int:
        """Number of a word's form; 0 for words that no item has."""
        k = self.memo.get(w)
        if k is None:
            equal, near = self.vocab.get(w, -1), ()
            if len(w) >= 3 and not w.isdigit():
                f = _folded(w)
                near = tuple(sorted({t for c in _keys(f) for t in self.cuts.get(c, ()) if t != equal and _near(f, self.folds[t])}))
            k = 0
            if equal >= 0 or near:
                k = len(self.forms)
                self.forms.append((equal, near))
                self.retrieved.append(np.array([equal, *near] if equal >= 0 else near, np.int32))
            self.memo[w] = k
        return k

    def codes(self, ws: list[str]) -> np.ndarray:
        if len(self.memo) > _MEMO:
            self.open()
        known, code = self.memo, self.code
        return np.fromiter((known[w] if w in known else code(w) for w in ws), np.int32, len(ws))

    def wand(self, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[int]:
        """Parts of items in ``blocks`` whose normalised BM25 for the query ``terms`` reaches ``threshold``: the lists are
        walked part by part, from pivot to pivot, by the largest impacts within the block."""
        out = []
        for block in blocks.tolist():
            lists = self.post[block]
            # [postings, largest impact, place in the postings]
            heads = [[lists[t], float(self.most[t, block]), 0] for t in terms.tolist() if t in lists]
            while heads:
                heads.sort(key=lambda h: h[0][h[2]][0])
                bound, pivot = 0.0, -1
                for h in heads:
                    bound += h[1]
                    if bound >= threshold:
                        pivot = h[0][h[2]][0]
                        break
                if pivot < 0:
                    break
                score = 0.0
                whole = heads[0][0][heads[0][2]][0] == pivot
                for h in heads:
                    while h[2] < len(h[0]) and h[0][h[2]][0] < pivot:
                        h[2] += 1
                    if whole and h[2] < len(h[0]) and h[0][h[2]][0] == pivot:
                        score += h[0][h[2]][1]
                        h[2] += 1
                if whole and score >= threshold:
                    out.append(pivot)
                heads = [h for h in heads if h[2] < len(h[0])]
        return out

    def _met(self, codes: np.ndarray, wanted: set[int]) -> dict[int, np.ndarray]:
        """For each of the ``wanted`` terms, where ``codes`` has it; a word that is equal to one stands for no other."""
        of: dict[int, list[int]] = defaultdict(list)
        for c in np.unique(codes).tolist():
            equal, near = self.forms[c]
            for t in (equal,) if equal in wanted else near:
                if t in wanted:
                    of[t].append(c)
        return {t: codes == cs[0] if len(cs) == 1 else np.isin(codes, cs) for t, cs in of.items()}

    @staticmethod
    def _in_order(seq: np.ndarray, gain: np.ndarray, met: dict[int, np.ndarray], start: int, stop: int) -> float:
        """The largest gain of terms met in order within a stretch."""
        best = np.zeros(stop - start + 1)
        for t, g in zip(seq.tolist(), gain.tolist()):
            hit = met.get(t)
            if hit is not None:
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(hit[start:stop], best[:-1] + g, 0)))
        return float(best[-1])

    def shares(self, codes: np.ndarray, item: int) -> tuple[float, float, float | None]:
        """(share of the item's words, share of their weight, share of its answer's words) met in order within one
        stretch of ``codes``; the answer may stand next to the stretch, and is None where it proves nothing."""
        seq, weight, answer = self.seq[item], self.weight[item], self.answer[item]
        n, total = len(seq), float(weight.sum()) or 1.0
        span, best, step = int(1.5 * n) + 8, (0.0, 0.0, None), max(1, n // 3)
        met = self._met(codes, set(seq.tolist()))
        some = np.zeros(len(codes) + 1, np.int64)
        if met:
            some[1:] = np.cumsum(np.logical_or.reduce(list(met.values())))
        least = COUNT_BY_ANSWER if len(answer) else COUNT_SHARE
        for start in range(0, max(1, len(codes) - span + step), step):
            stop = min(len(codes), start + span)
            if some[stop] - some[start] < least * n:
                continue
            count = self._in_order(seq, np.ones(n), met, start, stop) / n
            if count < least or count <= best[0]:
                continue
            said = None
            if len(answer):
                low, high = max(0, start - span), min(len(codes), stop + span)
                said = self._in_order(answer, np.ones(len(answer)), self._met(codes[low:high], set(answer.tolist())), 0, high - low) / len(answer)
            best = (count, self._in_order(seq, weight, met, start, stop) / total, said)
        return best

    def leaks(self, texts: list[list[str]]) -> list[tuple[int, int, float, float, float | None]]:
        """(number of the text, item id, word share, weight share, answer share) of the items that ``texts`` carry."""
        out = []
        coded = [self.codes(ws) for ws in texts]
        starts = [(i, s) for i, c in enumerate(coded) for s in range(0, max(1, len(c) - WINDOW + STRIDE), STRIDE)]
        found: dict[tuple[int, int], tuple[float, float, float | None]] = {}
        seen: dict[tuple[int, int], int] = {}  # where an item was verified last
        for first in range(0, len(starts), 1024):
            some = starts[first : first + 1024]
            asked = []
            for i, s in some:
                own = np.unique(coded[i][s : s + WINDOW])
                asked.append(np.unique(np.concatenate([self.retrieved[c] for c in own.tolist()])) if len(own) else self.retrieved[0])
            some, asked = [x for x, a in zip(some, asked) if len(a)], [a for a in asked if len(a)]
            if not asked:
                continue
            # what the blocks can score for each passage: sums of the largest impacts of its terms
            bound = np.add.reduceat(self.most[np.concatenate(asked)], np.cumsum([0, *map(len, asked[:-1])]), axis=0)
            for k in np.nonzero((bound >= RETRIEVE - 1e-6).any(axis=1))[0].tolist():
                i, start = some[k]
                for item in sorted({self.item[p] for p in self.wand(asked[k], np.nonzero(bound[k] >= RETRIEVE - 1e-6)[0], RETRIEVE)}):
                    n = len(self.seq[item])
                    if (i, item) in seen and start < seen[i, item] + n // 3:
                        continue  # the stretch verified there holds what a stretch from here could
                    seen[i, item], around = start, max(WINDOW, 2 * n)
                    near = self.shares(coded[i][max(0, start - around) : start + WINDOW + around], item)
                    found[i, item] = max(found.get((i, item), (0.0, 0.0, None)), near, key=lambda x: x[:2])
        for (i, item), (count, heavy, said) in found.items():
            by_answer = said is not None and said >= ANSWER_SHARE and count >= COUNT_BY_ANSWER and heavy >= WEIGHT_BY_ANSWER
            if count >= COUNT_SHARE and heavy >= WEIGHT_SHARE or by_answer:
                out.append((i, self.ids[item], count, heavy, said))
        return out


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, n, prefix): a running hash of each item's first n words, from ``SHARED_WORDS`` on."""
    for b in batches:
        keys, ns, marks = [], [], []
        for key, ws in zip(b["key"], b["words"]):
            h = 0
            for n, w in enumerate(ws, 1):
                h = int.from_bytes(_digest(f"{h} {w}"), "little", signed=True)
                if n >= SHARED_WORDS:
                    keys.append(key)
                    ns.append(n)
                    marks.append(h)
        yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "n": pd.Series(ns, dtype="int32"), "prefix": pd.Series(marks, dtype="int64")})


def _digest(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def own_words(parsed: DataFrame) -> DataFrame:
    """``parsed`` (key, item_id, words, answer) with the words after the opening that several different items share: it
    reaches as far as most of those who share it agree."""
    texts = parsed.groupBy(F.xxhash64("words").alias("same")).agg(F.min("key").alias("key"))  # copies of one text are one
    long = parsed.join(texts.select("key"), "key").where(F.size("words") > SHARED_WORDS)
    head = F.xxhash64(F.slice("words", 1, SHARED_WORDS))
    heads = long.groupBy(head.alias("head")).agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_BY).select("head")
    shared = long.withColumn("head", head).join(heads, "head", "left_semi").select("key", "words")
    steps = shared.mapInPandas(_prefixes, "key long, n int, prefix long")
    common = steps.groupBy("n", "prefix").agg(F.count("*").alias("by")).where(F.col("by") >= SHARED_BY)
    steps = steps.join(common, ["n", "prefix"]).withColumn("before", F.lag("by").over(Window.partitionBy("key").orderBy("n")))
    stops = (F.col("n") > SHARED_WORDS) & (F.col("by") * 2 < F.col("before"))
    steps = steps.groupBy("key").agg(F.max("n").alias("last"), F.min(F.when(stops, F.col("n") - 1)).alias("stop"))
    cuts = steps.select("key", F.coalesce("stop", "last").alias("cut"))
    same = parsed.select("key", F.xxhash64("words").alias("same")).join(texts.withColumnRenamed("key", "of"), "same").join(cuts.withColumnRenamed("key", "of"), "of")
    rows = parsed.join(same.select("key", "cut"), "key", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return rows.select("key", "item_id", F.slice("words", F.col("cut") + 1, F.greatest(F.lit(0), F.size("words") - F.col("cut"))).alias("words"), "answer")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        said = [words(t) for t in b["answer"]]
        said = [ws if len(ws) > 1 or any(len(w) > 1 for w in ws) else [] for ws in said]
        yield pd.DataFrame({"key": b["key"], "item_id": b["item_id"], "words": [words(t) for t in b["text"]], "answer": said})


def index_blocks(tests: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """(block, data): the pickled index blocks of all items of ``tests`` (item_id, text, answer), and their number."""
    keyed = tests.withColumn("key", F.xxhash64("item_id", "text", "answer")).dropDuplicates(["key"])
    parsed = cut_lineage(keyed.mapInPandas(_parse, "key long, item_id long, words array<string>, answer array<string>"))
    own = cut_lineage(own_words(parsed).where(F.size("words") >= MIN_WORDS), replaces=parsed)
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - PART // 2 - 1), F.lit(PART // 2))
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w) + 1)
    whole = own.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"),
        F.sum(F.size(starts)).alias("parts"), F.sum(F.aggregate(F.transform(starts, lambda k: F.least(F.lit(PART), n - k)), F.lit(0).cast("long"), lambda s, x: s + x)).alias("long"),
    ).first()  # one row
    mean, blocks = (whole.long / whole.parts if whole.parts else 1.0), max(1, math.ceil(whole.chars / block_chars))
    block = F.pmod(F.col("key"), F.lit(blocks)).cast("int").alias("block")
    rows = own.select(block, "item_id", "words", "answer", "key")
    said = rows.select("block", F.explode(F.array_distinct("words")).alias("word"))
    idf = F.log(1 + (whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # one word's frequency in each block first, so a word of all items is few rows
    terms = said.groupBy("word", "block").agg(F.count("*").alias("df"))
    known = terms.groupBy("word").agg(F.sum("df").alias("df"))
    terms = terms.select(F.col("block").alias("at"), "word").join(known, "word").select("at", "word", idf.alias("idf"))

    def build(items: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["item_id", "key"])
        index = ItemIndex(items["item_id"].tolist(), [list(w) for w in items["words"]], [list(w) for w in items["answer"]], dict(zip(stats["word"], stats["idf"])), mean)
        return pd.DataFrame({"block": [int(items["block"].iloc[0])], "data": [pickle.dumps(index)]})

    built = rows.groupBy("block").cogroup(terms.groupBy("at")).applyInPandas(build, "block int, data binary")
    return cut_lineage(built.repartition(blocks, "block") if blocks > 1 else built, replaces=own), blocks


def _reader(built: DataFrame, blocks: int) -> Callable[[], Iterator[ItemIndex]]:
    """What yields the index blocks within a task, one at a time: a single block is sent along, more are read from the
    shared folder for each chunk of documents."""
    if blocks == 1:
        sent = built.sparkSession.sparkContext.broadcast([bytes(r.data) for r in built.collect()])  # one block of bounded size
        kept: list[ItemIndex] = []

        def one() -> Iterator[ItemIndex]:
            if not kept:
                kept.extend(pickle.loads(d) for d in sent.value)
            yield from kept

        return one
    files = sorted(built.inputFiles())

    def each() -> Iterator[ItemIndex]:
        import pyarrow.fs
        import pyarrow.parquet

        for f in files:
            fs, at = pyarrow.fs.FileSystem.from_uri(f)
            for batch in pyarrow.parquet.ParquetFile(fs.open_input_file(at)).iter_batches(1, columns=["data"]):
                for data in batch.column(0):
                    yield pickle.loads(data.as_py())

    return each


_FOUND = "doc_id long, item_id long, word_share double, weight_share double, answer_share double"


def find(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, word_share, weight_share, answer_share) of every document and each item it carries; documents are
    read and cut into words once, whatever the number of items."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    said = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"), said.alias("answer")).where("item_id is not null and text is not null")
    read = _reader(*index_blocks(tests, block_chars))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = (b["text"].map(len).cumsum() // CHUNK_CHARS).to_numpy()
            hits = []
            for chunk in np.unique(at):
                ids = b["doc_id"].to_numpy()[at == chunk]
                texts = [words(t) for t in b["text"][at == chunk]]
                for index in read():
                    hits += [(ids[i], *x) for i, *x in index.leaks(texts)]
            out = pd.DataFrame(hits, columns=["doc_id", "item_id", "word_share", "weight_share", "answer_share"])
            yield out.astype({"doc_id": "int64", "item_id": "int64", "word_share": "float64", "weight_share": "float64", "answer_share": "float64"})

    found = docs.mapInPandas(run, _FOUND)
    answered = F.max(F.when(~F.isnan("answer_share"), F.col("answer_share")))
    return found.groupBy("doc_id", "item_id").agg(F.max("word_share").alias("word_share"), F.max("weight_share").alias("weight_share"), answered.alias("answer_share"))
