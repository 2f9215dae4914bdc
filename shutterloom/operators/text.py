"""Full-text retrieval: BM25 over texts or a stored index, character bigrams, substring kinds, fuzzy correction."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.functions.predicates import bigrams, contains_ci

K1, B = 1.2, 0.75


def read_words(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep`` and ``_words``, the tokens of a text; a null text has none but counts as a row. A generator gives them, so
    that filters on what is counted in them do not read the text again."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([0-9a-z가-힣_]+)"), 1)
    return docs.select(*keep, F.explode(F.array(words)).alias("_words"))


def term_counts(query: tuple[str, ...] | list[str]) -> list[Column]:
    """len, tf0, tf1, ...: the tokens of a text and how often it has each of the query's, over ``read_words``."""
    w = F.col("_words")
    return [F.size(w).alias("len"), *[(F.size(w) - F.size(F.array_remove(w, q))).alias(f"tf{i}") for i, q in enumerate(query)]]


def statistics(docs: DataFrame, text_col: str, query: tuple[str, ...] | list[str]) -> tuple[int, float, list[int]]:
    """(rows, mean length, rows with each token): one row of numbers."""
    found = read_words(docs, text_col).select(*term_counts(query)).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))]).first()
    return found.n, found.mean or 1.0, [found[f"df{i}"] for i in range(len(query))]


def score_of(query: tuple[str, ...] | list[str], stats: tuple[int, float, list[int]]) -> Column:
    """BM25 over the columns of ``term_counts``, more negative is better; null without any token."""
    n, mean, df = stats
    score, some = F.lit(0.0), F.lit(0)
    for i in range(len(query)):
        idf = max(math.log((n - df[i] + 0.5) / (df[i] + 0.5)), 1e-6)
        tf = F.col(f"tf{i}").cast("double")
        score = score - F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(mean))))
        some = some + F.col(f"tf{i}")
    return F.when(some > 0, score)


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str]) -> DataFrame:
    """(id, score), more negative is better: documents with any query token."""
    asked = sorted(set(query))
    parts = read_words(docs, text_col, F.col(id_col).alias("id")).select("id", *term_counts(asked))
    return parts.select("id", score_of(asked, statistics(docs, text_col, asked)).alias("score")).where("score is not null")


class TextIndex:
    """Postings kept as files, parted by a hash of the term: a query opens only the parts of its own terms."""

    PARTS = 64

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rebuild(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Write the index of all texts anew: one row for each term of each document, with the document's length, and one
        row of statistics."""
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([0-9a-z가-힣_]+)"), 1)
        rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).withColumn("len", F.size("w"))
        rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.mode("overwrite").parquet(self.path + "/statistics")
        # the terms of one text are counted in the text, so nothing is shuffled but the postings themselves
        terms = rows.select("id", "len", F.explode(F.array_distinct("w")).alias("term"), "w").select("id", "len", "term", (F.size("w") - F.size(F.array_remove("w", F.col("term")))).alias("tf"))
        part = F.pmod(F.xxhash64("term"), F.lit(self.PARTS)).cast("int")
        spread = terms.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("id"), F.lit(8)))  # a frequent term is eight tasks
        spread.sortWithinPartitions("part", "term", "id").write.mode("overwrite").partitionBy("part").parquet(self.path + "/postings")

    def postings(self, query: tuple[str, ...] | list[str] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path + "/postings")
        if query is None:
            return rows
        asked = sorted(set(query))
        parts = self.spark.createDataFrame([(t,) for t in asked], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.PARTS)).cast("int").alias("p")).collect()
        return rows.where(F.col("part").isin(sorted({r.p for r in parts})) & F.col("term").isin(asked))

    def bm25(self, query: tuple[str, ...] | list[str]) -> DataFrame:
        """(id, score) of the documents with any query token, from the postings of these alone."""
        stats = self.spark.read.parquet(self.path + "/statistics").first()
        rows = self.postings(query)
        df = {r.term: r.n for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a query token
        idf = F.lit(0.0)
        for t, n in sorted(df.items()):
            idf = F.when(F.col("term") == t, F.lit(max(math.log((stats.n - n + 0.5) / (n + 0.5)), 1e-6))).otherwise(idf)
        tf = F.col("tf").cast("double")
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(stats.mean or 1.0))))
        return rows.groupBy("id").agg((-F.sum(part)).alias("score"))


def best_of(*scored: DataFrame) -> DataFrame:
    """(id, score): the smallest score of each id over several indexes, such as one of words and one of letter groups."""
    rows = None
    for df in scored:
        rows = df.select("id", "score") if rows is None else rows.unionByName(df.select("id", "score"))
    return rows.groupBy("id").agg(F.min("score").alias("score"))


def match_kind(text: Column, query: str) -> Column:
    """phrase, word or null: how a text holds the query itself, or all of its tokens."""
    words = [w.lower() for w in query.split()]
    every = F.lit(True)
    for w in words:
        every = every & contains_ci(text, w)
    return F.when(contains_ci(text, query), "phrase" if " " in query.strip() else "word").when(every, "word")


def gram_hits(col: Column, query: str, kept: str = "가-힣") -> Column:
    """How many different bigrams of the query a text holds."""
    bare = re.sub(f"[^{kept}]", "", query)
    grams = sorted({bare[i : i + 2] for i in range(len(bare) - 1)})
    if not grams:
        return F.lit(0).cast("long")
    return F.coalesce(F.size(F.array_intersect(bigrams(col, kept), F.array(*[F.lit(g) for g in grams]))), F.lit(0)).cast("long")


def gram_overlap(docs: DataFrame, id_col: str, text_col: str, query: str, kept: str = "가-힣") -> DataFrame:
    """(id, hits): how many different bigrams of the query a text holds."""
    return docs.select(F.col(id_col).alias("id"), gram_hits(F.col(text_col), query, kept).alias("hits")).where("hits > 0")


def nearest_tag(tags: DataFrame, tag_col: str, term: str, least: float = 0.5) -> DataFrame:
    """(tag, similarity) of the tag most like ``term`` by bigram Jaccard; ties go to the first in order."""
    n = len(term)
    grams = sorted({term[i : i + 2] for i in range(n - 1)})
    wanted = F.array(*[F.lit(g) for g in grams]).cast("array<string>")
    bound = max(1, n - 1) if n <= 3 else max(2, n)
    rows = tags.select(F.col(tag_col).alias("tag")).where("tag is not null").distinct().where(F.abs(F.length("tag") - n) <= bound)
    own = F.array_distinct(F.when(F.length("tag") >= 2, F.transform(F.sequence(F.lit(1), F.length("tag") - 1), lambda i: F.substring("tag", i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("tag", F.try_divide(F.size(F.array_intersect(own, wanted)), F.size(F.array_union(own, wanted))).alias("similarity"))
    return rows.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "tag").limit(1)
