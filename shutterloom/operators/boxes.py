"""Matching of old and new regions of a file by overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes (x, y, width, height) given by column prefixes; 0 where they do not meet."""
    right = lambda p: F.col(f"{p}x") + F.col(f"{p}width")
    low = lambda p: F.col(f"{p}y") + F.col(f"{p}height")
    w = F.least(right(a), right(b)) - F.greatest(F.col(f"{a}x"), F.col(f"{b}x"))
    h = F.least(low(a), low(b)) - F.greatest(F.col(f"{a}y"), F.col(f"{b}y"))
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = F.col(f"{a}width") * F.col(f"{a}height") + F.col(f"{b}width") * F.col(f"{b}height") - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def greedy_match(old: DataFrame, new: DataFrame, file_col: str = "file_id", least: float = 0.5) -> DataFrame:
    """(file_id, old_id, new_id, overlap): one to one within a file, the best overlap first; ties by ids.

    Only overlapping pairs are formed; the greedy choice itself is sequential within one file's regions.
    """
    o = old.select(file_col, *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "width", "height")])
    n = new.select(file_col, *[F.col(c).alias(f"n_{c}") for c in ("id", "x", "y", "width", "height")])
    pairs = o.join(n, file_col).withColumn("overlap", iou("o_", "n_")).where(F.col("overlap") >= least).select(file_col, F.col("o_id").alias("old_id"), F.col("n_id").alias("new_id"), "overlap")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, took_old, took_new = None, set(), set()
        for b in batches:
            keep = []
            for f, o, n in zip(b[file_col], b["old_id"], b["new_id"]):
                if f != file:
                    file, took_old, took_new = f, set(), set()
                keep.append(o not in took_old and n not in took_new)
                if keep[-1]:
                    took_old.add(o)
                    took_new.add(n)
            yield b[keep]

    # the files of a partition stand one after another, best overlaps first, so one pass decides them all
    ordered = pairs.repartition(file_col).sortWithinPartitions(file_col, F.desc("overlap"), "old_id", "new_id")
    return ordered.mapInPandas(choose, pairs.schema)
