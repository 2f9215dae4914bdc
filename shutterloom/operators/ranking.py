"""Ranked channels: fusion, boosts, order, thinning, pins and fallbacks. Every order ends in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel weights by intent, the rank constant, factors for rows found by several channels, boosts.
INTENT_WEIGHTS = {"ocr": (0.62, 0.04, 0.22), "semantic": (0.03, 0.70, 0.18), "mixed": (0.36, 0.34, 0.18), "default": (0.35, 0.36, 0.17)}
CHANNELS = ("ocr", "clip", "shadow")
RANK_CONSTANT = 60
BOOST = {"phrase": 0.22, "tokens": 0.12, "grams": 0.10, "tag": 0.9, "place": 0.08, "person": 0.06, "date": 0.08, "promoted": 0.15}


def weights(intent: str, stored: dict[str, tuple[float, float, float]] | None = None, asked: tuple[float, float, float] | None = None, empty_clip: bool = False) -> dict[str, float]:
    """Weights of the channels: asked ones as they are, else stored, else built-in ones scaled to 1; an empty vector
    channel hands its weight to the shadow channel."""
    if asked is not None:
        w = list(asked)
    else:
        w = list((stored or {}).get(intent) or INTENT_WEIGHTS.get(intent) or INTENT_WEIGHTS["default"])
        w = [x / sum(w) for x in w]
    if empty_clip:
        w[2] += w[1]
        w[1] = 0.0
    return dict(zip(CHANNELS, w))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def channel_rank(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in ``order`` with ``rank`` from 1: a limit first, so that only k rows meet in one task."""
    return top(df, k, *order).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def fuse(channels: dict[str, DataFrame], w: dict[str, float], id_col: str = "id") -> DataFrame:
    """Weighted reciprocal ranks: (id, ocr, clip, shadow, hits, raw, score, reason); channels have (id, rank)."""
    rows = None
    for name, df in channels.items():
        part = df.select(F.col(id_col).alias("id"), F.lit(name).alias("channel"), F.col("rank"), (F.lit(w[name]) / (RANK_CONSTANT + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    by = rows.groupBy("id").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(c) for c in CHANNELS],
        F.countDistinct("channel").alias("hits"),
        *[F.max(F.when(F.col("channel") == c, F.col("part"))).alias(f"_{c}") for c in CHANNELS],
    )
    total = sum((F.coalesce(f"_{c}", F.lit(0.0)) for c in CHANNELS), F.lit(0.0))
    by = by.withColumn("raw", total * F.when(F.col("hits") >= 3, 1.30).when(F.col("hits") == 2, 1.15).otherwise(1.0))
    most = by.agg(F.max("raw").alias("_most"))  # one row
    return by.crossJoin(F.broadcast(most)).select("id", *CHANNELS, "hits", "raw", F.try_divide("raw", "_most").alias("score"), reason().alias("reason"))


def reason() -> Column:
    """Which channels a row is credited to."""
    ocr, clip = F.col("ocr").isNotNull(), F.col("clip").isNotNull()
    return F.when(ocr & clip, "ocr+clip").when(clip & F.col("shadow").isNotNull(), "clip+shadow").when(ocr, "ocr").when(clip, "clip").otherwise("shadow")


def overlap(fused: DataFrame) -> DataFrame:
    """How many rows each combination of channels found."""
    return fused.groupBy(*[F.col(c).isNotNull().alias(f"in_{c}") for c in CHANNELS]).agg(F.count("*").alias("rows"))


def boosted(score: Column, *bonuses: Column) -> Column:
    """All bonuses are positive, so one cap at 1 equals a cap after each."""
    return F.least(F.lit(1.0), sum((F.coalesce(b, F.lit(0.0)) for b in bonuses), score))


def explained(df: DataFrame, bonuses: dict[str, Column]) -> DataFrame:
    """``df`` with its score boosted, and ``parts``: each stage that changed the score and by how much."""
    pairs = [F.struct(F.lit("channels").alias("stage"), F.round("score", 9).alias("delta"))]
    pairs += [F.struct(F.lit(n).alias("stage"), F.coalesce(b.cast("double"), F.lit(0.0)).alias("delta")) for n, b in bonuses.items()]
    parts = F.filter(F.array(*pairs), lambda p: p["delta"] != 0)
    return df.withColumns({"parts": parts, "score": boosted(F.col("score"), *bonuses.values())})


def day_cap(df: DataFrame, ts: str, order: list[Column], keep: int = 5) -> DataFrame:
    """At most ``keep`` rows of a calendar day, in ``order``; rows without a time all stay."""
    w = Window.partitionBy(F.to_date(ts)).orderBy(*order)
    timed = df.where(F.col(ts).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
    return timed.unionByName(df.where(F.col(ts).isNull()))


def burst(df: DataFrame, ts: str, score: str, pos: str, seconds: int = 3) -> DataFrame:
    """Of rows in one fixed stretch of time the best-scored stays, in the first place of the stretch; rows without a
    time all stay."""
    cell = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    best = Window.partitionBy("_cell").orderBy(F.desc(score), pos)
    whole = Window.partitionBy("_cell")
    timed = df.where(F.col(ts).isNotNull()).withColumn("_cell", cell).withColumn("_n", F.row_number().over(best)).withColumn("_first", F.min(pos).over(whole))
    kept = timed.where("_n = 1").withColumn(pos, F.col("_first")).drop("_cell", "_n", "_first")
    return kept.unionByName(df.where(F.col(ts).isNull()))


def pin(df: DataFrame, pinned: DataFrame, id_col: str, pos: str) -> DataFrame:
    """Rows named in ``pinned`` go to the front, otherwise the order stays."""
    front = pinned.select(F.col(id_col).alias("_p")).distinct()
    return df.join(front, F.col(id_col) == F.col("_p"), "left").withColumn("pinned", F.col("_p").isNotNull()).drop("_p").orderBy(F.desc("pinned"), pos, id_col)


def cascade(rungs: list[DataFrame], id_col: str = "id") -> DataFrame:
    """The rows of the first rung that has any, decided in one plan: the smallest rung number over all rows."""
    rows = None
    for n, df in enumerate(rungs):
        part = df.withColumn("rung", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.agg(F.min("rung").alias("_first"))
    return rows.join(F.broadcast(first), F.col("rung") == F.col("_first")).drop("_first")
