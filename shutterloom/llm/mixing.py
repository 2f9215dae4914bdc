"""Mixing sources to target weights as a curriculum that changes over time.

Sizes are tokens of a public tokenizer. Each source of a mix has a weight schedule over training time t in [0, 1],
w(t) = w (1 + c (2t - 1)): its integral is the target share w, and the tilts c are set so that the schedules add up to 1
at every moment. The integral up to t, times the budget, is the source's cumulative token demand. A copy of a document
that stands x tokens into its source's stream is needed when that demand reaches x, so the inverse of the integral is
its training position; documents are then range-sorted by mix and position.

The budget is the largest one at which every source with documents meets its share within its repeats, and no more than
the mix's sources hold once; with ``total_tokens`` it is what the caller asks, or with ``HELD`` all that the sources of
each mix hold, and what capped sources cannot give goes to the others in proportion.

Cumulative sizes within a source are two-level prefix sums (within hash ranges of bounded size, and over the ranges'
sums), so a source of a third of all rows is many tasks.

Defined results: source names are compared without case, surrounding blanks and the difference of blank, ``_`` and ``-``;
null or blank sources and null texts are in no mix; empty texts have no tokens and are not selected; rows of one source
in a mix add their weights and keep their smallest cap; weights that are null, negative or not finite count as 0; caps
below 1 give nothing; sources without documents are reported with an actual share of 0 and their weight goes to the
others; every row of a repeated document counts by itself; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.session import cut_lineage

VOCABULARY = os.environ.get("SHUTTERLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The vocabulary's published split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows aimed at in one hash range of a source.
RANGE_ROWS = 20_000
#: The strongest tilt of a schedule.
TILT = 0.5
#: As a budget: in each mix the tokens that its weighted sources hold once.
HELD = "held"


def source_key(col: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace(col, r"\s+", " "))), r"[\s_-]+", "-")
    return F.nullif(key, F.lit(""))


def with_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY, size_col: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of documents with a source and a text; ``size_col`` names a column of sizes to take for the
    tokens. The vocabulary file is read here and sent to the workers."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"), *([F.col(size_col).cast("long").alias("tokens")] if size_col else []))
    rows = rows.where("source is not null and text is not null")
    if size_col:
        return rows.select("doc_id", "source", "tokens")
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(coder.encode_ordinary(t)) for t in b["text"]]})

    return rows.mapInPandas(count, "doc_id long, source string, tokens long")


def clean_targets(targets: DataFrame) -> DataFrame:
    """(mix_name, source, weight, cap) with weights adding up to 1 in each mix; cap null: none."""
    weight = F.col("target_weight").cast("double")
    rows = targets.select(
        "mix_name",
        source_key(F.col("source")).alias("source"),
        F.when((weight > 0) & (weight < float("inf")), weight).otherwise(0.0).alias("weight"),
        F.col("max_repeats").cast("long").alias("cap"),
    ).where("mix_name is not null and source is not null")
    rows = rows.groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.min("cap").alias("cap"))
    return rows.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("mix_name"))))


def plan(targets: DataFrame, held: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """(mix_name, source, target, cap, tokens, docs, share, demand, tilt): what each source of each mix shall give.

    ``held`` has (source, tokens, docs) for the sources; both are small tables, one row for each source.
    """
    mix = Window.partitionBy("mix_name")
    rows = clean_targets(targets).join(held, "source", "left").select("mix_name", "source", F.coalesce("weight", F.lit(0.0)).alias("target"), "cap", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
    rows = rows.withColumn("room", F.when((F.col("tokens") == 0) | (F.col("cap") < 1), 0.0).when(F.col("cap").isNull(), float("inf")).otherwise(F.col("cap") * F.col("tokens")))
    rows = rows.withColumn("live", F.when(F.col("room") > 0, F.col("target")).otherwise(0.0))
    rows = rows.withColumn("share", F.coalesce(F.try_divide("live", F.sum("live").over(mix)), F.lit(0.0)))
    once = F.sum(F.when(F.col("share") > 0, F.col("tokens"))).over(mix)
    if total_tokens is None:
        most = F.min(F.when(F.col("share") > 0, F.col("room") / F.col("share"))).over(mix)
        rows = rows.withColumn("demand", F.col("share") * F.coalesce(F.least(most, once.cast("double")), F.lit(0.0)))
    else:
        # sources fill up in the order of room / share; the level that spends the budget lies between two of them
        order = Window.partitionBy("mix_name").orderBy("fills", "source")
        rows = rows.withColumn("fills", F.when(F.col("share") > 0, F.col("room") / F.col("share")).otherwise(0.0))
        before = F.coalesce(F.sum(F.when((F.col("share") > 0) & (F.col("room") < float("inf")), F.col("room")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn("budget", once.cast("double") if total_tokens == HELD else F.lit(float(total_tokens)))
        rows = rows.withColumn("level", F.when(left > 0, (F.col("budget") - before) / left))
        # the first source whose own filling point is not reached fixes the level for all after it
        rows = rows.withColumn("fixed", F.min(F.when((F.col("share") > 0) & (F.col("fills") >= F.col("level")), F.struct("fills", "level"))).over(mix))
        rows = rows.withColumn("demand", F.when(F.col("share") > 0, F.least("room", F.col("share") * F.coalesce(F.col("fixed.level"), F.lit(float("inf"))))).otherwise(0.0))
    real = F.coalesce(F.try_divide("demand", F.sum("demand").over(mix)), F.lit(0.0))
    # sources of longer documents come later: tilts are proportional to the distance from the mix's mean
    rows = rows.withColumn("real", real).withColumn("len", F.coalesce(F.log1p(F.try_divide("tokens", "docs")), F.lit(0.0)))
    rows = rows.withColumn("off", F.when(F.col("real") > 0, F.col("len") - F.sum(F.col("real") * F.col("len")).over(mix)).otherwise(0.0))
    rows = rows.withColumn("tilt", F.coalesce(TILT * F.try_divide("off", F.max(F.abs("off")).over(mix)), F.lit(0.0)))
    return rows.select("mix_name", "source", "target", "cap", "tokens", "docs", F.col("real").alias("share"), "demand", "tilt")


def schedule_inverse(done: Column, tilt: Column) -> Column:
    """The time t at which t + c (t^2 - t), the integral of the schedule, reaches the share ``done`` of a source."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * done)
    return 2 * done / ((1 - tilt) + root)


def _streams(sized: DataFrame, held: DataFrame) -> DataFrame:
    """``sized`` with ``upto``, the tokens of its source before it, in an order by hash."""
    # a repeated row of one document has equal hashes; the order of equal rows does not matter, as they are equal
    part = sized.join(held.select("source", F.ceil(F.col("docs") / RANGE_ROWS).alias("ranges")), "source")
    unit = F.conv(F.substring(F.md5(F.concat_ws(" ", "doc_id", "source")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    part = part.withColumn("unit", unit).withColumn("range", F.floor(F.col("unit") * F.col("ranges")))
    sums = part.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("unit", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return part.join(sums, ["source", "range"]).select("doc_id", "source", "tokens", (F.col("base") + F.col("inner")).alias("upto"))


def _prepared(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None, vocabulary: str, size_col: str | None) -> tuple[DataFrame, DataFrame]:
    wanted = clean_targets(targets).select("source").distinct()
    keyed = documents.select("doc_id", "text", "source", *([size_col] if size_col else []), source_key(F.col("source")).alias("_key"))
    keyed = keyed.join(wanted.withColumnRenamed("source", "_key"), "_key", "left_semi")
    sized = cut_lineage(with_tokens(keyed, vocabulary=vocabulary, size_col=size_col).where("tokens > 0"))
    held = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    held = cut_lineage(held)
    return _streams(sized, held), cut_lineage(plan(targets, held, total_tokens))


def _select(streams: DataFrame, planned: DataFrame) -> DataFrame:
    asked = planned.where("demand > 0").select("mix_name", "source", "demand", "tilt", F.col("tokens").alias("whole"))
    rows = streams.join(asked, "source")
    middle = F.col("upto") + F.col("tokens") / 2
    copies = F.ceil((F.col("demand") - middle) / F.col("whole")).cast("int")
    rows = rows.where(middle < F.col("demand")).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    done = F.least(F.lit(1.0), ((F.col("copy") - 1) * F.col("whole") + F.col("upto") + F.col("tokens") / 2) / F.col("demand"))
    return rows.select("mix_name", schedule_inverse(done, F.col("tilt")).alias("position"), "source", "doc_id", "copy", "tokens")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, vocabulary: str = VOCABULARY, size_col: str | None = None) -> DataFrame:
    """(mix_name, position, source, doc_id, copy, tokens): the selected copies, range-sorted by mix and position."""
    streams, planned = _prepared(documents, targets, total_tokens, vocabulary, size_col)
    chosen = _select(streams, planned)
    return chosen.repartitionByRange("mix_name", "position").sortWithinPartitions("mix_name", "position", "source", "doc_id", "copy")


def report(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, vocabulary: str = VOCABULARY, size_col: str | None = None) -> DataFrame:
    """One row for each source of each mix: target and actual share, tokens held and selected, documents, repeats."""
    streams, planned = _prepared(documents, targets, total_tokens, vocabulary, size_col)
    got = _select(streams, planned).groupBy("mix_name", "source").agg(F.sum("tokens").alias("selected_tokens"), F.count("*").alias("selected_docs"), F.max("copy").alias("most_repeats"))
    every = Window.partitionBy("mix_name")
    return planned.join(got, ["mix_name", "source"], "left").select(
        "mix_name",
        "source",
        F.round("target", 6).alias("target_share"),
        F.round(F.coalesce(F.try_divide("selected_tokens", F.sum("selected_tokens").over(every)), F.lit(0.0)), 6).alias("actual_share"),
        F.col("tokens").alias("held_tokens"),
        F.col("docs").alias("held_docs"),
        F.coalesce("selected_tokens", F.lit(0)).alias("selected_tokens"),
        F.coalesce("selected_docs", F.lit(0)).alias("selected_docs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.col("cap").alias("max_repeats"),
    )
