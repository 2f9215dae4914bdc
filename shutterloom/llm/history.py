"""New records against all accepted history, by a table of distances to fixed pivots.

A digest is brought to one notation (lower-case hexadecimal) whatever it was written in. Its first 64 bits, read as
four 16-bit numbers, are a point under the Manhattan metric. The pivot table stores each point's distances to three
fixed pivots. By the triangle inequality two points at most r apart have pivot distances at most r apart, so candidates
come from joins on ranges of these distances (of width 1 when r is 0); the true distance and, for digests, agreement
over the whole length written by both, are then verified. The table is kept as files parted by kind and by ranges of the
first pivot distance: a batch reads the ranges that its own records can reach, and accepting it means appending its
rows. The history is encoded once, when it is accepted.

Defined results: digests that are null, blank, placeholders (words, one repeated character) or shorter than 16
hexadecimal digits denote nothing; sizes that are null or not positive match nothing; repeated rows and repeated
deliveries count once; records without batch or id have no place in the order and are no case; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.session import cut_lineage, remove, shared_folder

PIVOTS = 3
MIN_DIGITS = 16
#: Ranges of the first pivot distance, which is 262,140 at most, by which the store's files are parted.
BANDS = 32
BAND_WIDTH = -(-4 * 65_536 // BANDS)


def digest_hex(col: Column) -> Column:
    """Lower-case hexadecimal digits of a digest in any notation; null for what denotes no digest."""
    bare = F.regexp_replace(col, r"\s+", "")
    bare = F.regexp_replace(bare, r"^(?i:(?:sha|md|blake)[-_]?[0-9a-z]{1,4}[:=])", "")
    bare = F.regexp_replace(bare, r"^0x([0-9a-fA-F]+)$", "$1")
    plain = F.lower(F.regexp_replace(bare, "[:-]", ""))
    coded = F.lower(F.hex(F.try_to_binary(F.concat(F.rpad(F.translate(bare, "-_", "+/"), 43, "="), F.lit("=")), F.lit("base64"))))
    hexed = F.regexp_extract(plain, f"^[0-9a-f]{{{MIN_DIGITS},}}$", 0)
    found = F.when(hexed != "", hexed).otherwise(F.when(bare.rlike("^[A-Za-z0-9+/_-]{43}=?$"), coded))
    return F.nullif(F.regexp_extract(found, r"^(?!(.)\1*$).*$", 0), F.lit(""))


def pivot_points() -> list[list[int]]:
    """The fixed pivots: four 16-bit numbers each, from a hash of their number."""
    heads = [hashlib.sha256(f"pivot {i}".encode()).hexdigest()[:16] for i in range(PIVOTS)]
    return [[int(h[4 * k : 4 * k + 4], 16) for k in range(4)] for h in heads]


def with_pivots(df: DataFrame, digest: str = "digest") -> DataFrame:
    """``df`` with the pivot distances d0, d1, d2 of its digests and the point itself as w0..w3."""
    words = [F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("int").alias(f"w{k}") for k in range(4)]
    df = df.select("*", *words)
    dist = [sum((F.abs(F.col(f"w{k}") - F.lit(p[k])) for k in range(4)), F.lit(0)).alias(f"d{i}") for i, p in enumerate(pivot_points())]
    return df.select("*", *dist)


def agree(a: Column, b: Column) -> Column:
    """Two digests agree over the length that both are written at."""
    return a.startswith(b) | b.startswith(a)


def candidates(probe: DataFrame, table: DataFrame, same: list[str], radius: int = 0, how: str = "inner", verify: bool = True) -> DataFrame:
    """Rows of ``probe`` joined with rows of ``table`` whose points are at most ``radius`` apart.

    Columns of ``table`` come with the prefix ``h_``. ``same`` names columns that must be equal. The join keys are the
    ranges of two pivot distances; with radius 0 the ranges of all pivots are single values and all are keys.
    """
    held = table.select(*[F.col(c).alias(f"h_{c}") for c in table.columns])
    on = [F.col(c) == F.col(f"h_{c}") for c in same]
    if radius == 0:
        on += [F.col(f"d{i}") == F.col(f"h_d{i}") for i in range(PIVOTS)]
    else:
        width = 2 * radius + 1
        for i in range(2):
            low, high = F.floor((F.col(f"d{i}") - radius) / width), F.floor((F.col(f"d{i}") + radius) / width)
            probe = probe.withColumn(f"_range{i}", F.explode(F.array_distinct(F.array(low, high))))
            held = held.withColumn(f"h_range{i}", F.floor(F.col(f"h_d{i}") / width))
            on += [F.col(f"_range{i}") == F.col(f"h_range{i}")]
        on += [F.abs(F.col(f"d{i}") - F.col(f"h_d{i}")) <= radius for i in range(PIVOTS)]
    on.append(sum((F.abs(F.col(f"w{k}") - F.col(f"h_w{k}")) for k in range(4)), F.lit(0)) <= radius)
    if verify:
        on.append(agree(F.col("digest"), F.col("h_digest")))
    out = probe.join(held, functools.reduce(operator.and_, on), how)
    return out.drop("_range0", "_range1", "h_range0", "h_range1") if radius else out


def digest_rows(rows: DataFrame, *keep: Column) -> DataFrame:
    """Two rows for each record, (kind, digest, size) with ``keep``: its content digest, and its partial digest with the
    size; only records of a positive size."""
    kinds = F.array(  # computed before the explode, which the optimizer does not merge expressions across
        F.struct(F.lit("content").alias("kind"), digest_hex(F.col("content_hash")).alias("digest"), F.lit(0).cast("long").alias("size")),
        F.struct(F.lit("partial").alias("kind"), digest_hex(F.col("partial_hash")).alias("digest"), F.col("size_bytes").cast("long").alias("size")),
    )
    return rows.where(F.col("size_bytes") > 0).select(*keep, F.inline(kinds)).where("digest is not null")


def history_table(rows: DataFrame) -> DataFrame:
    """The pivot table of accepted records: one row for each distinct (kind, digest, size), with its distances."""
    return with_pivots(digest_rows(rows).distinct())


_STORED = "digest string, size long, w0 int, w1 int, w2 int, w3 int, d0 int, d1 int, d2 int, kind string, band int"


class PivotStore:
    """The pivot table kept as files, parted by kind and range of the first pivot distance, to which batches only append."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """Encode the records of an accepted batch and add them."""
        table = history_table(rows).withColumn("band", F.floor(F.col("d0") / BAND_WIDTH).cast("int"))
        table.repartition("kind", "band").sortWithinPartitions("kind", "band", "d0").write.mode("append").partitionBy("kind", "band").parquet(self.path)

    def read(self, asked: DataFrame, radius: int = 0) -> DataFrame:
        """The store's rows in the ranges that ``asked`` (kind, d0) can reach: partitions that no record of the batch
        reaches are not opened."""
        held = self.spark.read.schema(_STORED).parquet(self.path)
        low, high = F.floor((F.col("d0") - radius) / BAND_WIDTH), F.floor((F.col("d0") + radius) / BAND_WIDTH)
        reach = asked.select("kind", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("band")).distinct()
        bands: dict[str, list[int]] = {}
        for r in reach.collect():  # at most two kinds of ``BANDS`` ranges
            bands.setdefault(r.kind, []).append(r.band)
        hit = [(F.col("kind") == k) & F.col("band").isin(sorted(b)) for k, b in sorted(bands.items())]
        return held.where(functools.reduce(operator.or_, hit, F.lit(False))).drop("band")

    def repeated(self, batch: DataFrame, order: list[str], radius: int = 0) -> DataFrame:
        """Distinct ``order`` values of the rows in ``batch`` that repeat a record of the store, or a row of the batch with
        smaller ``order`` values, found or not. With a radius, points that near count, whatever their later digits.

        Every distinct digest is first reduced to its earliest record, so a digest that a third of all rows carry is one
        row when it is matched.
        """
        ord_ = F.struct(*order)
        asked = digest_rows(batch, ord_.alias("ord"))
        first = with_pivots(asked.groupBy("kind", "digest", "size").agg(F.min("ord").alias("first")))
        verify = radius == 0
        old = candidates(first, self.read(first, radius), ["kind", "size"], radius, "left_semi", verify).select("kind", "digest", "size", F.lit(True).alias("old"), F.lit(None).cast(first.schema["first"].dataType).alias("earliest"))
        new = candidates(first, first, ["kind", "size"], radius, verify=verify).select("kind", "digest", "size", F.lit(False).alias("old"), F.col("h_first").alias("earliest"))
        known = old.unionByName(new).groupBy("kind", "digest", "size").agg(F.max("old").alias("old"), F.min("earliest").alias("earliest"))
        hit = asked.join(known, ["kind", "digest", "size"]).where(F.col("old") | (F.col("earliest") < F.col("ord")))
        return hit.select("ord.*").distinct()


def temporary_store(spark: SparkSession, history: DataFrame) -> PivotStore:
    """A store of ``history`` in the shared folder; ``remove`` takes its path away."""
    store = PivotStore(spark, f"{shared_folder(spark)}/shutterloom/pivots-{uuid.uuid4().hex}")
    store.append(history)
    return store


def _placed(incoming: DataFrame) -> DataFrame:
    rows = incoming.where("batch_no is not null and incoming_id is not null")
    return rows.withColumn("batch_no", F.col("batch_no").cast("int")).withColumn("incoming_id", F.col("incoming_id").cast("long"))


def repeats(incoming: DataFrame, history: DataFrame, radius: int = 0) -> DataFrame:
    """(batch_no, incoming_id) of the incoming rows that repeat a row of ``history`` or an incoming row with a smaller
    (batch_no, incoming_id), found or not: all waiting batches at once, against a store of the history."""
    store = temporary_store(incoming.sparkSession, history)
    found = cut_lineage(store.repeated(_placed(incoming), ["batch_no", "incoming_id"], radius))
    remove(incoming.sparkSession, store.path)
    return found


def accept(incoming: DataFrame, store: PivotStore) -> DataFrame:
    """(batch_no, incoming_id) of the rows of each batch that repeat the store or an earlier row; batches are worked and
    appended in their order, and only the ranges a batch reaches are read."""
    rows = _placed(incoming)
    batches = sorted(r.batch_no for r in rows.select("batch_no").distinct().collect())  # the batches that wait
    found = None
    for n in batches:
        batch = rows.where(F.col("batch_no") == n)
        part = cut_lineage(store.repeated(batch, ["batch_no", "incoming_id"]))
        store.append(batch)
        found = part if found is None else found.unionByName(part)
    return rows.select("batch_no", "incoming_id").limit(0) if found is None else found
