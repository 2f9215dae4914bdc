"""Incremental sync and event analytics as Structured Streaming programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shutterloom.operators import catalog


def event_windows(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, events, total) in tumbling windows; with ``late``, a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def event_sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, events): stretches of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


_STATE = "path string, size long, mtime_ns long, status string, stable_after timestamp_ntz"


class ObservationSync:
    """Observations arrive as files; each micro-batch moves the table of observations on by the stability rule.

    The table is parted by a hash of the path, and a batch writes a new version of the parts that it touches alone. A list of
    the current version of every part is written last, under the number of the micro-batch: a batch that is repeated after a
    failure gives the same table, and files that only the list before the last one names are deleted.
    """

    def __init__(self, spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, window_s: int = 300, parts: int = 64) -> None:
        self.spark, self.source, self.schema, self.table, self.checkpoint, self.window_s, self.parts = spark, source, schema, table, checkpoint, window_s, parts

    def state(self) -> DataFrame:
        return self._read(self._current(None))

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def _lists(self) -> list[int]:
        fs, at = self._fs(f"{self.table}/lists")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[2:]) for n in names if n.startswith("n=") and fs.exists(self._fs(f"{self.table}/lists/{n}/_SUCCESS")[1]))

    def _current(self, before: int | None) -> dict[int, int]:
        """Part to version, by the latest list, or the latest before a micro-batch."""
        known = [n for n in self._lists() if before is None or n < before]
        if not known:
            return {}
        return {r.part: r.version for r in self.spark.read.schema("part int, version long").parquet(f"{self.table}/lists/n={known[-1]}").collect()}  # a row a part

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.table}/data/v={v}/part={p}" for p, v in sorted(versions.items())]
        return self.spark.read.schema(_STATE).parquet(*paths) if paths else self.spark.createDataFrame([], _STATE)

    def _apply(self, batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")
        batch = batch.where("path is not null")
        now = batch.agg(F.max("seen_at")).first()[0]
        if now is None:  # nothing says when it was seen, so nothing can be judged
            return
        touched = sorted(r.p for r in batch.select(part.alias("p")).distinct().collect())  # at most one row a part
        versions = self._current(number)
        old = self._read({p: v for p, v in versions.items() if p in touched})
        seen = batch.groupBy("path").agg(F.max(F.struct("seen_at", "size", "mtime_ns")).alias("s")).select("path", "s.size", "s.mtime_ns", "s.seen_at")
        judged = catalog.stability(seen.select("path", "size", "mtime_ns"), old, F.lit(now).cast("timestamp_ntz"), self.window_s)
        new = catalog.keyed_upsert(old, judged, ["path"]).withColumn("part", part)
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.table}/data/v={number}")
        after = versions | {p: number for p in touched}
        self.spark.createDataFrame(sorted(after.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.table}/lists/n={number}")
        # what only the list before the last one names; a repeated batch still finds the last one whole
        for p, v in (self._current(max((n for n in self._lists() if n < number), default=number))).items():
            if v not in (versions.get(p), after[p]):
                fs, at = self._fs(f"{self.table}/data/v={v}/part={p}")
                fs.delete(at, True)

    def start(self) -> StreamingQuery:
        """Work through what has arrived, then stop; call again for what comes later."""
        rows = self.spark.readStream.schema(self.schema).parquet(self.source)
        return rows.writeStream.foreachBatch(self._apply).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
