"""Catalogue operators: tag sets, upserts, missing files, stability, work lists, search documents, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters by other tables -------------------------------------------------------------------------------------

def having(df: DataFrame, other: DataFrame, on: str | list[str], wanted: bool = True) -> DataFrame:
    """Rows with (or without) a partner; never repeats a row."""
    return df.join(other.select(on if isinstance(on, list) else [on]), on, "left_semi" if wanted else "left_anti")


def with_tag(df: DataFrame, tags: DataFrame, value: str, types: tuple[str, ...] | None = None, exact: bool = True) -> DataFrame:
    hit = tags.where(F.col("tag_value") == value) if exact else tags.where(F.lower("tag_value") == value.lower())
    if types:
        hit = hit.where(F.col("tag_type").isin(*types))
    return having(df, hit, "file_id")


def count_range(df: DataFrame, parts: DataFrame, on: str, low: int | None = None, high: int | None = None, name: str = "parts") -> DataFrame:
    """Rows with between ``low`` and ``high`` partners; none counts as 0."""
    counts = parts.groupBy(on).agg(F.count("*").alias(name))
    out = df.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.where((F.col(name) >= (low or 0)) & (F.lit(True) if high is None else F.col(name) <= high))


# --- tags --------------------------------------------------------------------------------------------------------

def clean_tags(tags: DataFrame) -> DataFrame:
    """Types in lower case, values as they are, without blanks around and without repeats."""
    rows = tags.select("file_id", F.lower(F.trim("tag_type")).alias("tag_type"), F.trim("tag_value").alias("tag_value"))
    return rows.where((F.col("tag_type") != "") & (F.col("tag_value") != "")).distinct()


def replace_tags(tags: DataFrame, new: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """The tags after the files in ``new`` had all their tags, or those of ``types``, replaced."""
    gone = new.select(F.col("file_id").alias("_f")).distinct()
    old = tags.join(gone, F.col("file_id") == F.col("_f"), "left")
    dropped = F.col("_f").isNotNull() & (F.col("tag_type").isin(*types) if types else F.lit(True))
    return clean_tags(old.where(~dropped).drop("_f").unionByName(new))


def unlike_tag_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id): files of ``new`` whose set of (tag_type, tag_value) differs from their set in ``old``; order and repeats do
    not matter. Sets are compared by one row each."""
    digest = lambda df, n: df.groupBy("file_id").agg(F.md5(F.to_json(F.sort_array(F.collect_set(F.struct("tag_type", "tag_value"))))).alias(n))
    both = digest(new, "_new").join(digest(old, "_old"), "file_id", "left")
    return both.where(~F.col("_new").eqNullSafe(F.col("_old"))).select("file_id")


def refresh_tags(old: DataFrame, new: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """The tags after those of ``types`` were replaced for the files whose set of them changed; others are not touched."""
    of_types = old.where(F.col("tag_type").isin(*types))
    changed = unlike_tag_sets(of_types, new)
    return replace_tags(old, having(new, changed, "file_id"), types)


def merge_tag_groups(groups: list[DataFrame]) -> DataFrame:
    """Tags of several groups; of values that differ in case only the first group's spelling stays."""
    rows = None
    for n, df in enumerate(groups):
        part = df.select("file_id", "tag_type", "tag_value", F.lit(n).alias("_g"))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("file_id", "tag_type", F.lower("tag_value")).orderBy("_g", "tag_value")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_g", "_n")


def expand_aliases(terms: DataFrame, clusters: DataFrame) -> DataFrame:
    """Terms with all members of every alias cluster that one of them touches, in one pass; clusters: (cluster, term)."""
    hit = clusters.join(terms, "term", "left_semi").select("cluster").distinct()
    return terms.select("term").unionByName(clusters.join(hit, "cluster", "left_semi").select("term")).distinct()


# Fixed values used below: statuses ready, waiting_stable, error, excluded, replaced, missing, archived, metadata_done.
# --- incremental ingest ------------------------------------------------------------------------------------------

def stability(listing: DataFrame, state: DataFrame, now: Column, window_s: int = 300) -> DataFrame:
    """(path, size, mtime_ns, status, stable_after): ready once a file has rested for the window, waiting otherwise.

    A first sight, any change of size or time and an earlier error are judged from scratch; a file that waited and whose
    time has passed is ready; ready stays ready.
    """
    s = state.select("path", F.col("size").alias("s_size"), F.col("mtime_ns").alias("s_mtime"), F.col("status").alias("s_status"), F.col("stable_after").alias("s_after"))
    rows = listing.join(s, "path", "left")
    touched = F.timestamp_seconds(F.col("mtime_ns") / 1_000_000_000).cast("timestamp_ntz")
    rested = touched + F.make_dt_interval(secs=F.lit(window_s)) <= now
    fresh = F.col("s_status").isNull() | ~F.col("s_size").eqNullSafe(F.col("size")) | ~F.col("s_mtime").eqNullSafe(F.col("mtime_ns")) | (F.col("s_status") == "error")
    ready = F.when(fresh, rested).otherwise((F.col("s_status") == "ready") | (F.col("s_after") <= now))
    after = F.when(fresh, now + F.make_dt_interval(secs=F.lit(window_s))).otherwise(F.col("s_after"))
    return rows.select("path", "size", "mtime_ns", F.when(ready, "ready").otherwise("waiting_stable").alias("status"), F.when(~ready, after).alias("stable_after"))


def changed_dirs(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Directories to read again: unknown ones, and those whose time differs; -1 in the cache asks for a new read."""
    c = cache.select("dir", F.col("mtime_ns").alias("known"))
    return listing.join(c, "dir", "left").where(F.col("known").isNull() | (F.col("known") == -1) | (F.col("known") != F.col("mtime_ns"))).select("dir", "mtime_ns")


def has_changes(listing: DataFrame, cache: DataFrame) -> bool:
    return bool(changed_dirs(listing, cache).limit(1).count())


def saved_dirs(cache: DataFrame, listing: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, mtime_ns): the directory times to keep for the next delta scan. A directory that was read is kept with its time
    only if all its files are settled; one with a waiting or failed file is kept as -1, so that it is read again; others stay
    as they were. files: (dir, status)."""
    open_ = files.groupBy("dir").agg(F.count_if(~F.col("status").isin("ready", "done") | F.col("status").isNull()).alias("n")).where("n > 0").select("dir", F.lit(True).alias("open"))
    new = listing.join(open_, "dir", "left").select("dir", F.when(F.col("open"), F.lit(-1)).otherwise(F.col("mtime_ns")).alias("new"))
    return cache.select("dir", F.col("mtime_ns").alias("old")).join(new, "dir", "full_outer").select("dir", F.coalesce("new", "old").alias("mtime_ns"))


def pass_counters(upserted: DataFrame, walked: int, failed: int, missing: int) -> DataFrame:
    """One row: what a pass scanned, created, updated (moves count here as well), moved, lost and could not read."""
    of = lambda *outcomes: F.count_if(F.col("outcome").isin(*outcomes))
    return upserted.agg(F.lit(walked).cast("long").alias("scanned"), of("created").alias("created"), of("refreshed", "moved").alias("updated"), of("moved").alias("moved"), F.lit(missing).cast("long").alias("missing"), F.lit(failed).cast("long").alias("failed"))


def upsert(files: DataFrame, seen: DataFrame) -> DataFrame:
    """(file_id, path, outcome) over both sides: created, moved, refreshed; rows of another id on a path that got a new
    file are replaced; the rest is kept."""
    old = files.select("file_id", F.col("path").alias("old_path"))
    new = seen.select("file_id", F.col("path").alias("new_path"))
    both = old.join(new, "file_id", "full_outer")
    created = both.where("old_path is null").select(F.col("new_path").alias("taken"), F.col("file_id").alias("by")).groupBy("taken").agg(F.min("by").alias("by"))
    both = both.join(created, F.col("old_path") == F.col("taken"), "left")
    outcome = (
        F.when(F.col("old_path").isNull(), "created")
        .when(F.col("new_path").isNotNull() & (F.col("new_path") != F.col("old_path")), "moved")
        .when(F.col("new_path").isNotNull(), "refreshed")
        .when(F.col("taken").isNotNull(), "replaced")
        .otherwise("kept")
    )
    return both.select("file_id", F.coalesce("new_path", "old_path").alias("path"), outcome.alias("outcome"))


def may_mark_missing(configured: int, active: int, failed: int, walked: int, least_walked: int = 100) -> bool:
    """Whether a walk is good enough to call files missing: some root is there, nothing failed, and enough was walked."""
    return not (configured and not active) and failed == 0 and walked >= least_walked


def mark_missing(files: DataFrame, seen: DataFrame, active_roots: list[str], walked: int, least_walked: int = 100, failed: int = 0, configured: int | None = None) -> DataFrame:
    """``files`` with their status after a whole walk: what an active root no longer shows is missing, what lies under
    other roots is archived, what came back is to be analysed again. A walk that failed in part, of too few files or without
    any of the configured roots changes nothing, and files are judged only where the walk had a root at all."""
    if not may_mark_missing(len(active_roots) if configured is None else configured, len(active_roots), failed, walked, least_walked):
        return files
    there = seen.select(F.col("path").alias("_p")).distinct()
    on = F.lit(False)
    for r in active_roots:
        on = on | (F.col("path") == r) | F.startswith(F.col("path"), F.lit(r.rstrip("/") + "/"))
    rows = files.join(there, F.col("path") == F.col("_p"), "left")
    settled = F.col("status").isin("excluded", "replaced")
    status = F.when(settled, F.col("status")).when(F.col("_p").isNotNull(), F.when(F.col("status").isin("missing", "archived"), "metadata_done").otherwise(F.col("status"))).when(on, "missing").otherwise("archived")
    return rows.withColumn("status", status).drop("_p")


# --- work lists and documents ------------------------------------------------------------------------------------

def stale(sources: DataFrame, built: DataFrame, key: str, version: str) -> DataFrame:
    """Keys whose derived row is absent, of another version, or older than its source; sources: (key, source_at)."""
    b = built.select(F.col(key), F.col("version"), F.col("built_from"))
    old = F.col("version").isNull() | (F.col("version") != version) | F.col("built_from").isNull() | (F.col("built_from") < F.col("source_at"))
    return sources.join(b, key, "left").where(old).select(key, "source_at")


def build_documents(files: DataFrame, tags: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, keyword_text, semantic_text, search_text, source_at): lines of name, path, text and tags in order,
    repeated lines once."""
    by = tags.groupBy("file_id").agg(F.sort_array(F.collect_set(F.struct("tag_type", "tag_value"))).alias("g"))
    t = texts.select("file_id", "text", F.col("updated_at").alias("text_at"))
    rows = files.join(by, "file_id", "left").join(t, "file_id", "left")
    values = F.coalesce(F.transform("g", lambda x: x["tag_value"]), F.array().cast("array<string>"))
    lines = lambda *parts: F.array_join(F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n")
    one = lambda c: F.array(F.col(c))
    month = F.month("taken")
    dates = F.array(F.date_format("taken", "yyyy-MM"), F.when(month.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in _SEASONS]), month)))
    keyword, semantic = lines(one("filename"), one("path"), one("text"), values), lines(one("filename"), values, dates)
    return rows.select("file_id", keyword.alias("keyword_text"), semantic.alias("semantic_text"), lines(F.array(keyword), F.array(semantic)).alias("search_text"), F.greatest("updated_at", "text_at").alias("source_at"))


_SEASONS = ("winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter")


def changed_text(new: DataFrame, old: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows whose text is not what is stored already, by its digest."""
    known = old.select(key, F.md5(text_col).alias("_h"))
    return new.withColumn("_h", F.md5(text_col)).join(known, [key, "_h"], "left_anti").drop("_h")


def merge_work(queues: list[DataFrame], key: str, most: int) -> DataFrame:
    """Keys of several queues, earlier queues first, each once, at most ``most``."""
    rows = None
    for n, df in enumerate(queues):
        part = df.select(key, F.lit(n).alias("queue"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min("queue").alias("queue")).orderBy("queue", key).limit(most)


def keyed_upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of equal keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


# --- people ------------------------------------------------------------------------------------------------------

def merge_people(faces: DataFrame, source: int, target: int) -> DataFrame:
    """Faces after one person was merged into another; where they came from first is kept."""
    hit = F.col("person_id") == source
    return faces.withColumns({"merged_from": F.when(hit, F.coalesce("merged_from", "person_id")).otherwise(F.col("merged_from")), "person_id": F.when(hit, F.lit(target)).otherwise(F.col("person_id"))})


def unmerge_people(faces: DataFrame, source: int, target: int) -> DataFrame:
    """The exact reverse of ``merge_people``."""
    hit = (F.col("person_id") == target) & (F.col("merged_from") == source)
    return faces.withColumns({"person_id": F.when(hit, F.lit(source)).otherwise(F.col("person_id")), "merged_from": F.when(hit, F.lit(None)).otherwise(F.col("merged_from"))})


def assign_faces(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Faces after some were given to a person by hand; chosen: (face_id, to), a null ``to`` takes the face from everybody.
    A face that was chosen twice goes to the smallest person."""
    to = chosen.groupBy("face_id").agg(F.min("to").alias("_to"), F.lit(True).alias("_hit"))
    rows = faces.join(to, "face_id", "left")
    return rows.withColumns({"person_id": F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("person_id")), "merged_from": F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("merged_from"))}).drop("_to", "_hit")


def add_person(presence: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, person_id, by_hand): people in files after some were added by hand; who is there already stays as found."""
    new = wanted.select("file_id", "person_id").distinct().join(presence.select("file_id", "person_id"), ["file_id", "person_id"], "left_anti")
    return presence.select("file_id", "person_id", "by_hand").unionByName(new.withColumn("by_hand", F.lit(True)))


def remove_person(presence: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The people in files after some were taken out by hand."""
    return presence.join(unwanted.select("file_id", "person_id").distinct(), ["file_id", "person_id"], "left_anti")


def fill_labels(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """The person tags after drift was mended: lacking ones added, stale ones taken away, other tags as they are."""
    drift = label_drift(labels, tags)
    stale = drift.where("problem = 'stale'").select("file_id", F.lit("person").alias("tag_type"), F.col("label").alias("tag_value"))
    lacking = drift.where("problem = 'lacking'").select("file_id", F.lit("person").alias("tag_type"), F.col("label").alias("tag_value"))
    return tags.join(stale, ["file_id", "tag_type", "tag_value"], "left_anti").unionByName(lacking)


def shown_people(counts: DataFrame, most_files: int = 10, most_faces: int = 10) -> DataFrame:
    """``counts`` (person_id, name, files, faces) of people with a face, with ``shown``: named, or in more files or more faces
    than clusters of noise have."""
    named = ~F.coalesce(F.col("name").like("person-%"), F.lit(True))
    return counts.where("faces > 0").withColumn("shown", named | (F.col("files") > most_files) | (F.col("faces") > most_faces))


def vector_work(files: DataFrame, vectors: DataFrame, model: str, version: str) -> DataFrame:
    """(file_id, source): files without a vector of this model and version, and what to encode: the original, or the
    thumbnail where the original is gone. vectors: (file_id, model, version)."""
    held = vectors.where((F.col("model") == model) & (F.col("version") == version))
    left = files.join(held.select("file_id"), "file_id", "left_anti")
    return left.select("file_id", F.coalesce("original", "thumbnail").alias("source")).where("source is not null")


def merge_lines(first: Column, second: Column, most: int = 1000) -> Column:
    """The lines of two readings of one image: those of the first, then new ones of the second; blank lines, and lines that
    differ in case or blanks alone, count once; at most ``most`` lines, as a reading has."""
    lines = F.transform(F.split(F.concat_ws("\n", first, second), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    low = F.transform(lines, F.lower)
    kept = F.filter(F.transform(lines, lambda x, i: F.when((x != "") & (F.array_position(low, F.lower(x)) == i + 1), x)), lambda x: x.isNotNull())
    return F.array_join(F.slice(kept, 1, most), "\n")


def settle_jobs(jobs: DataFrame, now: Column, stale_s: int = 300) -> DataFrame:
    """``jobs`` (job_id, status, beat_at) with ``settled``: of the running ones the oldest with a fresh heartbeat goes on, a
    running one without a heartbeat within ``stale_s`` is canceled, other running ones wait; the rest stays."""
    fresh = (F.col("status") == "running") & (F.col("beat_at") > now - F.make_dt_interval(secs=F.lit(stale_s)))
    one = jobs.where(fresh).agg(F.min("job_id").alias("_one"))  # one row
    settled = F.when(F.col("status") != "running", F.col("status")).when(~F.coalesce(fresh, F.lit(False)), "canceled").when(F.col("job_id") == F.col("_one"), "running").otherwise("queued")
    return jobs.crossJoin(F.broadcast(one)).withColumn("settled", settled).drop("_one")


def union_aliases(own: Column, other: Column, name: Column, most: int = 20, length: int = 128) -> Column:
    """Aliases of both and the absorbed name, without repeats, shortened and capped."""
    every = F.array_union(F.coalesce(own, F.array().cast("array<string>")), F.array_union(F.array(name), F.coalesce(other, F.array().cast("array<string>"))))
    kept = F.filter(F.transform(every, lambda x: F.substring(F.trim(x), 1, length)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(kept), 1, most)


def label_drift(labels: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_id, label, problem): labels that a file's people ask for and its tags lack, and tags nobody asks for."""
    have = tags.where(F.col("tag_type") == "person").select("file_id", F.col("tag_value").alias("label")).distinct()
    want = labels.select("file_id", "label").distinct()
    return want.join(have, ["file_id", "label"], "left_anti").withColumn("problem", F.lit("lacking")).unionByName(have.join(want, ["file_id", "label"], "left_anti").withColumn("problem", F.lit("stale")))


def resolve_labels(people: DataFrame, merged: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, person_id): people by a name or alias, without case, followed to the visible person; null where new.

    people: (id, label); merged: (id, root_id) of the people who were merged away; wanted: (name). A visible holder of the
    label goes before merged ones, and among each the smallest id."""
    holder = F.struct(F.col("root_id").isNotNull().alias("away"), F.col("id"), F.coalesce("root_id", "id").alias("to"))
    known = people.select(F.lower(F.trim("label")).alias("_k"), "id").join(merged, "id", "left").groupBy("_k").agg(F.min(holder).alias("by"))
    known = known.select("_k", F.col("by.to").alias("person_id"))
    return wanted.select("name").distinct().join(known, F.lower(F.trim("name")) == F.col("_k"), "left").select("name", "person_id")
