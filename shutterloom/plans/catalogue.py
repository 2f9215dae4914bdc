"""Queries of the catalogue operators over the photo-library tables, with their SQL counterparts.

Tags are derived from media_files: the folder (auto_event), the kind (auto_object), the volume (place) and the suffix
(custom). Faces and people are played by lineitem and supplier, vectors and their groups by embeddings, the search log
by events. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterloom.functions import predicates as P
from shutterloom.operators import boxes, catalog, hierarchy, places, ranking, text, vectors
from shutterloom.operators.components import components
from shutterloom.operators.spatial import in_polygons, in_regions
from shutterloom.plans import planner
from shutterloom.plans.search import resolve_people, search, suggest, vocabulary
from shutterloom.session import cut_lineage, remove, shared_folder
from shutterloom.sources.listing import sample_per_root
from shutterloom.sources.tables import table
from shutterloom.streaming import sync

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def media(spark: SparkSession, d: str) -> DataFrame:
    taken = P.capture_time(F.col("exif_datetime"), F.col("mtime_ns"))
    return table(spark, d, "media_files").withColumn("taken", taken)


def _tag(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("tag_type"), value.alias("tag_value"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_files")
    kinds = F.array(
        _tag("auto_event", F.element_at(F.split("current_path", "/"), -2)),
        _tag("auto_object", F.col("media_kind")),
        _tag("place", F.get(F.split("source_root", "/"), F.lit(2))),
        _tag("custom", F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)),
    )
    return m.select("file_id", F.inline(kinds)).where("tag_value is not null and tag_value <> ''")


def faces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("person_id"))


_TAKEN = "coalesce(exif_datetime, make_timestamp(mtime_ns // 1000))"
_MEDIA = f"WITH m AS (SELECT *, {_TAKEN} AS taken FROM media_files) "
_ACTIVE = "status NOT IN ('missing', 'replaced', 'excluded')"
_TAGS = r"""
WITH t AS (SELECT * FROM (
  SELECT file_id, 'auto_event' AS tag_type, list_extract(string_split(current_path, '/'), -2) AS tag_value FROM media_files
  UNION ALL SELECT file_id, 'auto_object', media_kind FROM media_files
  UNION ALL SELECT file_id, 'place', list_extract(string_split(source_root, '/'), 3) FROM media_files
  UNION ALL SELECT file_id, 'custom', regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1) FROM media_files)
  WHERE tag_value IS NOT NULL AND tag_value <> '')
"""


# --- filters and projections ---

@query(f"SELECT file_id, status FROM media_files WHERE {_ACTIVE}")
def active_files(spark, d):
    return table(spark, d, "media_files").where(P.active(F.col("status"))).select("file_id", "status")


@query(_MEDIA + "SELECT file_id, taken FROM m WHERE taken >= TIMESTAMP '2018-03-01' AND taken < TIMESTAMP '2018-09-01'")
def media_filter_range(spark, d):
    return media(spark, d).where(P.day_range(F.col("taken"), "2018-03-01", "2018-08-31")).select("file_id", "taken")


@query(_MEDIA + "SELECT file_id, taken FROM m")
def captured_at_coalesce(spark, d):
    return media(spark, d).select("file_id", "taken")


@query("SELECT file_id FROM media_files WHERE contains(lower(current_path), 'garden')")
def media_like(spark, d):
    return table(spark, d, "media_files").where(P.contains_ci(F.col("current_path"), "Garden")).select("file_id")


@query("SELECT file_id FROM media_files WHERE current_path ILIKE '%img_0%2_.jpg%'")
def media_like_wild(spark, d):
    return table(spark, d, "media_files").where(P.like_ci(F.col("current_path"), "img_0%2_.jpg")).select("file_id")


@query(_MEDIA + "SELECT file_id FROM m WHERE (hour(taken) >= 21 OR hour(taken) < 4) AND isodow(taken) - 1 IN (5, 6)")
def daypart_weekday(spark, d):
    return media(spark, d).where(P.daypart(F.col("taken"), "night") & P.weekday_in(F.col("taken"), (5, 6))).select("file_id")


@query(
    "SELECT file_id, CASE WHEN regexp_matches(lower(current_path), '\\.(jpg|jpeg|png|heic|heif|tif|tiff|gif|webp|bmp|dng|cr2|nef|arw)$') THEN 'image' WHEN regexp_matches(lower(current_path), '\\.(mp4|mov|m4v|avi|mkv|webm|mts|3gp)$') THEN 'video' WHEN mime_type LIKE 'image/%' THEN 'image' WHEN mime_type LIKE 'video/%' THEN 'video' ELSE 'unknown' END AS kind FROM media_files"
)
def classify_media(spark, d):
    return table(spark, d, "media_files").select("file_id", P.media_kind(F.col("current_path"), F.col("mime_type")).alias("kind"))


@query(_TAGS + "SELECT DISTINCT file_id FROM t WHERE tag_type IN ('place', 'place_detail', 'location', 'geo', 'geo_detail') AND lower(tag_value) = 'usb-blue'")
def tag_exists_ci(spark, d):
    return catalog.with_tag(table(spark, d, "media_files"), tags(spark, d), "USB-Blue", P.TAG_ROLES["place"], exact=False).select("file_id").distinct()


@query(_TAGS + f"SELECT DISTINCT file_id FROM media_files WHERE {_ACTIVE} AND file_id IN (SELECT file_id FROM t WHERE tag_value = 'Reflections')")
def tag_semi(spark, d):
    m = table(spark, d, "media_files").where(P.active(F.col("status")))
    return catalog.with_tag(m, tags(spark, d), "Reflections").select("file_id").distinct()


@query(f"SELECT file_id FROM media_files WHERE {_ACTIVE} AND EXISTS (SELECT 1 FROM documents d WHERE d.file_id = media_files.file_id)")
def gate_exists(spark, d):
    m = table(spark, d, "media_files").where(P.active(F.col("status"))).select("file_id")
    return catalog.having(m, table(spark, d, "documents"), "file_id")


@query(f"SELECT file_id FROM media_files WHERE {_ACTIVE} AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.file_id = media_files.file_id)")
def missing_doc_anti(spark, d):
    m = table(spark, d, "media_files").where(P.active(F.col("status"))).select("file_id")
    return catalog.having(m, table(spark, d, "documents"), "file_id", wanted=False)


@query("SELECT o_orderkey AS file_id, coalesce(n, 0) AS faces FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(n, 0) BETWEEN 2 AND 3")
def face_count_range(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    return catalog.count_range(files, faces(spark, d), "file_id", 2, 3, "faces")


@query(_TAGS + "SELECT DISTINCT tag_value FROM t WHERE tag_value NOT LIKE 'person-%' AND NOT regexp_matches(tag_value, '^-?\\d+(\\.\\d+)?,-?\\d+(\\.\\d+)?$')")
def visible_tags(spark, d):
    v = F.col("tag_value")
    return tags(spark, d).where(~P.is_internal_person(v) & ~P.is_coordinate(v)).select("tag_value").distinct()


@query(_TAGS + "SELECT DISTINCT file_id FROM t WHERE lower(tag_value) = 'trip' OR length(tag_value) >= 2 AND (contains(lower(tag_value), 'trip') OR contains('trip', lower(tag_value)))")
def term_match_bidir(spark, d):
    return tags(spark, d).where(P.term_fits(F.lower("tag_value"), F.lit("trip"))).select("file_id").distinct()


@query("SELECT doc_id FROM documents WHERE NOT (contains(lower(coalesce(text, '')), 'total') OR coalesce(lower(lang), '') = 'ko')")
def excluded_terms(spark, d):
    gone = P.contains_ci(F.coalesce("text", F.lit("")), "total") | (F.coalesce(F.lower("lang"), F.lit("")) == "ko")
    return table(spark, d, "documents").where(~gone).select("doc_id")


@query("SELECT l_orderkey AS file_id FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def all_persons(spark, d):
    by = faces(spark, d).where(F.col("person_id").isin(1, 2)).groupBy("file_id").agg(F.collect_set(F.col("person_id").cast("string")).alias("p"))
    return by.where(F.array_contains("p", "1") & F.array_contains("p", "2")).select("file_id")


@query(r"WITH k AS (SELECT DISTINCT media_kind AS cluster, lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) AS term FROM media_files WHERE media_kind IS NOT NULL AND regexp_matches(filename, '\.[A-Za-z0-9]+$')), a(term) AS (VALUES ('jpg'), ('tree')) SELECT term FROM a UNION SELECT term FROM k WHERE cluster IN (SELECT cluster FROM k WHERE term IN (SELECT term FROM a))")
def alias_expand(spark, d):
    """Suffixes of one kind of file stand for each other."""
    m = table(spark, d, "media_files").select(F.col("media_kind").alias("cluster"), F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)).alias("term"))
    return catalog.expand_aliases(spark.createDataFrame([("jpg",), ("tree",)], "term string"), m.where("cluster is not null and term <> ''").distinct())


# --- aggregations ---

@query("SELECT status, media_kind, count(*) AS files FROM media_files GROUP BY 1, 2")
def status_counts(spark, d):
    return table(spark, d, "media_files").groupBy("status", "media_kind").agg(F.count("*").alias("files"))


@query("SELECT CASE WHEN status IN ('thumb_done', 'analysis_done', 'archived') THEN 'completed' WHEN status = 'error' THEN 'failed' WHEN status IN ('missing', 'replaced', 'excluded') THEN 'gone' ELSE 'scheduled' END AS bucket, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM media_files GROUP BY 1")
def status_breakdown(spark, d):
    s = F.col("status")
    bucket = F.when(s.isin("thumb_done", "analysis_done", "archived"), "completed").when(s == "error", "failed").when(s.isin(*P.HIDDEN), "gone").otherwise("scheduled")
    return table(spark, d, "media_files").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("SELECT source_root, count(*) AS files, count(*) FILTER (exif_datetime IS NOT NULL) AS dated, round(100.0 * count(*) FILTER (exif_datetime IS NOT NULL) / count(*), 1) AS coverage FROM media_files WHERE status <> 'excluded' GROUP BY 1")
def coverage_pct(spark, d):
    m = table(spark, d, "media_files").where(F.col("status") != "excluded")
    by = m.groupBy("source_root").agg(F.count("*").alias("files"), F.count_if(F.col("exif_datetime").isNotNull()).alias("dated"))
    return by.withColumn("coverage", P.percent(F.col("dated"), F.col("files"), 100.0))


@query("SELECT count(*) AS files, greatest(0, count(*) - 2 * count(*) FILTER (status = 'thumb_done')) AS waiting, count(*) FILTER (status = 'error') AS failed FROM media_files")
def analysis_summary(spark, d):
    done = F.count_if(F.col("status") == "thumb_done")
    return table(spark, d, "media_files").agg(F.count("*").alias("files"), F.greatest(F.lit(0), F.count("*") - 2 * done).alias("waiting"), F.count_if(F.col("status") == "error").alias("failed"))


@query(_TAGS + "SELECT tag_type, tag_value, count(*) AS rows, count(DISTINCT file_id) AS files FROM t GROUP BY 1, 2 ORDER BY rows DESC, tag_type, tag_value LIMIT 500")
def facet_counts(spark, d):
    by = tags(spark, d).groupBy("tag_type", "tag_value").agg(F.count("*").alias("rows"), F.countDistinct("file_id").alias("files"))
    return ranking.top(by, 500, F.desc("rows"), F.col("tag_type"), F.col("tag_value"))


@query(_TAGS + f"SELECT tag_value, count(DISTINCT t.file_id) FILTER ({_ACTIVE}) AS files FROM t JOIN media_files m ON t.file_id = m.file_id WHERE tag_type = 'place' GROUP BY 1 HAVING count(DISTINCT t.file_id) FILTER ({_ACTIVE}) > 0")
def place_facets(spark, d):
    m = table(spark, d, "media_files").where(P.active(F.col("status"))).select("file_id")
    t = tags(spark, d).where(F.col("tag_type") == "place")
    return t.join(m, "file_id").groupBy("tag_value").agg(F.countDistinct("file_id").alias("files"))


@query(_TAGS + ", c AS (SELECT tag_type, tag_value, count(*) AS n FROM t GROUP BY 1, 2) SELECT tag_type, tag_value, n, lag(tag_type) OVER (ORDER BY tag_type, n DESC, tag_value) IS DISTINCT FROM tag_type AS opens FROM c")
def facet_sections(spark, d):
    by = tags(spark, d).groupBy("tag_type", "tag_value").agg(F.count("*").alias("n"))
    # a section opens at its own first row, which partial aggregates find
    first = by.groupBy("tag_type").agg(F.min(F.struct(-F.col("n"), "tag_value"))["tag_value"].alias("first"))
    return by.join(first, "tag_type").withColumn("opens", F.col("tag_value") == F.col("first")).drop("first")


@query("SELECT s_suppkey AS person_id, s_name AS name, count(l_orderkey) AS faces, count(DISTINCT l_orderkey) FILTER (o_orderstatus <> 'P') AS files FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def person_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("st"))
    f = faces(spark, d).join(o, "file_id", "left")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    live = F.when(F.col("st") != "P", F.col("file_id"))
    return s.join(f, "person_id", "left").groupBy("person_id", "name").agg(F.count("file_id").alias("faces"), F.countDistinct(live).alias("files"))


@query("WITH c AS (SELECT l_suppkey AS person_id, count(*) AS faces FROM lineitem GROUP BY 1) SELECT person_id, faces, faces >= (SELECT avg(faces) FROM c) AS shown FROM c")
def people_having(spark, d):
    c = faces(spark, d).groupBy("person_id").agg(F.count("*").alias("faces"))
    bound = c.agg(F.avg("faces").alias("bound"))
    return c.crossJoin(F.broadcast(bound)).select("person_id", "faces", (F.col("faces") >= F.col("bound")).alias("shown"))


@query("SELECT l_orderkey AS file_id, count(*) AS faces, count(DISTINCT l_suppkey) AS people FROM lineitem GROUP BY 1")
def nested_counts(spark, d):
    return faces(spark, d).groupBy("file_id").agg(F.count("*").alias("faces"), F.countDistinct("person_id").alias("people"))


@query("SELECT merged_into_id AS target_id, id AS source_id, count(*) OVER (PARTITION BY merged_into_id) AS sources FROM people WHERE merged_into_id IS NOT NULL")
def merged_sources(spark, d):
    """Who was merged into whom, one row each, with their number: links are skewed, so nothing is gathered in lists."""
    p = table(spark, d, "people").where("merged_into_id is not null").select(F.col("merged_into_id").alias("target_id"), F.col("id").alias("source_id"))
    return p.join(p.groupBy("target_id").agg(F.count("*").alias("sources")), "target_id")


@query("SELECT event_type, count(*) AS runs, sum(value) AS seconds, round(100.0 * sum(value) / sum(sum(value)) OVER (), 3) AS share FROM events GROUP BY 1")
def stage_timing(spark, d):
    by = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.sum("value").alias("seconds"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("seconds").alias("_all")))).select("event_type", "runs", F.col("seconds"), F.round(100.0 * F.col("seconds") / F.col("_all"), 3).alias("share"))


@query("SELECT (SELECT count(*) FROM media_files) AS files, (SELECT count(*) FROM scan_observations) AS observations, (SELECT count(*) FROM scan_observations WHERE status = 'ready') AS ready, (SELECT count(*) FROM people WHERE merged_into_id IS NULL) AS people")
def status_snapshot(spark, d):
    one = lambda df, n: df.agg(F.count("*").alias(n))
    o = table(spark, d, "scan_observations")
    parts = [one(table(spark, d, "media_files"), "files"), o.agg(F.count("*").alias("observations"), F.count_if(F.col("status") == "ready").alias("ready")), one(table(spark, d, "people").where("merged_into_id is null"), "people")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


# --- order, limits, windows ---

@query(_MEDIA + f"SELECT file_id, taken FROM m WHERE {_ACTIVE} ORDER BY taken DESC NULLS LAST, file_id LIMIT 100 OFFSET 100")
def newest_page(spark, d):
    return media(spark, d).where(P.active(F.col("status"))).select("file_id", "taken").orderBy(F.desc_nulls_last("taken"), "file_id").offset(100).limit(100)


@query("SELECT user_id, max(ts) AS last_at, count(*) AS runs FROM events GROUP BY 1 ORDER BY last_at DESC, user_id LIMIT 20")
def recent_queries(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"), F.count("*").alias("runs"))
    return ranking.top(by, 20, F.desc("last_at"), F.col("user_id"))


@query(_TAGS + ", c AS (SELECT tag_value, count(*) AS n FROM t WHERE contains(lower(tag_value), 'ca') GROUP BY 1) SELECT tag_value, n, starts_with(lower(tag_value), 'ca') AS starts FROM c ORDER BY starts DESC, n DESC, tag_value LIMIT 10")
def suggest_prefix_freq(spark, d):
    c = tags(spark, d).where(P.contains_ci(F.col("tag_value"), "ca")).groupBy("tag_value").agg(F.count("*").alias("n"))
    c = c.withColumn("starts", F.startswith(F.lower("tag_value"), F.lit("ca")))
    return ranking.top(c, 10, F.desc("starts"), F.desc("n"), F.col("tag_value"))


@query(_MEDIA + ", r AS (SELECT file_id, taken, size_bytes, row_number() OVER (PARTITION BY CAST(taken AS DATE) ORDER BY size_bytes DESC, file_id) AS n FROM m) SELECT file_id, taken FROM r WHERE n <= 2 OR taken IS NULL")
def day_cap(spark, d):
    rows = media(spark, d).select("file_id", "taken", "size_bytes")
    return ranking.day_cap(rows, "taken", [F.desc("size_bytes"), F.col("file_id")], 2).select("file_id", "taken")


@query("WITH r AS (SELECT event_id, value, epoch_us(ts) // 600000000 AS cell FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, event_id) AS n, min(event_id) OVER (PARTITION BY cell) AS pos FROM r) SELECT event_id, pos FROM w WHERE n = 1")
def burst_dedup(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("pos"), "ts", "value")
    return ranking.burst(e, "ts", "value", "pos", 600).select("event_id", "pos")


@query("SELECT l_orderkey AS file_id, l_linenumber AS asset FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def best_asset(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    by = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.min_by("l_linenumber", F.struct(flag, "l_linenumber")).alias("asset"))
    return by


@query("SELECT person_id, file_id FROM (SELECT l_suppkey AS person_id, l_orderkey AS file_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def sample_faces(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    return rows.select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("file_id"))


@query("SELECT current_path, file_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY current_path ORDER BY updated_at DESC, file_id DESC) AS n FROM media_files) WHERE n = 1")
def latest_embedding(spark, d):
    by = table(spark, d, "media_files").groupBy("current_path").agg(F.max(F.struct("updated_at", "file_id")).alias("s"))
    return by.select("current_path", "s.file_id", "s.updated_at")


@query("SELECT file_id, source_root FROM (SELECT DISTINCT file_id, source_root, dense_rank() OVER (PARTITION BY source_root ORDER BY file_id) AS n FROM media_files) WHERE n <= 5")
def sample_testbed(spark, d):
    return sample_per_root(table(spark, d, "media_files"), 5).select("file_id", "source_root")


# --- text and vectors ---

_BM25 = r"""
WITH q(w) AS (VALUES ('river'), ('bridge'), ('album')),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z가-힣_]+') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
f AS (SELECT doc_id, len(t.w) AS len, q.w, len(list_filter(t.w, lambda x: x = q.w)) AS tf FROM t, q),
c AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM f GROUP BY 1),
r AS (SELECT doc_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM f JOIN c USING (w), s GROUP BY 1 HAVING sum(tf) > 0)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY round(score, 6), doc_id LIMIT 10
"""


@query(_BM25)
def bm25_topk(spark, d):
    hits = text.bm25(table(spark, d, "documents"), "doc_id", "text", ["river", "bridge", "album"])
    rows = hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return ranking.top(rows, 10, F.col("score"), F.col("doc_id"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'market square') THEN 'phrase' WHEN contains(lower(text), 'market') AND contains(lower(text), 'square') THEN 'word' END AS kind FROM documents WHERE contains(lower(text), 'market') AND contains(lower(text), 'square')")
def like_match_kind(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.match_kind(F.col("text"), "market square").alias("kind"))
    return rows.where("kind is not null")


@query("WITH b AS (SELECT doc_id, regexp_replace(text, '[^가-힣]', '', 'g') AS t FROM documents), g AS (SELECT doc_id, len(list_intersect(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), ['강아', '아지', '지사', '사진'])) AS hits FROM b) SELECT doc_id, hits FROM g WHERE hits > 0")
def bigram_overlap(spark, d):
    return text.gram_overlap(table(spark, d, "documents"), "doc_id", "text", "강아지 사진").select(F.col("id").alias("doc_id"), "hits")


@query("WITH b AS (SELECT doc_id, regexp_replace(text, '[^가-힣]', '', 'g') AS t FROM documents) SELECT g AS gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM b) GROUP BY 1")
def gram_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(P.bigrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"


def _vector(spark, d, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR.format(7)}), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10")
def vector_topk(spark, d):
    rows = vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", [_vector(spark, d, 7)])
    return ranking.top(rows.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance")), 10, F.col("distance"), F.col("vec_id"))


@query(f"SELECT vec_id, round(least(1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR.format(7)}), 1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR.format(11)})), 6) AS distance FROM embeddings WHERE label IN (1, 2, 3) ORDER BY 2, 1 LIMIT 10")
def variant_min(spark, d):
    rows = vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", [_vector(spark, d, 7), _vector(spark, d, 11)], where=F.col("label").isin(1, 2, 3))
    return ranking.top(rows.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance")), 10, F.col("distance"), F.col("vec_id"))


_CENTROID = """
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v, unnest(range(64)) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY 1, 2),
c AS (SELECT label, list(v ORDER BY pos) AS raw FROM m GROUP BY 1),
k AS (SELECT label, list_transform(raw, lambda e: e / sqrt(list_dot_product(raw, raw))) AS centroid FROM c)
"""


@query(_CENTROID + "SELECT label, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last FROM k")
def centroid_mean(spark, d):
    c = vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return c.select(F.col("group").alias("label"), F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"))


@query(_CENTROID + ", p AS (SELECT vec_id, k.label AS nearest, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], centroid) DESC, k.label) AS n FROM embeddings, k) SELECT vec_id, nearest, round(s, 6) AS similarity FROM p WHERE n = 1")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.closest_centroid(e, "vec_id", "embedding", vectors.mean_vectors(e, "label", "embedding"))
    return found.select(F.col("id").alias("vec_id"), F.col("key").alias("nearest"), F.round("similarity", 6).alias("similarity"))


@query(_CENTROID + ", p AS (SELECT a.label AS from_id, b.label AS into_id, list_cosine_similarity(a.centroid, b.centroid) AS s, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.centroid, b.centroid) DESC, b.label) AS n FROM k a, k b WHERE a.label % 2 = 1 AND b.label % 2 = 0) SELECT from_id, into_id, round(s, 6) AS similarity FROM p WHERE n = 1 AND s >= -0.2")
def cluster_absorb(spark, d):
    c = vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    c = c.select(F.col("group").alias("id"), (F.col("group") % 2 == 0).alias("named"), "centroid")
    return vectors.absorb(c, -0.2, None).select("from_id", "into_id", F.round("similarity", 6).alias("similarity"))


@query(_CENTROID + ", p AS (SELECT vec_id, k.label AS concept, list_cosine_similarity(embedding::DOUBLE[], centroid) AS s FROM embeddings, k), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, concept) AS n FROM p WHERE s >= 0.24) SELECT vec_id, concept, round(s, 6) AS similarity FROM r WHERE n <= 5")
def zero_shot_concepts(spark, d):
    e = table(spark, d, "embeddings")
    c = vectors.mean_vectors(e, "label", "embedding").select(F.col("group").alias("concept"), "centroid", F.lit(0.24).alias("threshold"))
    return vectors.concepts(e, "vec_id", "embedding", c).select(F.col("id").alias("vec_id"), "concept", F.round("similarity", 6).alias("similarity"))


@query()
def online_cluster(spark, d):
    return vectors.cluster_online(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


# --- fusion ---

_CHANNELS = """
WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, doc_id) AS rank FROM documents WHERE contains(lower(text), 'bridge')),
s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE contains(lower(text), 'river')),
c AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents WHERE contains(lower(text), 'market')),
ot AS (SELECT * FROM o WHERE rank <= 60), st AS (SELECT * FROM s WHERE rank <= 60), ct AS (SELECT * FROM c WHERE rank <= 60),
ids AS (SELECT id FROM ot UNION SELECT id FROM st UNION SELECT id FROM ct),
j AS (SELECT ids.id, ot.rank AS ocr, ct.rank AS clip, st.rank AS shadow,
  (ot.rank IS NOT NULL)::INT + (ct.rank IS NOT NULL)::INT + (st.rank IS NOT NULL)::INT AS hits,
  coalesce(0.36 / 0.88 / (60 + ot.rank), 0) + coalesce(0.34 / 0.88 / (60 + ct.rank), 0) + coalesce(0.18 / 0.88 / (60 + st.rank), 0) AS base
  FROM ids LEFT JOIN ot USING (id) LEFT JOIN ct USING (id) LEFT JOIN st USING (id)),
f AS (SELECT *, base * CASE hits WHEN 1 THEN 1.0 WHEN 2 THEN 1.15 ELSE 1.3 END AS raw FROM j)
"""


def _channels(spark, d) -> dict[str, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "updated_at", "n_chars")
    has = lambda w: docs.where(P.contains_ci(F.col("text"), w))
    return {
        "ocr": ranking.channel_rank(has("bridge").select("id", "updated_at"), 60, F.desc_nulls_last("updated_at"), F.col("id")),
        "clip": ranking.channel_rank(has("market").select("id", "n_chars"), 60, F.col("n_chars"), F.col("id")),
        "shadow": ranking.channel_rank(has("river").select("id", "n_chars"), 60, F.desc("n_chars"), F.col("id")),
    }


@query(_CHANNELS + "SELECT id, CAST(hits AS BIGINT) AS hits, round(raw / max(raw) OVER (), 9) AS score, CASE WHEN ocr IS NOT NULL AND clip IS NOT NULL THEN 'ocr+clip' WHEN clip IS NOT NULL AND shadow IS NOT NULL THEN 'clip+shadow' WHEN ocr IS NOT NULL THEN 'ocr' WHEN clip IS NOT NULL THEN 'clip' ELSE 'shadow' END AS reason FROM f")
def rrf_fuse(spark, d):
    return ranking.fuse(_channels(spark, d), ranking.weights("mixed")).select("id", "hits", F.round("score", 9).alias("score"), "reason")


@query(_CHANNELS + "SELECT ocr IS NOT NULL AS in_ocr, clip IS NOT NULL AS in_clip, shadow IS NOT NULL AS in_shadow, count(*) AS rows FROM f GROUP BY 1, 2, 3")
def channel_overlap(spark, d):
    return ranking.overlap(ranking.fuse(_channels(spark, d), ranking.weights("mixed")))


@query(_CHANNELS + "SELECT id, round(least(1, raw / max(raw) OVER () + CASE WHEN contains(lower(text), 'old bridge') THEN 0.22 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.08 ELSE 0 END), 9) AS score FROM f JOIN documents ON id = doc_id")
def boost_sum(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    rows = ranking.fuse(_channels(spark, d), ranking.weights("mixed")).join(docs, "id")
    score = ranking.boosted(F.col("score"), F.when(P.contains_ci(F.col("text"), "old bridge"), 0.22), F.when(F.col("lang") == "de", 0.08))
    return rows.select("id", F.round(score, 9).alias("score"))


@query("WITH w(intent, a, b, c) AS (VALUES ('ocr', 0.62, 0.04, 0.22), ('semantic', 0.03, 0.70, 0.18), ('mixed', 0.36, 0.34, 0.18), ('default', 0.35, 0.36, 0.17)) SELECT intent, round(a / (a + b + c), 9)::DOUBLE AS ocr, round(b / (a + b + c), 9)::DOUBLE AS clip, round(c / (a + b + c), 9)::DOUBLE AS shadow FROM w")
def intent_weights(spark, d):
    rows = [(i, *[round(x, 9) for x in ranking.weights(i).values()]) for i in ranking.INTENT_WEIGHTS]
    return spark.createDataFrame(rows, "intent string, ocr double, clip double, shadow double")


@query("SELECT event_id, event_type = 'purchase' AS pinned FROM events ORDER BY pinned DESC, value DESC, event_id LIMIT 50")
def feedback_pin(spark, d):
    e = table(spark, d, "events")
    rows = e.withColumn("pos", -F.col("value"))
    return ranking.pin(rows, e.where(F.col("event_type") == "purchase"), "event_id", "pos").select("event_id", "pinned").limit(50)


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)")
def hidden_anti(spark, d):
    e = table(spark, d, "events")
    return catalog.having(e, e.where((F.col("event_type") == "error") & (F.col("value") > 40)), "user_id", wanted=False).select("event_id")


@query(_TAGS + ", a AS (SELECT DISTINCT tag_value AS tag FROM t WHERE abs(length(tag_value) - 11) <= 11), g AS (SELECT tag, list_distinct(list_transform(range(1, length(tag)), lambda i: substr(tag, i, 2))) AS x, list_distinct(list_transform(range(1, 11), lambda i: substr('Reflectionz', i, 2))) AS q FROM a), s AS (SELECT tag, len(list_intersect(x, q)) / len(list_distinct(list_concat(x, q))) AS similarity FROM g) SELECT tag, similarity FROM s WHERE similarity >= 0.5 ORDER BY similarity DESC, tag LIMIT 1")
def fuzzy_bigram_jaccard(spark, d):
    return text.nearest_tag(tags(spark, d), "tag_value", "Reflectionz")


# --- enrichment and documents ---

@query(r"""
WITH m AS (SELECT file_id, filename, current_path AS path, exif_datetime AS taken, updated_at FROM media_files),
x AS (SELECT file_id, string_agg(text, chr(10) ORDER BY doc_id) AS text, max(updated_at) AS text_at FROM documents WHERE file_id IS NOT NULL GROUP BY 1),
g AS (SELECT file_id, list_sort(list_distinct(list({'t': tag_type, 'v': tag_value}))) AS g FROM (""" + _TAGS.strip() + r""" SELECT * FROM t) GROUP BY 1),
l AS (SELECT m.*, text, text_at, coalesce(list_transform(g, lambda e: e.v), []) AS v FROM m LEFT JOIN g USING (file_id) LEFT JOIN x USING (file_id)),
k AS (SELECT *, list_filter(list_concat([filename, path, text], v), lambda e: e IS NOT NULL AND trim(e) <> '') AS kw FROM l),
u AS (SELECT *, list_filter(list_transform(range(1, len(kw) + 1), lambda i: CASE WHEN list_position(kw, kw[i]) = i THEN kw[i] END), lambda e: e IS NOT NULL) AS once FROM k)
SELECT file_id, md5(array_to_string(once, chr(10))) AS keyword_digest, greatest(updated_at, text_at) AS source_at FROM u
""")
def search_document_build(spark, d):
    m = table(spark, d, "media_files").select("file_id", "filename", F.col("current_path").alias("path"), F.col("exif_datetime").alias("taken"), "updated_at")
    x = table(spark, d, "documents").where("file_id is not null").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("t"), F.max("updated_at").alias("updated_at"))
    x = x.withColumn("text", F.array_join(F.transform("t", lambda e: e["text"]), "\n"))  # all texts of a file are its document's
    docs = catalog.build_documents(m, tags(spark, d), x)
    return docs.select("file_id", F.md5("keyword_text").alias("keyword_digest"), "source_at")


@query("SELECT m.file_id, m.updated_at AS source_at FROM media_files m LEFT JOIN (SELECT file_id, max(updated_at) AS built FROM documents WHERE file_id IS NOT NULL GROUP BY 1) b USING (file_id) WHERE built IS NULL OR built < m.updated_at")
def doc_stale_select(spark, d):
    src = table(spark, d, "media_files").select("file_id", F.col("updated_at").alias("source_at"))
    built = table(spark, d, "documents").where("file_id is not null").groupBy("file_id").agg(F.max("updated_at").alias("built_from")).withColumn("version", F.lit("search-v1"))
    return catalog.stale(src, built, "file_id", "search-v1")


@query(_TAGS + ", n AS (SELECT file_id, 'custom' AS tag_type, upper(tag_value) AS tag_value FROM t WHERE tag_type = 'custom' AND tag_value IN ('jpg', 'png')) SELECT DISTINCT file_id, tag_type, trim(tag_value) AS tag_value FROM t WHERE NOT (tag_type = 'custom' AND file_id IN (SELECT file_id FROM n)) UNION SELECT * FROM n")
def tag_replace_types(spark, d):
    t = tags(spark, d)
    new = t.where((F.col("tag_type") == "custom") & F.col("tag_value").isin("jpg", "png")).withColumn("tag_value", F.upper("tag_value"))
    return catalog.replace_tags(t, new, ("custom",))


@query(_TAGS + ", g AS (SELECT *, 0 AS grp FROM t WHERE tag_type = 'place' UNION ALL SELECT file_id, 'place', upper(tag_value), 1 FROM t WHERE tag_type = 'place' UNION ALL SELECT file_id, 'place', media_kind, 1 FROM media_files), r AS (SELECT *, row_number() OVER (PARTITION BY file_id, tag_type, lower(tag_value) ORDER BY grp, tag_value) AS n FROM g) SELECT file_id, tag_type, tag_value FROM r WHERE n = 1")
def tag_merge_ci(spark, d):
    p = tags(spark, d).where(F.col("tag_type") == "place")
    more = p.withColumn("tag_value", F.upper("tag_value")).unionByName(table(spark, d, "media_files").select("file_id", F.lit("place").alias("tag_type"), F.col("media_kind").alias("tag_value")))
    return catalog.merge_tag_groups([p, more])


@query(_MEDIA + "SELECT file_id, CASE WHEN month(taken) IN (3, 4, 5) THEN 'spring' WHEN month(taken) IN (6, 7, 8) THEN 'summer' WHEN month(taken) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season FROM m")
def season_tag(spark, d):
    return media(spark, d).select("file_id", P.season(F.month("taken")).alias("season"))


@query("SELECT doc_id, n_chars >= 24 OR lines >= 3 AS text_heavy, regexp_matches(lower(text), 'total|receipt|invoice') AS receipt FROM (SELECT *, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL)")
def signal_tags(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    heavy = (F.col("n_chars") >= 24) | (F.size(F.split("text", "\n")) >= 3)
    return rows.select("doc_id", heavy.alias("text_heavy"), F.lower("text").rlike("total|receipt|invoice").alias("receipt"))


_RULES = [(r"screenshot", "auto_screen", "screenshot"), (r"^(img|dsc|pxl)[_-]?\d", "auto_object", "camera"), (r"^scan", "auto_object", "scan"), (r"^vid", "auto_object", "video")]


@query(r"SELECT DISTINCT file_id, k.t AS tag_type, k.v AS tag_value FROM media_files, (VALUES ('screenshot', 'auto_screen', 'screenshot'), ('^(img|dsc|pxl)[_-]?\d', 'auto_object', 'camera'), ('^scan', 'auto_object', 'scan'), ('^vid', 'auto_object', 'video')) k(p, t, v) WHERE regexp_matches(lower(filename), k.p)")
def filename_rules(spark, d):
    found = F.array_compact(F.array(*[F.when(F.lower("filename").rlike(p), F.struct(F.lit(t).alias("tag_type"), F.lit(v).alias("tag_value"))) for p, t, v in _RULES]))
    return table(spark, d, "media_files").select("file_id", F.inline(found)).distinct()


_GPS = "WITH g AS (SELECT file_id, CAST(json_extract(metadata_json, '$.gps.latitude') AS DOUBLE) AS lat, CAST(json_extract(metadata_json, '$.gps.longitude') AS DOUBLE) AS lon FROM media_files WHERE metadata_json IS NOT NULL), l AS (SELECT * FROM g WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) "


@query(_GPS + "SELECT file_id, 'geo' AS tag_type, printf('%.3f,%.3f', lat, lon) AS tag_value FROM l UNION ALL SELECT file_id, 'geo_detail', printf('%.7f,%.7f', lat, lon) FROM l")
def geo_tags(spark, d):
    return places.geo_tags(places.gps(table(spark, d, "media_files")))


@query(_GPS + ", c AS (SELECT DISTINCT city_id, latitude AS la, longitude AS lo FROM cities WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180), p AS (SELECT file_id, city_id, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2)))) AS km FROM l JOIN c ON la BETWEEN lat - 0.9 AND lat + 0.9), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY km, city_id) AS n FROM p WHERE km <= 90) SELECT file_id, city_id, round(km, 6) AS km FROM r WHERE n = 1")
def haversine_nearest(spark, d):
    g = places.gps(table(spark, d, "media_files")).select(F.col("file_id").alias("id"), "lat", "lon")
    found = places.nearest_place(g, places.places_of(table(spark, d, "cities")))
    return found.select(F.col("id").alias("file_id"), F.col("place_id").alias("city_id"), F.round("km", 6).alias("km"))


@query("SELECT file_id, sha256(CAST(size_bytes AS VARCHAR) || ':' || CAST(mtime_ns AS VARCHAR) || ':' || partial_hash) AS identity FROM media_files WHERE partial_hash IS NOT NULL")
def fingerprint_identity(spark, d):
    m = table(spark, d, "media_files").where("partial_hash is not null")
    return m.select("file_id", P.file_identity(F.col("size_bytes"), F.col("mtime_ns"), F.col("partial_hash")).alias("identity"))


# --- incremental ingest ---

@query("""
WITH o AS (SELECT file_id, current_path AS old_path FROM media_files WHERE updated_at < TIMESTAMP '2021-01-01'),
n AS (SELECT file_id, CASE WHEN size_bytes % 7 = 0 THEN current_path || '.moved' ELSE current_path END AS new_path FROM media_files WHERE updated_at >= TIMESTAMP '2019-01-01'),
j AS (SELECT coalesce(o.file_id, n.file_id) AS file_id, old_path, new_path FROM o FULL JOIN n ON o.file_id = n.file_id),
c AS (SELECT DISTINCT new_path FROM j WHERE old_path IS NULL)
SELECT file_id, coalesce(new_path, old_path) AS path, CASE WHEN old_path IS NULL THEN 'created' WHEN new_path <> old_path THEN 'moved' WHEN new_path IS NOT NULL THEN 'refreshed' WHEN old_path IN (SELECT new_path FROM c) THEN 'replaced' ELSE 'kept' END AS outcome FROM j
""")
def upsert_catalog(spark, d):
    return upsert_rows(spark, d)


def upsert_rows(spark, d):
    m = table(spark, d, "media_files")
    old = m.where("updated_at < timestamp_ntz '2021-01-01'").select("file_id", F.col("current_path").alias("path"))
    moved = F.when(F.col("size_bytes") % 7 == 0, F.concat("current_path", F.lit(".moved"))).otherwise(F.col("current_path"))
    new = m.where("updated_at >= timestamp_ntz '2019-01-01'").select("file_id", moved.alias("path"))
    return catalog.upsert(old, new)


@query("SELECT m.file_id, CASE WHEN status IN ('excluded', 'replaced') THEN status WHEN current_path IN (SELECT current_path FROM scan_observations WHERE current_path IS NOT NULL) THEN CASE WHEN status IN ('missing', 'archived') THEN 'metadata_done' ELSE status END WHEN current_path LIKE '/volumes/nas-home/photos/%' THEN 'missing' ELSE 'archived' END AS status FROM media_files m")
def mark_missing(spark, d):
    m = table(spark, d, "media_files").select("file_id", F.col("current_path").alias("path"), "status")
    seen = table(spark, d, "scan_observations").where("current_path is not null").select(F.col("current_path").alias("path"))
    return catalog.mark_missing(m, seen, ["/volumes/nas-home/photos"], walked=seen.count()).select("file_id", "status")


_NOW = "TIMESTAMP '2020-06-01 12:00:00'"


@query(f"""
WITH l AS (SELECT current_path AS path, max(size_bytes) AS size, max(mtime_ns) AS mtime_ns FROM scan_observations WHERE current_path IS NOT NULL AND mtime_ns IS NOT NULL GROUP BY 1),
s AS (SELECT current_path AS path, min(size_bytes) AS size, max(mtime_ns) AS mtime_ns, max(status) AS status, max(stable_after_at) AS stable_after FROM scan_observations WHERE current_path IS NOT NULL AND first_seen_at < TIMESTAMP '2018-01-01' GROUP BY 1),
j AS (SELECT l.*, s.status AS st, s.stable_after AS sa, s.status IS NULL OR s.size IS DISTINCT FROM l.size OR s.mtime_ns IS DISTINCT FROM l.mtime_ns OR s.status = 'error' AS fresh FROM l LEFT JOIN s USING (path)),
r AS (SELECT *, CASE WHEN fresh THEN make_timestamp(mtime_ns // 1000) + INTERVAL 300 SECOND <= {_NOW} ELSE st = 'ready' OR sa <= {_NOW} END AS ready FROM j)
SELECT path, CASE WHEN ready THEN 'ready' ELSE 'waiting_stable' END AS status FROM r
""")
def stability_split(spark, d):
    o = table(spark, d, "scan_observations").where("current_path is not null")
    listing = o.where("mtime_ns is not null").groupBy(F.col("current_path").alias("path")).agg(F.max("size_bytes").alias("size"), F.max("mtime_ns").alias("mtime_ns"))
    state = o.where("first_seen_at < timestamp_ntz '2018-01-01'").groupBy(F.col("current_path").alias("path")).agg(F.min("size_bytes").alias("size"), F.max("mtime_ns").alias("mtime_ns"), F.max("status").alias("status"), F.max("stable_after_at").alias("stable_after"))
    return catalog.stability(listing, state, F.lit("2020-06-01 12:00:00").cast("timestamp_ntz")).select("path", "status")


_DIRS = "SELECT regexp_extract(current_path, '^(.*)/', 1) AS dir, max(mtime_ns) AS mtime_ns FROM {} WHERE current_path IS NOT NULL GROUP BY 1"


@query(f"WITH l AS ({_DIRS.format('scan_observations')}), c AS ({_DIRS.format('media_files')}) SELECT l.dir, l.mtime_ns FROM l LEFT JOIN c USING (dir) WHERE c.mtime_ns IS NULL OR c.mtime_ns <> l.mtime_ns")
def delta_dirs(spark, d):
    dirs = lambda n: table(spark, d, n).where("current_path is not null").groupBy(F.regexp_extract("current_path", "^(.*)/", 1).alias("dir")).agg(F.max("mtime_ns").alias("mtime_ns"))
    return catalog.changed_dirs(dirs("scan_observations"), dirs("media_files"))


# --- more enrichment and upkeep ---

@query("SELECT file_id, regexp_matches(lower(filename), 'screenshot|scan|receipt|document|note') OR lower(filename) LIKE '%.png' AND e >= 0.025 OR e >= 0.08 OR e >= 0.045 AND b >= 0.5 AS read FROM (SELECT *, (size_bytes % 1000) / 10000.0::DOUBLE AS e, (size_bytes % 97) / 97.0::DOUBLE AS b FROM media_files)")
def ocr_gate(spark, d):
    m = table(spark, d, "media_files")
    edges, bright = (F.col("size_bytes") % 1000) / 10000.0, (F.col("size_bytes") % 97) / 97.0
    return m.select("file_id", P.wants_text_reading(F.col("filename"), edges, bright).alias("read"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.a, min(n.component) FROM u JOIN c AS n ON u.b = n.node JOIN recurring.c AS o ON o.node = u.a WHERE n.component < o.component GROUP BY u.a)
SELECT node, component FROM c""")
def alias_clusters(spark, d):
    """Components over every supplier-part edge: suppliers are the even nodes, parts the odd ones, so keys never meet."""
    rows = table(spark, d, "lineitem")
    return components(rows.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


@query("SELECT city_id, round(CASE WHEN ref = 'S' THEN -v ELSE v END, 7) AS decimal FROM (SELECT city_id, CASE WHEN latitude < 0 THEN 'S' ELSE 'N' END AS ref, floor(abs(latitude)) + floor(abs(latitude) * 60 % 60) / 60 + 30.0 / 3600 AS v FROM (SELECT DISTINCT city_id, latitude FROM cities WHERE latitude BETWEEN -90 AND 90 AND CAST(latitude AS VARCHAR) <> 'nan'))")
def gps_dms(spark, d):
    a = F.abs("latitude")
    c = table(spark, d, "cities").where("latitude between -90 and 90").select("city_id", "latitude").distinct()
    return c.select("city_id", P.dms(F.floor(a), F.floor(a * 60 % 60), F.lit(30.0), F.when(F.col("latitude") < 0, "S").otherwise("N")).alias("decimal"))


@query("WITH a AS (SELECT id, display_name, CASE WHEN json_valid(aliases_json) AND json_type(aliases_json) = 'ARRAY' THEN CAST(aliases_json AS VARCHAR[]) ELSE [] END AS own FROM people), l AS (SELECT id, list_filter(list_concat(own, [display_name]), lambda x: trim(x) <> '') AS v FROM a) SELECT id, len(list_distinct(list_transform(v, lambda x: trim(x)))) AS aliases FROM l")
def alias_union(spark, d):
    own = F.from_json("aliases_json", "array<string>")
    return table(spark, d, "people").select("id", F.size(catalog.union_aliases(own, F.array().cast("array<string>"), F.col("display_name"))).cast("long").alias("aliases"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 AND upper(text) <> text OR text IS NOT NULL AND doc_id % 3 = 1")
def changed_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 3 <> 1").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    return catalog.changed_text(docs.where("text is not null"), stored, "doc_id", "text").select("doc_id")


@query("WITH q AS (SELECT file_id, 0 AS queue FROM media_files WHERE status = 'error' UNION ALL SELECT file_id, 1 FROM media_files WHERE exif_datetime IS NULL UNION ALL SELECT file_id, 2 FROM media_files WHERE width IS NULL) SELECT file_id, min(queue) AS queue FROM q GROUP BY 1 ORDER BY queue, file_id LIMIT 500")
def work_queue(spark, d):
    m = table(spark, d, "media_files")
    return catalog.merge_work([m.where("status = 'error'"), m.where("exif_datetime is null"), m.where("width is null")], "file_id", 500)


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x))), lambda x: x <> '' AND x <> 'none'), '|') AS parts FROM documents WHERE doc_kind = 'caption' AND text IS NOT NULL")
def caption_parts(spark, d):
    rows = table(spark, d, "documents").where("doc_kind = 'caption' and text is not null")
    return rows.select("doc_id", F.array_join(P.caption_parts(F.col("text")), "|").alias("parts"))


@query("WITH g AS (SELECT source_root, min(exif_datetime) AS first FROM media_files GROUP BY 1) SELECT file_id, coalesce(exif_datetime, first) AS taken FROM media_files JOIN g USING (source_root)")
def repair_capture_time(spark, d):
    m = table(spark, d, "media_files")
    first = m.groupBy("source_root").agg(F.min("exif_datetime").alias("first"))
    return m.join(first, "source_root").select("file_id", F.coalesce("exif_datetime", "first").alias("taken"))


@query("WITH p AS (SELECT city_id, list_filter(list_transform(string_split(translate(name || '#' || upper(name) || ';' || ascii_name, '#;', ',,'), ','), lambda x: trim(x)), lambda x: x <> '') AS v FROM (SELECT DISTINCT city_id, name, ascii_name FROM cities)), k AS (SELECT city_id, v, list_transform(v, lambda x: lower(x)) AS low FROM p) SELECT city_id, array_to_string(list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_position(low, low[i]) = i THEN v[i] END), lambda x: x IS NOT NULL), '|') AS tags FROM k")
def annotation_tags(spark, d):
    c = table(spark, d, "cities").select("city_id", "name", "ascii_name").distinct()
    typed = F.concat("name", F.lit("#"), F.upper("name"), F.lit(";"), F.col("ascii_name"))
    return c.select("city_id", F.array_join(P.typed_tags(typed), "|").alias("tags"))


@query("SELECT mix_name, source, target_weight FROM (SELECT mix_name, source, target_weight * 2 AS target_weight FROM mix_targets WHERE max_repeats = 4 UNION ALL SELECT mix_name, source, target_weight FROM mix_targets WHERE max_repeats IS DISTINCT FROM 4)")
def keyed_upsert(spark, d):
    t = table(spark, d, "mix_targets").select("mix_name", "source", "target_weight", "max_repeats")
    new = t.where("max_repeats = 4").withColumn("target_weight", F.col("target_weight") * 2)
    return catalog.keyed_upsert(t, new, ["mix_name", "source"]).select("mix_name", "source", "target_weight")


@query("SELECT file_id, 'thumb/v1/' || substr(file_id, 1, 2) || '/' || file_id || '.jpg' AS path FROM media_files")
def asset_paths(spark, d):
    return table(spark, d, "media_files").select("file_id", P.asset_path("thumb", "v1", F.col("file_id")).alias("path"))


@query(f"SELECT source_root, current_path FROM media_files WHERE status NOT IN ('error', 'replaced', 'excluded') AND source_root LIKE '/volumes/nas-home/%'")
def known_paths(spark, d):
    m = table(spark, d, "media_files")
    return m.where(P.active(F.col("status"), ("error", "replaced", "excluded")) & F.startswith("source_root", F.lit("/volumes/nas-home/"))).select("source_root", "current_path")


@query("SELECT current_path, sum(error_count)::BIGINT AS errors, max_by(error_stage, id) AS last_stage FROM scan_observations WHERE status = 'error' GROUP BY 1")
def observation_errors(spark, d):
    o = table(spark, d, "scan_observations").where("status = 'error'")
    return o.groupBy("current_path").agg(F.sum("error_count").alias("errors"), F.max_by("error_stage", "id").alias("last_stage"))


@query(_TAGS + ", g AS (SELECT file_id, string_agg(tag_type || '=' || tag_value, ';' ORDER BY tag_type, tag_value) AS tags FROM (SELECT DISTINCT * FROM t) GROUP BY 1) SELECT m.file_id, m.status, g.tags, coalesce(x.docs, 0) AS docs FROM media_files m LEFT JOIN g USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS docs FROM documents WHERE file_id IS NOT NULL GROUP BY 1) x USING (file_id)")
def media_detail(spark, d):
    g = tags(spark, d).distinct().groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("tag_type", "tag_value"))).alias("g"))
    g = g.select("file_id", F.array_join(F.transform("g", lambda x: F.concat_ws("=", x["tag_type"], x["tag_value"])), ";").alias("tags"))
    x = table(spark, d, "documents").where("file_id is not null").groupBy("file_id").agg(F.count("*").alias("docs"))
    return table(spark, d, "media_files").select("file_id", "status").join(g, "file_id", "left").join(x, "file_id", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))


@query(_GPS + "SELECT DISTINCT l.file_id, k.code FROM l JOIN countries k ON l.lat BETWEEN k.bbox[2] AND k.bbox[4] AND CASE WHEN k.bbox[1] <= k.bbox[3] THEN l.lon BETWEEN k.bbox[1] AND k.bbox[3] ELSE l.lon >= k.bbox[1] OR l.lon <= k.bbox[3] END")
def media_countries(spark, d):
    # positions have numbers here, so that files at one place are looked up once
    g = places.gps(table(spark, d, "media_files"))
    at = g.select("lat", "lon").distinct().withColumn("spot", F.xxhash64("lat", "lon"))
    held = in_regions(at, "spot", "lat", "lon", table(spark, d, "countries"), "code", "bbox")
    return g.join(at, ["lat", "lon"]).join(held, F.col("spot") == F.col("id")).select("file_id", F.col("key").alias("code"))


@query("""
WITH RECURSIVE k AS (SELECT id, min(merged_into_id) AS up FROM people WHERE id IS NOT NULL GROUP BY 1),
s AS (SELECT a.id, b.id AS up FROM k a JOIN k b ON a.up = b.id),
r(id, top) AS (SELECT id, up FROM s UNION SELECT r.id, s.up FROM r JOIN s ON r.top = s.id),
e AS (SELECT id, min(top) AS root FROM r WHERE top NOT IN (SELECT id FROM s) OR top IN (SELECT id FROM r WHERE id = top) GROUP BY 1),
n AS (SELECT id, display_name AS name FROM people UNION SELECT id, unnest(CASE WHEN json_valid(aliases_json) AND json_type(aliases_json) = 'ARRAY' THEN CAST(aliases_json AS VARCHAR[]) ELSE [] END) FROM people),
l AS (SELECT * FROM n WHERE trim(name) <> ''),
h AS (SELECT lower(trim(name)) AS label, arg_min(coalesce(root, id), (up IS NOT NULL, id)) AS person_id FROM l JOIN k USING (id) LEFT JOIN e USING (id) GROUP BY 1)
SELECT w.name, coalesce(h.person_id, -1) AS person_id FROM (SELECT DISTINCT name FROM l UNION SELECT 'nobody at all') w LEFT JOIN h ON lower(trim(w.name)) = h.label
""")
def resolve_labels(spark, d):
    """Every display name and alias, followed through the merges; a cycle of merges stands for its smallest id."""
    p = table(spark, d, "people")
    own = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    labels = p.select("id", F.explode(F.array_append(own, F.col("display_name"))).alias("label")).where("trim(label) <> ''")
    wanted = labels.select(F.col("label").alias("name")).unionByName(spark.createDataFrame([("nobody at all",)], "name string"))
    merged = hierarchy.resolve(p, "id", "merged_into_id").where("linked").select("id", "root_id")
    found = catalog.resolve_labels(labels.where("id is not null"), merged, wanted)
    return found.withColumn("person_id", F.coalesce("person_id", F.lit(-1)))  # -1: to be created


@query("SELECT file_id, CASE WHEN length(s) = 10 THEN CAST(strptime(s, '%Y:%m:%d') AS TIMESTAMP) ELSE CAST(strptime(s, '%Y:%m:%d %H:%M:%S') AS TIMESTAMP) END AS taken FROM (SELECT file_id, CASE WHEN size_bytes % 2 = 0 THEN strftime(exif_datetime, '%Y:%m:%d') ELSE strftime(exif_datetime, '%Y:%m:%d %H:%M:%S') END AS s FROM media_files)")
def camera_times(spark, d):
    said = F.when(F.col("size_bytes") % 2 == 0, F.date_format("exif_datetime", "yyyy:MM:dd")).otherwise(F.date_format("exif_datetime", "yyyy:MM:dd HH:mm:ss"))
    return table(spark, d, "media_files").select("file_id", P.camera_time(said).alias("taken"))


@query(_TAGS + """, c AS (SELECT tag_value AS s, count(*) AS n FROM t WHERE contains(lower(tag_value), 'tri') AND tag_value NOT LIKE 'person-%' GROUP BY 1),
a AS (SELECT s AS suggestion, 0 AS source, CASE WHEN starts_with(lower(s), 'tri') THEN 0 ELSE 1 END AS k1, -n::DOUBLE AS k2 FROM (SELECT * FROM c ORDER BY n DESC, s LIMIT 40)),
l AS (SELECT 'trip ' || user_id AS q, max(ts) AS last_at FROM events WHERE trunc(value) > 0 GROUP BY 1),
b AS (SELECT q, 1, 0, -epoch_us(last_at)::DOUBLE FROM (SELECT * FROM l ORDER BY last_at DESC, q LIMIT 40)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY lower(suggestion) ORDER BY source, k1, k2, suggestion) AS nth FROM u)
SELECT suggestion, source::INTEGER AS source FROM o WHERE nth = 1 ORDER BY source, k1, k2, suggestion LIMIT 10""")
def suggestions(spark, d):
    log = table(spark, d, "events").select(F.concat(F.lit("trip "), F.col("user_id").cast("string")).alias("query"), F.col("value").cast("long").alias("result_count"), F.col("ts").alias("at"))
    return suggest(tags(spark, d), log, "tri", 10)


# --- people ---

@query("SELECT l_orderkey AS file_id, CASE WHEN l_suppkey = 3 THEN 1 ELSE l_suppkey END AS person_id, count(*) AS faces FROM lineitem GROUP BY 1, 2")
def merge_people(spark, d):
    f = faces(spark, d).withColumn("merged_from", F.lit(None).cast("long"))
    return catalog.merge_people(f, 3, 1).groupBy("file_id", "person_id").agg(F.count("*").alias("faces"))


@query("SELECT l_orderkey AS file_id, l_suppkey AS person_id, count(*) AS faces FROM lineitem GROUP BY 1, 2")
def unmerge_roundtrip(spark, d):
    f = faces(spark, d).withColumn("merged_from", F.lit(None).cast("long"))
    return catalog.unmerge_people(catalog.merge_people(f, 3, 1), 3, 1).groupBy("file_id", "person_id").agg(F.count("*").alias("faces"))


@query("WITH w AS (SELECT DISTINCT l_orderkey AS file_id, s_name AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), h AS (SELECT DISTINCT l_orderkey AS file_id, CASE WHEN l_linenumber = 1 THEN s_name ELSE lower(s_name) END AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 2) SELECT file_id, label, 'lacking' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT file_id, label, 'stale' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)")
def label_drift(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    want = f.select(F.col("l_orderkey").alias("file_id"), F.col("s_name").alias("label"))
    have = f.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("file_id"), F.lit("person").alias("tag_type"), F.when(F.col("l_linenumber") == 1, F.col("s_name")).otherwise(F.lower("s_name")).alias("tag_value"))
    return catalog.label_drift(want, have)


_IOU = """
WITH RECURSIVE b AS (SELECT l_orderkey AS file_id, l_linenumber AS id, (l_partkey % 90)::DOUBLE AS x, (l_suppkey % 70)::DOUBLE AS y FROM lineitem),
m AS (SELECT a.file_id, a.id AS old_id, c.id AS new_id, 60 - abs(a.x - c.x - c.id * 3) AS w, 60 - abs(a.y - c.y - 4) AS h FROM b a JOIN b c USING (file_id)),
p AS (SELECT file_id, old_id, new_id, w * h / (7200 - w * h) AS overlap FROM m WHERE w > 0 AND h > 0 AND w * h / (7200 - w * h) >= 0.5),
g(file_id, olds, news, old_id, new_id, overlap) AS (
  SELECT file_id, [old_id], [new_id], old_id, new_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY overlap DESC, old_id, new_id) AS nth FROM p) WHERE nth = 1
  UNION ALL SELECT file_id, list_append(olds, old_id), list_append(news, new_id), old_id, new_id, overlap FROM (
    SELECT p.*, g.olds, g.news, row_number() OVER (PARTITION BY p.file_id ORDER BY p.overlap DESC, p.old_id, p.new_id) AS nth FROM g JOIN p ON g.file_id = p.file_id AND NOT list_contains(g.olds, p.old_id) AND NOT list_contains(g.news, p.new_id)) WHERE nth = 1)
"""


@query(_IOU + "SELECT file_id, old_id, new_id, round(overlap, 9) AS overlap FROM g")
def iou_match(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 90).cast("double").alias("x"), (F.col("l_suppkey") % 70).cast("double").alias("y"), F.lit(60.0).alias("width"), F.lit(60.0).alias("height"))
    moved = b.withColumn("x", F.col("x") + F.col("id") * 3).withColumn("y", F.col("y") + 4)
    return boxes.greedy_match(b, moved).withColumn("overlap", F.round("overlap", 9))


@query(_GPS + ", c AS (SELECT DISTINCT city_id, latitude AS la, longitude AS lo FROM cities WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)), p AS (SELECT file_id, city_id, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2)))) AS km FROM l JOIN c ON la BETWEEN lat - 0.05 AND lat + 0.05), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY km, city_id) AS n FROM p WHERE km <= 2), m AS (SELECT city_id, min(name) AS name FROM cities GROUP BY 1), k AS (SELECT file_id, min(code) AS code FROM l JOIN countries k ON l.lat BETWEEN k.bbox[2] AND k.bbox[4] AND CASE WHEN k.bbox[1] <= k.bbox[3] THEN l.lon BETWEEN k.bbox[1] AND k.bbox[3] ELSE l.lon >= k.bbox[1] OR l.lon <= k.bbox[3] END GROUP BY 1) SELECT l.file_id, coalesce(m.name, k.code, '-') AS name, CASE WHEN m.name IS NOT NULL THEN 'city' WHEN k.code IS NOT NULL THEN 'region' ELSE 'none' END AS how FROM l LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON l.file_id = r.file_id LEFT JOIN m ON r.city_id = m.city_id LEFT JOIN k ON l.file_id = k.file_id")
def place_fallback(spark, d):
    """The city within 2 km, else the country around, else nothing."""
    g = places.gps(table(spark, d, "media_files")).select(F.col("file_id").alias("id"), "lat", "lon")
    c = table(spark, d, "cities")
    found = places.place_names(g, places.places_of(c).join(c.select(F.col("city_id").alias("place_id"), "name").distinct(), "place_id"), table(spark, d, "countries"), 2.0)
    return found.select(F.col("id").alias("file_id"), F.coalesce("name", F.lit("-")).alias("name"), "how")


@query("""WITH c AS (SELECT DISTINCT city_id, latitude AS la, longitude AS lo FROM cities WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)),
b AS (SELECT code, bbox[1] AS x1, bbox[2] AS y1, bbox[3] AS x2, bbox[4] AS y2 FROM countries WHERE bbox IS NOT NULL AND bbox[1] < bbox[3])
SELECT DISTINCT city_id, code FROM c JOIN b ON abs(lo - (x1 + x2) / 2) / ((x2 - x1) / 2) + abs(la - (y1 + y2) / 2) / ((y2 - y1) / 2) <= 1
AND NOT (abs(lo - (x1 + x2) / 2) < (x2 - x1) / 8 AND abs(la - (y1 + y2) / 2) < (y2 - y1) / 8)""")
def cities_in_polygons(spark, d):
    """Cities in the diamond of each country's box, without a box around its middle: polygons with holes."""
    b = table(spark, d, "countries").where("bbox is not null and bbox[0] < bbox[2]").select("code", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    x, y, w, h = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, (F.col("x2") - F.col("x1")) / 8, (F.col("y2") - F.col("y1")) / 8
    outer = F.array(F.array(F.col("x1"), y), F.array(x, F.col("y1")), F.array(F.col("x2"), y), F.array(x, F.col("y2")))
    hole = F.array(F.array(x - w, y - h), F.array(x + w, y - h), F.array(x + w, y + h), F.array(x - w, y + h))
    rings = b.select("code", F.lit(0).alias("part"), F.posexplode(F.array(outer, hole)).alias("ring", "points"))
    return in_polygons(table(spark, d, "cities"), "city_id", "latitude", "longitude", rings).select(F.col("id").alias("city_id"), F.col("key").alias("code"))


# --- rules of people, passes and upkeep ---

_PEOPLE = "WITH c AS (SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'person-' || s_suppkey END AS name, count(l_orderkey) AS faces, count(DISTINCT l_orderkey) AS files FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) ON s_suppkey = l_suppkey GROUP BY 1, 2) "


def _people(spark, d):
    f = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("person_id"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("person-"), "s_suppkey"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), name.alias("name"))
    return s.join(f, "person_id", "left").groupBy("person_id", "name").agg(F.count("file_id").alias("faces"), F.countDistinct("file_id").alias("files"))


@query(_PEOPLE + "SELECT person_id, faces, files, name NOT LIKE 'person-%' OR files > 10 OR faces > 10 AS shown FROM c WHERE faces > 0")
def people_shown(spark, d):
    return catalog.shown_people(_people(spark, d)).select("person_id", "faces", "files", "shown")


@query(_PEOPLE + "SELECT count(*) AS hidden, coalesce(sum(faces), 0)::BIGINT AS faces FROM c WHERE faces > 0 AND name LIKE 'person-%' AND files <= 10 AND faces <= 10")
def people_hidden(spark, d):
    return catalog.shown_people(_people(spark, d)).where("not shown").agg(F.count("*").alias("hidden"), F.coalesce(F.sum("faces"), F.lit(0)).alias("faces"))


@query(_PEOPLE + "SELECT person_id, faces FROM c WHERE faces >= 5 OR faces > 0 AND name NOT LIKE 'person-%'")
def people_five_or_named(spark, d):
    return _people(spark, d).where((F.col("faces") >= 5) | (F.col("faces") > 0) & ~F.col("name").like("person-%")).select("person_id", "faces")


@query("WITH t AS (SELECT count(*) FILTER (media_kind = 'image') AS n, count(*) FILTER (status = 'analysis_done') AS done, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status IN ('missing', 'replaced', 'excluded')) AS gone FROM media_files) SELECT n AS images, done, failed, greatest(0, n - done - failed - gone) AS waiting, greatest(0, n - gone) AS visible, greatest(0, done - gone) AS usable FROM t")
def analysis_floors(spark, d):
    s = F.col("status")
    t = table(spark, d, "media_files").agg(F.count_if(F.col("media_kind") == "image").alias("images"), F.count_if(s == "analysis_done").alias("done"), F.count_if(s == "error").alias("failed"), F.count_if(s.isin(*P.HIDDEN)).alias("gone"))
    floor = lambda c: F.greatest(F.lit(0), c)
    return t.select("images", "done", "failed", floor(F.col("images") - F.col("done") - F.col("failed") - F.col("gone")).alias("waiting"), floor(F.col("images") - F.col("gone")).alias("visible"), floor(F.col("done") - F.col("gone")).alias("usable"))


@query("SELECT * FROM (VALUES ('hybrid', 1::BIGINT, 1::BIGINT), ('ocr', 3::BIGINT, 3::BIGINT), ('semantic', 9::BIGINT, 9::BIGINT)) v(mode, queries, passed) UNION ALL SELECT 'mixed mode', 1, 1")
def benchmark_summary(spark, d):
    """Canned queries by the mode they should lead to, and how many do: counts of passes and failures."""
    wanted = {"screenshot of chat": "hybrid", "at least 4 people in april 2 years ago": "mixed mode", "receipt from yesterday": "ocr", "bridge last year without receipt weekend": "ocr", "invoice 2023-04": "ocr"}
    rows = [(wanted.get(r[0], "semantic"), r[3] == {"mixed mode": "hybrid"}.get(wanted.get(r[0]), wanted.get(r[0], "semantic"))) for r in _plans()]
    return spark.createDataFrame(rows, "mode string, ok boolean").groupBy("mode").agg(F.count("*").alias("queries"), F.count_if("ok").alias("passed"))


_PASS = """WITH o AS (SELECT file_id, current_path AS old_path FROM media_files WHERE updated_at < TIMESTAMP '2021-01-01'),
n AS (SELECT file_id, CASE WHEN size_bytes % 7 = 0 THEN current_path || '.moved' ELSE current_path END AS new_path FROM media_files WHERE updated_at >= TIMESTAMP '2019-01-01'),
j AS (SELECT old_path, new_path FROM o FULL JOIN n ON o.file_id = n.file_id) """


@query(_PASS + """SELECT (SELECT count(*) FROM scan_observations) AS scanned, count(*) FILTER (old_path IS NULL) AS created, count(*) FILTER (old_path IS NOT NULL AND new_path IS NOT NULL) AS updated, count(*) FILTER (old_path <> new_path) AS moved,
(SELECT count(*) FROM media_files WHERE status = 'missing') AS missing, (SELECT count(*) FROM scan_observations WHERE status = 'error') AS failed FROM j""")
def pass_counters(spark, d):
    m, o = table(spark, d, "media_files"), table(spark, d, "scan_observations").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad")).first()
    return catalog.pass_counters(upsert_rows(spark, d), o.n, o.bad, m.where("status = 'missing'").count())


@query(_TAGS + ", r AS (SELECT m.file_id, max((lower(tag_value) = 'jpg')::INT) AS a, max((tag_type = 'auto_object')::INT) AS b, max((tag_type = 'custom')::INT) AS c, any_value(exif_datetime) AS seen FROM t JOIN media_files m ON t.file_id = m.file_id WHERE lower(tag_value) IN ('jpg', 'image', 'usb-blue') GROUP BY 1) SELECT file_id FROM r ORDER BY a DESC, b DESC, c DESC, seen DESC NULLS LAST, file_id LIMIT 50")
def tag_priority_order(spark, d):
    t = tags(spark, d).where(F.lower("tag_value").isin("jpg", "image", "usb-blue"))
    by = t.groupBy("file_id").agg(F.max(F.lower("tag_value") == "jpg").alias("a"), F.max(F.col("tag_type") == "auto_object").alias("b"), F.max(F.col("tag_type") == "custom").alias("c"))
    m = table(spark, d, "media_files").select("file_id", "exif_datetime")
    return ranking.top(by.join(m, "file_id"), 50, F.desc("a"), F.desc("b"), F.desc("c"), F.desc_nulls_last("exif_datetime"), F.col("file_id")).select("file_id")


@query("SELECT o_orderkey AS file_id, count(l_orderkey) AS faces FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate ORDER BY faces DESC, (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def hint_order(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), "o_orderpriority", "o_orderdate")
    rows = o.join(faces(spark, d).groupBy("file_id").agg(F.count("*").alias("faces")), "file_id", "left").withColumn("faces", F.coalesce("faces", F.lit(0)))
    return ranking.top(rows, 50, F.desc("faces"), F.desc(F.col("o_orderpriority") == "1-URGENT"), F.desc_nulls_last("o_orderdate"), F.col("file_id")).select("file_id", "faces")


_ONE = "SELECT doc_id AS id, -(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = '{0}')) AS tf FROM t), (SELECT count(*) AS n, avg(len(w)) AS mean, count(*) FILTER (list_contains(w, '{0}')) AS df FROM t) WHERE tf > 0"


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z가-힣_]+') AS w FROM documents) SELECT id AS doc_id, round(min(score), 6) AS score FROM (" + _ONE.format("river") + " UNION ALL " + _ONE.format("album") + ") GROUP BY 1")
def index_union_min(spark, d):
    docs = table(spark, d, "documents")
    found = text.best_of(*[text.bm25(docs, "doc_id", "text", [w]) for w in ("river", "album")])
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT file_id, 'place' AS k, lower(media_kind) AS v FROM media_files) SELECT file_id FROM media_files WHERE 'place=' || CASE WHEN size_bytes % 5 = 0 THEN upper(media_kind) ELSE media_kind END <> 'place=' || media_kind")
def tag_set_changed(spark, d):
    m = table(spark, d, "media_files").where("media_kind is not null").dropDuplicates(["file_id"])
    old = m.select("file_id", F.lit("place").alias("tag_type"), F.col("media_kind").alias("tag_value"))
    new = m.select("file_id", F.lit("place").alias("tag_type"), F.when(F.col("size_bytes") % 5 == 0, F.upper("media_kind")).otherwise(F.col("media_kind")).alias("tag_value"))
    return catalog.unlike_tag_sets(old.unionByName(old), new)


@query(_TAGS + " SELECT DISTINCT file_id, tag_type, CASE WHEN tag_type = 'custom' AND tag_value = 'jpg' THEN 'JPG' ELSE trim(tag_value) END AS tag_value FROM t")
def tags_refreshed(spark, d):
    t = tags(spark, d)
    new = t.where("tag_type = 'custom'").withColumn("tag_value", F.when(F.col("tag_value") == "jpg", "JPG").otherwise(F.col("tag_value")))
    return catalog.refresh_tags(t, new, ("custom",)).distinct()


@query("SELECT DISTINCT id FROM people WHERE merged_into_id IS NULL AND length(display_name) >= 2 AND (contains(lower(display_name), 'frederick') OR contains('frederick', lower(display_name)) OR contains(lower(display_name), 'una') OR contains('una', lower(display_name)))")
def person_resolution(spark, d):
    return resolve_people(table(spark, d, "people").withColumnRenamed("display_name", "label"), ["Frederick", "Una"])


@query("WITH w AS (SELECT s_suppkey FROM supplier WHERE length(s_name) >= 2 AND contains(lower(s_name), '00005')) SELECT l_orderkey AS file_id, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM w) GROUP BY 1, 2 ORDER BY o_orderdate DESC NULLS LAST, file_id LIMIT 160")
def tagged_results(spark, d):
    """A name in the query leads to the files that show the persons, in the place of files with the name as a tag."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit(None).cast("long").alias("merged_into_id"))
    ids = resolve_people(p, ["00005"]).withColumnRenamed("id", "person_id")
    shown = faces(spark, d).join(ids, "person_id", "left_semi").select("file_id").distinct()
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), "o_orderdate")
    return ranking.top(shown.join(o, "file_id"), 160, F.desc_nulls_last("o_orderdate"), F.col("file_id"))


@query(f"WITH n AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR.format(7)}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 40) SELECT vec_id, round(greatest(0, d), 6) AS distance FROM n WHERE label IN (1, 2, 3) ORDER BY d, vec_id LIMIT 10")
def vector_over_fetch(spark, d):
    rows = vectors.over_fetch(table(spark, d, "embeddings"), "vec_id", "embedding", _vector(spark, d, 7), 10, F.col("label").isin(1, 2, 3), 4)
    return rows.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(_CHANNELS + "SELECT id, 'channels' AS stage, round(raw / max(raw) OVER (), 6) AS delta FROM f UNION ALL SELECT id, 'text', 0.22 FROM f JOIN documents ON id = doc_id WHERE contains(lower(text), 'old bridge') UNION ALL SELECT id, 'lang', 0.08 FROM f JOIN documents ON id = doc_id WHERE lang = 'de'")
def score_breakdown(spark, d):
    """What made up each score: a row for each stage that changed it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    rows = ranking.fuse(_channels(spark, d), ranking.weights("mixed")).join(docs, "id")
    rows = ranking.explained(rows, {"text": F.when(P.contains_ci(F.col("text"), "old bridge"), 0.22), "lang": F.when(F.col("lang") == "de", 0.08)})
    return rows.select("id", F.inline("parts")).withColumn("delta", F.round("delta", 6))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z가-힣_]+') AS w FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS times FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1")
def index_rebuild(spark, d):
    """The stored text index, written anew: how many documents have each term, and how often."""
    index = text.TextIndex(spark, f"{shared_folder(spark)}/shutterloom/index-{uuid.uuid4().hex}")
    index.rebuild(table(spark, d, "documents"), "doc_id", "text")
    found = cut_lineage(index.postings().groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("times")))
    remove(spark, index.path)
    return found


@query("""SELECT dir, max(new) AS mtime_ns FROM (
SELECT dir, CASE WHEN bad > 0 THEN -1 ELSE m END AS new FROM (SELECT regexp_extract(current_path, '^(.*)/', 1) AS dir, max(mtime_ns) AS m, count(*) FILTER (status <> 'ready' OR status IS NULL) AS bad FROM scan_observations WHERE current_path IS NOT NULL GROUP BY 1)
UNION ALL SELECT dir, m FROM (SELECT regexp_extract(current_path, '^(.*)/', 1) AS dir, max(mtime_ns) AS m FROM media_files WHERE current_path IS NOT NULL GROUP BY 1) WHERE dir NOT IN (SELECT regexp_extract(current_path, '^(.*)/', 1) FROM scan_observations WHERE current_path IS NOT NULL)) GROUP BY 1""")
def scan_cache(spark, d):
    o = table(spark, d, "scan_observations").where("current_path is not null").withColumn("dir", F.regexp_extract("current_path", "^(.*)/", 1))
    cache = table(spark, d, "media_files").where("current_path is not null").groupBy(F.regexp_extract("current_path", "^(.*)/", 1).alias("dir")).agg(F.max("mtime_ns").alias("mtime_ns"))
    return catalog.saved_dirs(cache, o.groupBy("dir").agg(F.max("mtime_ns").alias("mtime_ns")), o.select("dir", "status"))


@query("SELECT l_orderkey AS file_id, l_linenumber AS face_id, CASE WHEN l_linenumber = 1 AND l_suppkey = 3 THEN 99 WHEN l_linenumber = 2 AND l_suppkey = 5 THEN -1 ELSE l_suppkey END AS person_id FROM lineitem")
def faces_assigned(spark, d):
    key = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("face_id")
    f = table(spark, d, "lineitem").select(key, F.col("l_suppkey").cast("long").alias("person_id"), F.lit(None).cast("long").alias("merged_from"))
    n = F.col("face_id.l_linenumber")
    chosen = f.where((n == 1) & (F.col("person_id") == 3) | (n == 2) & (F.col("person_id") == 5)).select("face_id", F.when(F.col("person_id") == 3, F.lit(99)).cast("long").alias("to"))
    return catalog.assign_faces(f, chosen.unionByName(chosen)).select(F.col("face_id.l_orderkey").alias("file_id"), F.col("face_id.l_linenumber").alias("face_id"), F.coalesce("person_id", F.lit(-1)).alias("person_id"))


@query("WITH p AS (SELECT DISTINCT l_orderkey AS file_id, l_suppkey AS person_id FROM lineitem) SELECT file_id, person_id, false AS by_hand FROM p WHERE person_id <> 2 UNION ALL SELECT DISTINCT file_id, 1, true FROM p WHERE person_id = 2 AND file_id NOT IN (SELECT file_id FROM p WHERE person_id = 1)")
def people_edited(spark, d):
    p = faces(spark, d).distinct().withColumn("by_hand", F.lit(False))
    two = p.where("person_id = 2")
    return catalog.remove_person(catalog.add_person(p, two.withColumn("person_id", F.lit(1).cast(p.schema["person_id"].dataType))), two)


@query("SELECT DISTINCT l_orderkey AS file_id, 'person' AS tag_type, s_name AS tag_value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT DISTINCT l_orderkey, 'place', 'x' FROM lineitem WHERE l_linenumber = 3")
def labels_filled(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    want = f.select(F.col("l_orderkey").alias("file_id"), F.col("s_name").alias("label"))
    have = f.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("file_id"), F.lit("person").alias("tag_type"), F.when(F.col("l_linenumber") == 1, F.col("s_name")).otherwise(F.lower("s_name")).alias("tag_value")).distinct()
    have = have.unionByName(f.where("l_linenumber = 3").select(F.col("l_orderkey").alias("file_id"), F.lit("place").alias("tag_type"), F.lit("x").alias("tag_value")).distinct())
    return catalog.fill_labels(want, have)


@query("SELECT file_id, CASE WHEN status <> 'missing' THEN current_path ELSE 'thumb/' || file_id END AS source FROM media_files WHERE NOT (size_bytes % 3 = 0 AND mtime_ns % 2 = 0) OR size_bytes IS NULL OR mtime_ns IS NULL")
def vector_work(spark, d):
    m = table(spark, d, "media_files")
    files = m.select("file_id", F.when(F.col("status") != "missing", F.col("current_path")).alias("original"), F.concat(F.lit("thumb/"), "file_id").alias("thumbnail"))
    held = m.where("size_bytes % 3 = 0").select("file_id", F.lit("clip").alias("model"), F.when(F.col("mtime_ns") % 2 == 0, "v2").otherwise("v1").alias("version"))
    return catalog.vector_work(files, held, "clip", "v2")


@query("SELECT doc_id, text AS lines FROM documents WHERE text IS NOT NULL AND trim(text) = text AND text <> '' AND NOT regexp_matches(text, '[\n\r\t]|  ') AND regexp_full_match(text, '[ -~]*')")
def lines_merged(spark, d):
    rows = table(spark, d, "documents").where("text is not null and trim(text) = text and text <> ''").where(~F.col("text").rlike("[\n\r\t]|  ") & F.col("text").rlike("^[ -~]*$"))
    return rows.select("doc_id", catalog.merge_lines(F.concat("text", F.lit("\n")), F.upper("text")).alias("lines"))


@query("WITH j AS (SELECT event_id AS job_id, CASE WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status, ts AS beat_at FROM events), n AS (SELECT max(ts) AS now FROM events), o AS (SELECT min(job_id) AS one FROM j, n WHERE status = 'running' AND beat_at > now - INTERVAL 300 SECOND) SELECT job_id, CASE WHEN status <> 'running' THEN status WHEN NOT beat_at > now - INTERVAL 300 SECOND THEN 'canceled' WHEN job_id = one THEN 'running' ELSE 'queued' END AS settled FROM j, n, o")
def jobs_settled(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    jobs = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("beat_at"))
    return catalog.settle_jobs(jobs, F.lit(now).cast("timestamp_ntz")).select("job_id", "settled")


# --- events ---

@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return sync.event_windows(table(spark, d, "events"), "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, n")
def events_session(spark, d):
    rows = sync.event_sessions(table(spark, d, "events"))
    return rows.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


# --- natural-language search ---

def library(spark: SparkSession, d: str) -> DataFrame:
    """documents as a searchable library: language, source and kind are tags, the update time is the capture time."""
    kinds = F.array(_tag("custom", F.col("doc_kind")), _tag("place", F.col("source")), _tag("auto", F.col("lang")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("updated_at").alias("taken"), F.filter(kinds, lambda t: t["tag_value"].isNotNull()).alias("tags"), F.lit(None).cast("long").alias("people"))


TODAY = date(2024, 6, 1)


def _nl_sql(words: str, tokens: list[str], where: str, keep: int, text_bonus: float, place: str | None = None, dated: bool = False) -> str:
    """A search whose only channel is the full text, ranked by BM25: what the planner makes of words and conditions is
    stated here by hand."""
    every = " AND ".join(f"contains(low, '{w}')" for w in words.split())
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(tokens))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(tokens)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(tokens)))
    some = " + ".join(f"tf{i}" for i in range(len(tokens)))
    at_place = f"0.08 * (contains(lower(coalesce(source, '')), '{place}'))::INT" if place else "0"
    phrase = "1" if " " in words else "0"
    return f"""
WITH t AS (SELECT doc_id AS id, text, lower(coalesce(text, '')) AS low, updated_at AS taken, source, lang, doc_kind, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z가-힣_]+') AS w FROM documents),
f AS (SELECT *, len(w) AS len, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM f),
b AS (SELECT f.*, -({score}) AS bm25 FROM f, s WHERE ({some}) > 0 AND {where}),
k AS (SELECT *, row_number() OVER (ORDER BY bm25, taken DESC NULLS LAST, id) AS rank FROM b),
h AS (SELECT *, 1.0 / (60 + rank) AS raw FROM k WHERE rank <= {keep}),
c AS (SELECT id, taken, (contains(low, '{words}'))::INT * {phrase} AS phrase, least(1, raw / max(raw) OVER () + CASE WHEN contains(low, '{words}') THEN 0.22 WHEN {every} THEN {text_bonus} ELSE 0 END + {at_place} + {0.08 if dated else 0}) AS score FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY phrase DESC, score DESC, id) AS pos FROM c),
u AS (SELECT *, epoch_us(taken) // 3000000 AS cell FROM p),
v AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, pos) AS nth, min(pos) OVER (PARTITION BY cell) AS first FROM u WHERE taken IS NOT NULL),
x AS (SELECT id, taken, score, first AS pos FROM v WHERE nth = 1 UNION ALL SELECT id, taken, score, pos FROM u WHERE taken IS NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY CAST(taken AS DATE) ORDER BY pos, id) AS day FROM x)
SELECT id, round(score, 6) AS score, 'shadow' AS reason FROM y WHERE day <= 5 OR taken IS NULL ORDER BY pos, id LIMIT 20"""


def _answer(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("score", 6).alias("score"), "reason")


@query(_nl_sql("old bridge near the river", ["old", "bridge", "near", "the", "river"], "true", 20, 0.12, "river"))
def nl_search_flagship(spark, d):
    return _answer(search(library(spark, d), "old bridge near the river", TODAY, {}, limit=20))


@query(_nl_sql("old bridge near the river", ["old", "bridge", "near", "the", "river"], "true", 20, 0.12, "river"))
def nl_search_indexed(spark, d):
    """The same search where the words' counts come from a stored index."""
    index = text.TextIndex(spark, f"{shared_folder(spark)}/shutterloom/index-{uuid.uuid4().hex}")
    index.rebuild(table(spark, d, "documents"), "doc_id", "text")
    found = _answer(search(library(spark, d), "old bridge near the river", TODAY, {}, limit=20, index=index))
    remove(spark, index.path)
    return found


@query(_nl_sql("bridge", ["bridge"], "taken >= TIMESTAMP '2023-01-01' AND taken < TIMESTAMP '2024-01-01' AND isodow(taken) IN (6, 7) AND NOT contains(low, 'receipt') AND lower(coalesce(doc_kind, '')) <> 'receipt' AND lower(coalesce(source, '')) <> 'receipt'", 80, 0.22, dated=True))
def nl_hard_filters(spark, d):
    """A search with a date, an exclusion and a weekend in its plan."""
    return _answer(search(library(spark, d), "bridge last year without receipt weekend", TODAY, {}, limit=20))


@query("""
WITH h AS (SELECT doc_id AS id, updated_at AS taken, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, doc_id) AS rank, lower(coalesce(text, '')) AS low, lower(source) = 'postcards' AS there
  FROM documents WHERE lower(source) = 'postcards' OR lower(doc_kind) = 'postcards' OR lower(lang) = 'postcards'),
c AS (SELECT id, least(1, 61 / (60 + rank) + 0.9 + CASE WHEN contains(low, 'postcards') THEN 0.22 ELSE 0 END + CASE WHEN there THEN 0.08 ELSE 0 END) AS score FROM h WHERE rank <= 20)
SELECT id, round(score, 6) AS score, 'shadow' AS reason, 'postcards' AS used FROM c""")
def nl_fallback(spark, d):
    """Nothing has the words, so the tag most like them is asked for."""
    found = search(library(spark, d), "postcardz", TODAY, {"place": {"postcards"}}, limit=20)
    return found.select("id", F.round("score", 6).alias("score"), "reason", "used")


_ASKED = [
    "beach last summer", "receipt from yesterday", "three people at the park", "여행 사진 작년", "screenshot of chat", "sunset without people", "birthday party weekend",
    "notebook is not far from market", "bridge last year without receipt weekend", "winter 2021 at the museum", "강아지 없는 공원 오전", "at least 4 people in april 2 years ago", "newest family photos weekday evening", "invoice 2023-04",
]


@query("""SELECT query, keywords, intent, mode, reason, first, last, excluded, daypart, weekdays, needs, fewest::INTEGER AS fewest FROM (VALUES
('beach last summer', 'beach', 'visual', 'semantic', 'planner-visual', '2024-06-01', '2024-08-31', '', '-', '', '', -1),
('receipt from yesterday', 'receipt from', 'mixed', 'ocr', 'auto-text-hint', '2024-05-31', '2024-05-31', '', '-', '', '', -1),
('three people at the park', 'three people at the park', 'visual', 'semantic', 'auto-face', '1900-01-01', '1900-01-01', '', '-', '', '', 3),
('여행 사진 작년', '여행 사진', 'visual', 'semantic', 'auto-travel', '2023-01-01', '2023-12-31', '', '-', '', '', -1),
('screenshot of chat', 'screenshot of chat', 'hybrid', 'hybrid', 'fallback', '1900-01-01', '1900-01-01', '', '-', '', '', -1),
('sunset without people', 'sunset', 'visual', 'semantic', 'auto-face', '1900-01-01', '1900-01-01', 'people', '-', '', '', -1),
('birthday party weekend', 'birthday party', 'visual', 'semantic', 'auto-celebration', '1900-01-01', '1900-01-01', '', '-', '5,6', '', -1),
('notebook is not far from market', 'notebook is not far from market', 'visual', 'semantic', 'planner-visual', '1900-01-01', '1900-01-01', '', '-', '', '', -1),
('bridge last year without receipt weekend', 'bridge', 'visual', 'ocr', 'auto-text-hint', '2023-01-01', '2023-12-31', 'receipt', '-', '5,6', '', -1),
('winter 2021 at the museum', 'at the museum', 'visual', 'semantic', 'planner-visual', '2020-12-01', '2021-02-28', '', '-', '', 'place', -1),
('강아지 없는 공원 오전', '공원', 'visual', 'semantic', 'planner-visual', '1900-01-01', '1900-01-01', '강아지', 'morning', '', '', -1),
('at least 4 people in april 2 years ago', 'at least 4 people in 2', 'visual', 'hybrid', 'auto-mixed', '2022-04-01', '2022-04-30', '', '-', '', '', 4),
('newest family photos weekday evening', 'family photos', 'visual', 'semantic', 'auto-face', '2024-05-02', '2024-06-01', '', 'evening', '0,1,2,3,4', '', -1),
('invoice 2023-04', 'invoice 04', 'mixed', 'ocr', 'auto-text-hint', '2023-01-01', '2023-12-31', '', '-', '', '', -1)
) v(query, keywords, intent, mode, reason, first, last, excluded, daypart, weekdays, needs, fewest)""")
def query_plans(spark, d):
    """The planner over canned queries; what SQL expects of each is written out by hand."""
    return spark.createDataFrame(_plans(), "query string, keywords string, intent string, mode string, reason string, first string, last string, excluded string, daypart string, weekdays string, needs string, fewest int")


def _plans() -> list[tuple]:
    rows = []
    for q in _ASKED:
        p = planner.make(q, TODAY)
        never = date(1900, 1, 1)
        rows.append((q, p.keywords, p.intent, *planner.route(p), *(x.isoformat() for x in p.days or (never, never)), ",".join(p.excluded), p.daypart or "-", ",".join(map(str, p.weekdays)), ",".join(sorted(p.needs)), -1 if p.faces[0] is None else p.faces[0]))
    return rows


@query("""WITH t AS (SELECT DISTINCT role, tag FROM (SELECT 'place' AS role, source AS tag FROM documents UNION ALL SELECT 'visual', doc_kind FROM documents UNION ALL SELECT 'visual', lang FROM documents) WHERE length(tag) >= 2),
o AS (SELECT role, tag FROM t WHERE contains('letters from the old travel album', lower(tag))),
p AS (SELECT role, min(tag) AS tag FROM t JOIN (VALUES ('letters'), ('travel'), ('album')) w(token) ON contains(lower(tag), token) AND lower(tag) <> token GROUP BY role, token)
SELECT role, tag FROM o UNION SELECT role, tag FROM p""")
def query_vocabulary(spark, d):
    """The library's own tags that a query names, by role."""
    found = vocabulary(library(spark, d), "letters from the old travel album")
    return spark.createDataFrame(sorted((r, t) for r, ts in found.items() for t in ts), "role string, tag string")
