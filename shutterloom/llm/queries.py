"""Queries of the training-data operators over the catalogue tables, with SQL counterparts where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import glyphs, history, leakage, mixing, names, neighbours, readability
from shutterloom.session import remove, scratch
from shutterloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    with scratch() as keep:
        near = keep(neighbours.top_similar(table(spark, d, "person_centroids"), "person_id", "centroid", k=10, min_similarity=0.85))
    return near.select(F.least("id", "neighbour_id").alias("person_id_a"), F.greatest("id", "neighbour_id").alias("person_id_b")).distinct()


def p1_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar to each person whose id is divisible by 100, among all."""
    with scratch() as keep:
        near = keep(neighbours.top_similar(table(spark, d, "person_centroids"), "person_id", "centroid", k=10, only="id % 100 = 0", probes=None, beam=200))
    return near.select(F.col("id").alias("person_id"), "neighbour_id", F.round("similarity", 6).alias("similarity"), "place")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_pairs(table(spark, d, "people"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each row that names somebody, with the smallest id of its entity."""
    with scratch() as keep:
        e = keep(names.entities(table(spark, d, "people")))
    least = e.groupBy("entity").agg(F.min("id").alias("entity_id"), F.count("*").alias("spelled_by"))
    return e.join(least, "entity").select("id", "entity_id", "spelled_by")


def p2_same_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p2_found whose display names are one plain spelling of two words, without regard to case."""
    name = F.lower("display_name")
    plain = table(spark, d, "people").where(name.rlike("^[a-z]{3,} [a-z]{8,}$") & ~name.rlike("^(uncle|aunt|auntie|cousin|coach|the|prof|capt|unknown|unnamed|person) ")).select("id", name.alias("name")).distinct()
    pairs = names.same_pairs(table(spark, d, "people"))
    a, b = plain.select(F.col("id").alias("id_a"), "name"), plain.select(F.col("id").alias("id_b"), F.col("name").alias("name_b"))
    return pairs.join(a, "id_a").join(b, "id_b").where("name = name_b").select("id_a", "id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.same_looking(table(spark, d, "scan_observations"), table(spark, d, "media_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "incoming_media"), table(spark, d, "media_files"))


def p6_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """For each batch in order, worked against the store of all before it and appended: how many of its rows are known."""
    store = history.temporary_store(spark, table(spark, d, "media_files"))
    found = history.accept(table(spark, d, "incoming_media"), store)
    remove(spark, store.path)
    return found.groupBy("batch_no").agg(F.count("*").alias("known"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose digest starts within 500 of an earlier record's, as four 16-bit numbers under the Manhattan metric."""
    return history.repeats(table(spark, d, "incoming_media"), table(spark, d, "media_files"), radius=500)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents"), table(spark, d, "eval_items"), answer_col="answer").select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """For each test item that leaked: in how many documents, and the largest share of its words carried."""
    found = leakage.find(table(spark, d, "documents"), table(spark, d, "eval_items"), answer_col="answer")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("word_share"), 6).alias("largest_share"))


def p7_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p7_found whose document has the item's whole text, of over 100 characters, letter by letter."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", F.col("text").alias("item_text"))
    found = p7_found(spark, d).join(docs, "doc_id").join(items, "item_id")
    return found.where(F.contains("text", "item_text") & (F.length("item_text") > 100)).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), mixing.HELD)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"), mixing.HELD)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The report of the same mixes where sizes are characters."""
    rows = mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"), mixing.HELD, size_col="n_chars")
    return rows.select("mix_name", "source", "target_share", "actual_share", "held_tokens", "held_docs", "selected_tokens", "selected_docs", "most_repeats")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_words(spark: SparkSession, d: str) -> DataFrame:
    """How many words each document without markup has."""
    rows = readability.measures(table(spark, d, "documents").where("text is not null and not text rlike '[<&]'"))
    return rows.select("doc_id", F.col("words").cast("long").alias("words"))


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    """The grades that formulas are fitted on: the median of the possible ones of each document."""
    return readability.clean_labels(table(spark, d, "reading_labels"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by language and whole grade: documents and words."""
    levels = p9_levels(spark, d)
    return levels.groupBy("language", F.floor("grade").alias("grade_from")).agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


def _hex_sql(column: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace({column}, '\s+', '', 'g'), '^(?i:(?:sha|md|blake)[-_]?[0-9a-z]{{1,4}}[:=])', ''), '^0x([0-9a-fA-F]+)$', '\1')"
    plain = f"lower(regexp_replace({bare}, '[:-]', '', 'g'))"
    coded = f"lower(hex(from_base64(rpad(translate({bare}, '-_', '+/'), 43, '=') || '=')))"
    found = (
        f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{16,}}') THEN {plain}"
        f" WHEN regexp_full_match({bare}, '[A-Za-z0-9+/_-]{{43}}=?') THEN {coded} END"
    )
    return f"list_transform([{found}], lambda h: CASE WHEN replace(h, h[1], '') <> '' THEN h END)[1]"


_P6_KEYS = f"""
WITH rows_in AS (SELECT batch_no, incoming_id, size_bytes, content_hash, partial_hash FROM incoming_media
    WHERE batch_no IS NOT NULL AND incoming_id IS NOT NULL AND size_bytes > 0
  UNION SELECT -2147483648, 0, size_bytes, content_hash, partial_hash FROM media_files WHERE size_bytes > 0),
keys AS (SELECT batch_no, incoming_id, 'content' AS kind, 0 AS size, {_hex_sql("content_hash")} AS h FROM rows_in
  UNION SELECT batch_no, incoming_id, 'partial', size_bytes, {_hex_sql("partial_hash")} FROM rows_in)
"""
_EARLIER = "a.batch_no > -2147483648 AND (b.batch_no < a.batch_no OR b.batch_no = a.batch_no AND b.incoming_id < a.incoming_id)"
_P6 = f"""SELECT DISTINCT a.batch_no, a.incoming_id FROM keys a JOIN keys b ON a.kind = b.kind AND a.size = b.size
  AND a.h[1:16] = b.h[1:16] AND (starts_with(a.h, b.h) OR starts_with(b.h, a.h)) WHERE {_EARLIER}"""
_WORDS = ", ".join(f"CAST('0x' || h[{4 * k + 1}:{4 * k + 4}] AS INTEGER) AS w{k}" for k in range(4))
_P6_NEAR = f""", points AS (SELECT *, {_WORDS} FROM keys WHERE h IS NOT NULL)
SELECT DISTINCT a.batch_no, a.incoming_id FROM points a JOIN points b ON a.kind = b.kind AND a.size = b.size AND b.w0 BETWEEN a.w0 - 500 AND a.w0 + 500
WHERE {" + ".join(f"abs(a.w{k} - b.w{k})" for k in range(4))} <= 500 AND {_EARLIER}"""

# written apart from the operator: characters are judged one by one by their code points, and composed at the end
_LOOK = ("АВЕКМНОРСТУХЅІЈасеорхуѕіјһӏԁԝԛɡɑΑΒΕΖΗΙΚΜΝΟΡΤΥΧον‐‑‒−", "ABEKMHOPCTYXSIJaceopxysijhldwqgaABEZHIKMNOPTYXov----")
_P4_FORM = f"""nfc_normalize(array_to_string(list_transform(string_split(p, ''), lambda c: CASE
  WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)
  WHEN unicode(c) IN (9, 10, 11, 12, 13, 133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '
  WHEN unicode(c) IN (173, 847, 1564, 8288, 65279) OR unicode(c) BETWEEN 8203 AND 8207 OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 65024 AND 65039 THEN ''
  WHEN unicode(c) BETWEEN 64256 AND 64260 THEN ['ff', 'fi', 'fl', 'ffi', 'ffl'][unicode(c) - 64255]
  WHEN unicode(c) = 8230 THEN '...' ELSE translate(c, '{_LOOK[0]}', '{_LOOK[1]}') END), ''))"""
_P4 = f"""
WITH o AS (SELECT id, p, CASE WHEN regexp_full_match(p, '[ -~]*') THEN p ELSE {_P4_FORM} END AS form FROM (SELECT id, current_path AS p FROM scan_observations WHERE current_path IS NOT NULL)),
f AS (SELECT file_id, filename, p, CASE WHEN regexp_full_match(p, '[ -~]*') THEN p ELSE {_P4_FORM} END AS form FROM (SELECT file_id, filename, current_path AS p FROM media_files WHERE current_path IS NOT NULL))
SELECT DISTINCT o.id AS obs_id, f.file_id FROM o JOIN f ON o.form = f.form
WHERE o.p <> f.p OR f.filename IS DISTINCT FROM list_extract(string_split(o.p, '/'), -1)
"""

_P1 = """
WITH v AS (SELECT person_id AS id, min(centroid) AS c FROM person_centroids
  WHERE person_id IS NOT NULL AND len(centroid) = 64 AND len(list_filter(centroid, lambda e: e IS NOT NULL AND isfinite(e))) = 64
    AND len(list_filter(centroid, lambda e: e <> 0)) > 0 GROUP BY person_id),
pairs AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.c, b.c) AS s FROM v a JOIN v b ON a.id <> b.id {only}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS place FROM pairs)
"""

_KEY = r"nullif(regexp_replace(lower(trim(regexp_replace(source, '\s+', ' ', 'g'))), '[\s_-]+', '-', 'g'), '')"
_P8 = f"""
WITH t AS (SELECT mix_name, source, sum(w) AS w, min(cap) AS cap FROM (SELECT mix_name, {_KEY} AS source, CASE WHEN target_weight > 0 AND target_weight < 'inf'::DOUBLE THEN target_weight ELSE 0 END AS w, max_repeats AS cap FROM mix_targets)
  WHERE mix_name IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
d AS (SELECT doc_id, source, n_chars AS tokens, CAST('0x' || md5(doc_id || ' ' || source)[1:12] AS BIGINT) AS unit FROM (SELECT doc_id, {_KEY} AS source, n_chars FROM documents WHERE text IS NOT NULL AND n_chars > 0) WHERE source IN (SELECT source FROM t)),
h AS (SELECT source, sum(tokens) AS tokens, count(*) AS docs FROM d GROUP BY 1),
a AS (SELECT mix_name, source, coalesce(w / nullif(sum(w) OVER m, 0), 0) AS target, cap, coalesce(tokens, 0) AS tokens, coalesce(docs, 0) AS docs FROM t LEFT JOIN h USING (source) WINDOW m AS (PARTITION BY mix_name)),
b AS (SELECT *, CASE WHEN tokens = 0 OR cap < 1 THEN 0 WHEN cap IS NULL THEN 'inf'::DOUBLE ELSE cap * tokens END AS room FROM a),
c AS (SELECT *, coalesce(CASE WHEN room > 0 THEN target ELSE 0 END / nullif(sum(CASE WHEN room > 0 THEN target ELSE 0 END) OVER (PARTITION BY mix_name), 0), 0) AS share FROM b),
e AS (SELECT *, CASE WHEN share > 0 THEN room / share ELSE 0 END AS fills, sum(CASE WHEN share > 0 THEN tokens END) OVER (PARTITION BY mix_name) AS budget FROM c),
f AS (SELECT *, coalesce(sum(CASE WHEN share > 0 AND room < 'inf'::DOUBLE THEN room ELSE 0 END) OVER (PARTITION BY mix_name ORDER BY fills, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(share) OVER (PARTITION BY mix_name ORDER BY fills, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM e),
g AS (SELECT *, CASE WHEN rest > 0 THEN (budget - before) / rest END AS level FROM f),
i AS (SELECT mix_name, arg_min(level, (fills, level)) AS level FROM g WHERE share > 0 AND fills >= level GROUP BY 1),
p AS (SELECT g.* EXCLUDE (level), CASE WHEN share > 0 THEN least(room, share * coalesce(i.level, 'inf'::DOUBLE)) ELSE 0 END AS demand FROM g LEFT JOIN i USING (mix_name)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY unit, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM d),
n AS (SELECT mix_name, p.source, s.tokens, ceil((demand - (upto + s.tokens / 2)) / p.tokens)::BIGINT AS copies FROM s JOIN p ON s.source = p.source WHERE demand > 0 AND upto + s.tokens / 2 < demand),
r AS (SELECT mix_name, source, sum(tokens * copies) AS got, sum(copies) AS docs_got, max(copies) AS most FROM n GROUP BY 1, 2)
SELECT mix_name, source, round(target, 6) AS target_share, round(coalesce(got / nullif(sum(got) OVER (PARTITION BY mix_name), 0), 0), 6) AS actual_share, tokens::BIGINT AS held_tokens, docs AS held_docs,
  coalesce(got, 0)::BIGINT AS selected_tokens, coalesce(docs_got, 0)::BIGINT AS selected_docs, coalesce(most, 0)::INTEGER AS most_repeats
FROM p LEFT JOIN r USING (mix_name, source)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_topk": p1_topk,
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p2_same_spelling": p2_same_spelling,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_by_batch": p6_by_batch,
    "p6_near": p6_near,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p7_verbatim": p7_verbatim,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p8_shares": p8_shares,
    "p9_levels": p9_levels,
    "p9_profile": p9_profile,
    "p9_words": p9_words,
    "p9_labels": p9_labels,
}
SQL = {
    "p2_same_spelling": """
WITH n AS (SELECT DISTINCT id, lower(display_name) AS name FROM people WHERE id IS NOT NULL
  AND regexp_full_match(lower(display_name), '[a-z]{3,} [a-z]{8,}') AND NOT regexp_matches(lower(display_name), '^(uncle|aunt|auntie|cousin|coach|the|prof|capt|unknown|unnamed|person) '))
SELECT a.id AS id_a, b.id AS id_b FROM n a JOIN n b ON a.name = b.name AND a.id < b.id""",
    "p7_verbatim": """
SELECT DISTINCT doc_id, item_id FROM documents d JOIN eval_items i ON contains(d.text, i.text) WHERE doc_id IS NOT NULL AND item_id IS NOT NULL AND length(i.text) > 100""",
    "p8_shares": _P8,
    "p9_words": r"""
SELECT doc_id, len(regexp_extract_all(lower(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g')), '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*')) AS words
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(text, '[<&]')""",
    "p9_labels": "SELECT doc_id, median(grade::DOUBLE) AS grade FROM reading_labels WHERE doc_id IS NOT NULL AND grade BETWEEN 1 AND 18 GROUP BY 1",
    "p1_found": _P1.format(only="")
    + "SELECT DISTINCT least(id, other) AS person_id_a, greatest(id, other) AS person_id_b FROM ranked WHERE place <= 10 AND s >= 0.85",
    "p1_topk": _P1.format(only="WHERE a.id % 100 = 0")
    + "SELECT id AS person_id, other AS neighbour_id, round(s, 6) AS similarity, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 10",
    "p4_found": _P4,
    "p6_found": _P6_KEYS + _P6,
    "p6_by_batch": _P6_KEYS + f"SELECT batch_no, count(*) AS known FROM ({_P6}) GROUP BY 1",
    "p6_near": _P6_KEYS + _P6_NEAR,
}
