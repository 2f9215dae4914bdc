"""Column predicates and scalar functions of catalogue and search queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that hide a file, tag types by role, hours of the day parts.
HIDDEN = ("missing", "replaced", "excluded")
TAG_ROLES = {
    "place": ("place", "place_detail", "location", "geo", "geo_detail"),
    "person": ("person", "people", "face", "auto_person"),
    "visual": ("auto", "auto_scene", "auto_object", "auto_event", "auto_screen", "custom"),
}
DAYPARTS = {"dawn": (4, 7), "morning": (5, 11), "noon": (11, 14), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 24)}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "gif", "webp", "bmp", "dng", "cr2", "nef", "arw")
VIDEO_SUFFIXES = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mts", "3gp")


def active(status: Column, hidden: tuple[str, ...] = HIDDEN) -> Column:
    return ~status.isin(*hidden)


def contains_ci(col: Column, text: str) -> Column:
    """Substring without regard to case and without wildcards."""
    return F.contains(F.lower(col), F.lower(F.lit(text)))


def like_ci(col: Column, text: str) -> Column:
    """Substring without regard to case where ``%`` and ``_`` of the text are wildcards."""
    return col.ilike(f"%{text}%")


def capture_time(taken: Column, mtime_ns: Column) -> Column:
    """When a file was taken: the camera's time, else the file's (UTC)."""
    return F.coalesce(taken.cast("timestamp_ntz"), F.timestamp_micros(F.call_function("div", mtime_ns, F.lit(1000))).cast("timestamp_ntz"))


def day_range(ts: Column, first: str, last: str) -> Column:
    """Both days whole and included; null times are outside."""
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))


def daypart(ts: Column, part: str) -> Column:
    """Hours of a day part, the end excluded; the night goes on to four in the morning; null times are outside."""
    first, end = DAYPARTS[part]
    inside = (F.hour(ts) >= first) & (F.hour(ts) < end)
    if part == "night":
        inside = inside | (F.hour(ts) < 4)
    return F.coalesce(inside, F.lit(False))


def weekday_in(ts: Column, days: tuple[int, ...]) -> Column:
    """Monday is 0; null times are outside."""
    return F.coalesce(F.weekday(ts).isin(*days), F.lit(False))


def is_coordinate(col: Column) -> Column:
    return col.rlike(r"^-?\d+(\.\d+)?,-?\d+(\.\d+)?$")


def is_internal_person(col: Column) -> Column:
    return col.like("person-%")


def term_fits(tag: Column, term: Column) -> Column:
    """Equal, or both of two characters at least and one within the other."""
    return (tag == term) | ((F.length(tag) >= 2) & (F.length(term) >= 2) & (F.contains(tag, term) | F.contains(term, tag)))


def _fits(term: str):
    return lambda tag: term_fits(tag, F.lit(term))


def any_fits(tags: Column, terms: list[str]) -> Column:
    """Some tag fits some term; a null list fits nothing."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.exists(tags, _fits(t))
    return F.coalesce(hit, F.lit(False))


def all_fit(tags: Column, terms: list[str]) -> Column:
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.exists(tags, _fits(t))
    return F.coalesce(hit, F.lit(False))


def media_kind(path: Column, mime: Column) -> Column:
    """image, video or unknown by suffix, and by MIME type where the suffix says nothing."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*VIDEO_SUFFIXES), "video").when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").otherwise("unknown")
    )


def percent(part: Column, whole: Column, empty: float) -> Column:
    """Per cent to one decimal; ``empty`` where there is nothing."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(100.0 * part / whole, 1))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([0-9A-Za-z가-힣_]+)"), 1)


def bigrams(text: Column, kept: str = "가-힣") -> Column:
    """Pairs of neighbouring characters among those kept, white space and others dropped first."""
    bare = F.regexp_replace(text, f"[^{kept}]", "")
    return F.when(F.length(bare) >= 2, F.transform(F.sequence(F.lit(1), F.length(bare) - 1), lambda i: F.substring(bare, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; null for unlike lengths; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return F.when(F.size(a) == F.size(b), dot(a, b) / (one(norm(a)) * one(norm(b))))


def season(month: Column) -> Column:
    return F.when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn").when(month.isin(12, 1, 2), "winter")


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees to seven places; south and west are negative."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.round(F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value), 7)


def file_identity(size: Column, mtime_ns: Column, partial: Column) -> Column:
    return F.sha2(F.concat_ws(":", size.cast("string"), mtime_ns.cast("string"), partial), 256)


def partial_digest(content: Column, edge: int = 1 << 20) -> Column:
    """Digest of size and bytes; of both edges alone where the content is longer than two of them."""
    size = F.length(content)
    head = F.encode(size.cast("string"), "utf-8")
    edges = F.concat(F.substring(content, 1, edge), F.substring(content, F.greatest(F.lit(1), size - edge + 1), F.lit(edge)))
    return F.sha2(F.concat(head, F.when(size <= 2 * edge, content).otherwise(edges)), 256)


def camera_time(text: Column) -> Column:
    """The first of several notations of a camera's time that can be read."""
    notations = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(n)) for n in notations]).cast("timestamp_ntz")


def wants_text_reading(name: Column, edges: Column, brightness: Column) -> Column:
    """Whether an image is worth reading for text: by its name, or by its edges, fewer for PNG and for bright images."""
    low = F.lower(name)
    return low.rlike("screenshot|scan|receipt|document|note") | (low.endswith(".png") & (edges >= 0.025)) | (edges >= 0.08) | ((edges >= 0.045) & (brightness >= 0.5))


def typed_tags(text: Column) -> Column:
    """Tags typed into one field: ``#``, ``;`` and ``,`` part them; without regard to case the first spelling stays."""
    parts = F.filter(F.transform(F.split(F.translate(text, "#;", ",,"), ","), F.trim), lambda x: x != "")
    low = F.transform(parts, F.lower)
    return F.filter(F.transform(parts, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def caption_parts(text: Column) -> Column:
    """The items of a comma-separated caption answer, without "none"."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & (x != "none"))


def asset_path(kind: str, version: str, file_id: Column, suffix: str = "jpg") -> Column:
    """Where a derived file lies: kind, version, two characters of the id, id."""
    return F.concat(F.lit(f"{kind}/{version}/"), F.substring(file_id, 1, 2), F.lit("/"), file_id, F.lit(f".{suffix}"))
