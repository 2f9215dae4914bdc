"""Natural-language search: one pass over the library judges every row, and channels, fusion, boosts, order and thinning
work on the few rows that hit.

The library is a DataFrame with id, text, taken (timestamp_ntz), tags array<struct<tag_type, tag_value>>, people count
and, where vectors exist, embedding. Full-text statistics come from a stored index where one is given, else from a second
narrow pass. Only the plan, counts and ``isEmpty`` answers live on the driver.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions import predicates as P
from shutterloom.operators import ranking, text, vectors
from shutterloom.plans import planner
from shutterloom.plans import words as W
from shutterloom.plans.planner import Plan
from shutterloom.session import cut_lineage, release

Encoder = Callable[[str], list[float]]


def _values(role: str | None = None) -> Column:
    tags = F.col("tags") if role is None else F.filter("tags", lambda t: t["tag_type"].isin(*P.TAG_ROLES[role]))
    return F.transform(tags, lambda t: F.lower(t["tag_value"]))


def widened(term: str) -> tuple[str, ...]:
    """Synonyms and translations of a term, itself left out."""
    low = term.lower()
    base = {low, W.TRANSLATE.get(low, low)}
    return tuple(sorted({w for group in W.SYNONYMS if base & set(group) for w in group} | base - {low}))


def hard_filter(plan: Plan) -> Column:
    """All that a row must meet, as one predicate, so that it is applied in the scan of each channel."""
    ok = F.lit(True)
    if plan.days:
        ok = ok & F.coalesce(P.day_range(F.col("taken"), plan.days[0].isoformat(), plan.days[1].isoformat()), F.lit(False))
    if plan.daypart:
        ok = ok & P.daypart(F.col("taken"), plan.daypart)
    if plan.weekdays:
        ok = ok & P.weekday_in(F.col("taken"), plan.weekdays)
    low, high = plan.faces
    if low is not None:
        ok = ok & (F.coalesce("people", F.lit(0)) >= low)
    if high is not None:
        ok = ok & (F.coalesce("people", F.lit(0)) <= high)
    terms = lambda xs: sorted({y.lower() for x in xs for y in (x, *widened(x))})
    if "place" in plan.needs:
        ok = ok & P.any_fits(_values(), terms(plan.places))
    if "visual" in plan.needs:
        ok = ok & P.any_fits(_values("visual"), terms(plan.visuals))
    if "person" in plan.needs:
        ok = ok & (P.all_fit if plan.all_persons else P.any_fits)(_values("person"), [x.lower() for x in plan.persons])
        if plan.exclusive:
            named = F.filter(_values("person"), lambda v: ~P.is_internal_person(v))
            ok = ok & (F.size(F.array_except(named, F.array(*[F.lit(x) for x in terms(plan.persons)]))) == 0)
    for x in [x.lower() for x in plan.excluded]:
        gone = F.coalesce(F.array_contains(_values(), x), F.lit(False))
        if len(x) >= 2:
            gone = gone | F.coalesce(P.contains_ci(F.col("text"), x), F.lit(False))
        if x in ("people", "person", "사람"):
            gone = F.coalesce("people", F.lit(0)) > 0
        ok = ok & ~gone
    return ok


def judged(library: DataFrame, plan: Plan, encode: Encoder | None = None, index: text.TextIndex | None = None, persons: DataFrame | None = None) -> DataFrame:
    """One row for each row of the library that meets the plan's conditions and hits in some way, with all that channels and
    order need: how it holds the words, its tags, its full-text score and its vector distance.

    ``persons`` has the ids of rows that show the persons asked for; they then stand in the place of tag hits."""
    words = plan.keywords
    asked = sorted({plan.text.lower(), *([] if plan.exact_tag else [words.lower(), *plan.tokens, *(p.lower() for p in plan.places), *(s for t in (words, *plan.tokens, *plan.places) for s in widened(t))])})
    rows = library.where(hard_filter(plan))
    tag = lambda test: F.coalesce(F.exists("tags", test), F.lit(False))
    value = lambda t: F.lower(t["tag_value"])
    hints = bool(planner.found(words, W.PERSON) or plan.persons), bool(planner.found(words, W.TEXT))
    hinted = (F.coalesce("people", F.lit(0)) > 0) if hints[0] else F.lit(False)
    if hints[1]:
        hinted = hinted | tag(lambda t: value(t).isin("text", "document", "screenshot"))
    near = F.lit(None).cast("double")
    if encode and "embedding" in library.columns:
        near = F.least(*[F.lit(1.0) - vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in encode(v)])) for v in plan.variants or (plan.text,)], F.lit(None).cast("double"))
    solo = F.lit(len(plan.persons) == 1) & P.any_fits(_values("person"), [t.lower() for t in plan.persons]) & (F.coalesce("people", F.lit(0)) <= 1)
    fits = lambda role, terms: sum((F.when(P.any_fits(_values(role), [t.lower(), *widened(t)]), 1).otherwise(0) for t in terms), F.lit(0))
    counted = not (index or plan.exact_tag)
    if counted:
        rows = text.read_words(rows, "text", *[F.col(c) for c in rows.columns])
    rows = rows.select(
        "id", "taken", F.coalesce("people", F.lit(0)).alias("people"),
        text.match_kind(F.col("text"), words).alias("kind"),
        F.coalesce(P.contains_ci(F.col("text"), words), F.lit(False)).alias("held"),
        text.gram_hits(F.col("text"), words).alias("grams"),
        tag(lambda t: value(t).isin(*asked)).alias("tagged"),
        tag(lambda t: value(t) == plan.text.lower()).alias("tag_exact"),
        tag(lambda t: value(t).isin(*asked) & (t["tag_type"] == "auto")).alias("tag_auto"),
        tag(lambda t: value(t).isin(*asked) & (t["tag_type"] == "custom")).alias("tag_custom"),
        tag(lambda t: F.contains(value(t), F.lit(words.lower()))).alias("tag_like"),
        F.coalesce(hinted, F.lit(False)).alias("hinted"), near.alias("distance"), F.coalesce(solo, F.lit(False)).alias("solo"),
        fits("place", plan.places).alias("places_fit"), fits("person", plan.persons).alias("persons_fit"),
        *(text.term_counts(plan.tokens) if counted else []),
    )
    score = F.lit(None).cast("double")
    if plan.tokens and not plan.exact_tag:
        if index:
            found = index.bm25(plan.tokens)
            rows = rows.join(found.withColumnRenamed("score", "words_score"), "id", "left")
            score = F.col("words_score")
        else:
            stats = text.statistics(library, "text", plan.tokens)
            score = text.score_of(plan.tokens, stats)
    rows = rows.withColumn("bm25", score).drop("words_score", "len", *[f"tf{i}" for i in range(len(plan.tokens))])
    if persons is not None:
        seen = persons.select("id", F.lit(True).alias("shown")).distinct()
        rows = rows.join(seen, "id", "left").withColumn("tagged", F.coalesce("shown", F.lit(False))).drop("shown")
    return rows.where("held or kind is not null or grams > 0 or tagged or tag_like or hinted or distance is not null or bm25 is not null")


def channels(rows: DataFrame, plan: Plan, limit: int, mode: str, vector: bool, by_person: bool = False, clear: bool = False) -> dict[str, DataFrame]:
    """The channels that run for this mode, each ranked, out of the judged rows."""
    k = max(4 * limit, limit + 20) if plan.has_hard_filters else limit
    out: dict[str, DataFrame] = {}
    pure_person = bool(plan.persons) and not plan.visuals and not plan.places
    newest = F.desc_nulls_last("taken"), F.col("id")
    if not plan.exact_tag and not pure_person and not clear and mode != "semantic":
        held = rows.where("held").select("id", F.lit(0).alias("by"), F.lit(0.0).alias("less"), "taken")
        if held.limit(limit).count() < limit:  # few hold the words: those that share pairs of characters stand behind
            held = held.unionByName(rows.where("not held and grams > 0").select("id", F.lit(1).alias("by"), (-F.col("grams")).cast("double").alias("less"), "taken"))
        out["ocr"] = ranking.channel_rank(held, k, F.col("by"), F.col("less"), *newest)
    if vector and not plan.exact_tag and not pure_person and mode != "ocr":
        out["clip"] = ranking.channel_rank(rows.where("distance is not null").select("id", "distance"), k, F.col("distance"), F.col("id"))
    # the first kind of hit that any row has; hinted rows stand behind tagged ones
    order = ["tag_exact", "tag_auto", "tag_custom"]
    rung = F.when(F.col("tagged"), 0).when(F.col("hinted") & ~F.lit(by_person or bool(plan.exact_tag)), 1).when(F.col("bm25").isNotNull(), 2).when(F.col("held"), 3).when(F.col("tag_like"), 4)
    shadow = rows.withColumn("rung", rung).where("rung is not null")
    shadow = shadow.withColumn("rank_score", F.when(F.col("rung") == 2, F.col("bm25")).when(F.col("rung") == 1, -F.col("people").cast("double")).otherwise(0.0))
    first = shadow.agg(F.min("rung").alias("_first"))  # one row
    shadow = shadow.join(F.broadcast(first), F.when(F.col("_first") <= 1, F.col("rung") <= 1).otherwise(F.col("rung") == F.col("_first")))
    tagged = [F.desc(c) for c in order] + ([F.asc("people")] if by_person else [])
    out["shadow"] = ranking.channel_rank(shadow.select("id", "rung", "rank_score", "taken", "people", *order), k, F.col("rung"), F.col("rank_score"), *tagged, *newest)
    return out


def run(
    library: DataFrame, plan: Plan, limit: int = 20, encode: Encoder | None = None, requested: str = "hybrid", hidden: DataFrame | None = None,
    promoted: DataFrame | None = None, stored: dict | None = None, burst_s: int = 3, index: text.TextIndex | None = None, persons: DataFrame | None = None,
) -> DataFrame:
    """(id, score, reason, pos, parts): the answer of one plan without fallbacks; parts says what made up the score."""
    seen = judged(library, plan, encode, index, persons)
    if hidden is not None:
        seen = seen.join(hidden.select("id"), "id", "left_anti")
    up = F.lit(False)
    if promoted is not None:
        seen = seen.join(promoted.select("id", F.lit(True).alias("up")).distinct(), "id", "left")
        up = F.coalesce("up", F.lit(False))
    rows = cut_lineage(seen)  # the rows that hit, without their texts
    hits = rows.where("held").select("kind").limit(4 * limit).groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "word").alias("word"), F.count_if(F.col("kind") == "phrase").alias("phrase")).first()
    clear = plan.intent == "visual" and not planner.found(plan.keywords, W.TEXT)  # the text channel is not asked, so nothing is known of its hits
    mode, _ = planner.route(plan, requested, *((0, 0, 0) if clear else (hits.word, hits.phrase, hits.n)))
    vector = encode is not None and "embedding" in library.columns
    found = channels(rows, plan, limit, mode, vector, persons is not None, clear)
    weights = ranking.weights({"ocr": "ocr", "semantic": "semantic"}.get(mode, plan.intent if plan.intent == "mixed" else "default"), stored, empty_clip="clip" not in found)
    fused = ranking.fuse(found, weights).join(rows, "id")
    B = ranking.BOOST
    held = F.when(F.col("kind") == "phrase", B["phrase"]).when(F.col("kind") == "word", F.lit(B["phrase"] if " " not in plan.keywords else B["tokens"]))
    grams = F.when(F.col("kind").isNull() & (F.col("grams") > 0), B["grams"] * F.col("grams") / F.greatest(F.max("grams").over(Window.partitionBy()), F.lit(1)))
    bonus = {"text": F.coalesce(held, grams), "tag": F.when(F.col("tag_exact"), B["tag"]), "place": B["place"] * F.col("places_fit"), "person": B["person"] * F.col("persons_fit"), "promoted": F.when(up, B["promoted"])}
    if plan.days:
        bonus["date"] = F.when(F.col("reason") != "clip", B["date"])
    out = ranking.explained(fused, bonus)
    order = [F.desc("tag_exact"), F.desc("solo"), F.desc(F.coalesce(F.col("kind") == "phrase", F.lit(False))), F.desc("score"), F.asc("id")]
    # at most three channels of bounded length: this order is over their few rows
    out = out.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    if not plan.persons and not plan.exact_tag:
        out = ranking.burst(out, "taken", "score", "pos", burst_s)
        out = ranking.day_cap(out, "taken", [F.col("pos"), F.col("id")], 99_999 if "place" in plan.needs else 5)
    turned = planner.wanted_order(plan.query)  # newest or oldest first, where the query says so
    last = {"newest": [F.desc_nulls_last("taken")], "oldest": [F.asc_nulls_last("taken")]}.get(turned, [])
    answer = cut_lineage(out.orderBy("pos", "id").limit(limit).orderBy(*last, "pos", "id").select("id", "score", "reason", "pos", "parts"))  # at most ``limit`` rows
    release(rows)
    return answer


def vocabulary(library: DataFrame, query: str) -> dict[str, set[str]]:
    """The tags by role that matter to a query: those it holds, and for its tokens one tag each that holds them. Their
    number is bounded by the query's length, whatever the library has."""
    text_ = planner.normalise(query)
    tokens = [t for t in planner.tokenise(text_) if len(t) >= 3 and t not in W.LITTLE]
    roles = F.lit(None).cast("string")
    for role, types in P.TAG_ROLES.items():
        roles = F.when(F.col("t.tag_type").isin(*types), role).otherwise(roles)
    tags = library.select(F.explode("tags").alias("t")).select(roles.alias("role"), F.col("t.tag_value").alias("tag")).where("role is not null and tag is not null")
    low = F.lower("tag")
    tags = tags.where((F.length("tag") >= 2) & ~P.is_coordinate(F.col("tag")))
    own = tags.where(F.contains(F.lit(text_.lower()), low)).select("role", "tag").distinct()
    every = own.select("role", "tag", F.lit(True).alias("whole"))
    if tokens:
        part = tags.select("role", "tag", F.explode(F.array(*[F.lit(t) for t in tokens])).alias("token")).where(F.contains(low, F.col("token")) & (low != F.col("token")))
        every = every.unionByName(part.groupBy("role", "token").agg(F.min("tag").alias("tag")).select("role", "tag", F.lit(False).alias("whole")))
    out: dict[str, set[str]] = {}
    for r in every.collect():
        out.setdefault(r.role, set()).add(r.tag)
    return out


def resolve_people(people: DataFrame, tokens: list[str]) -> DataFrame:
    """(id): unmerged people whose label holds one of the ``tokens`` of two letters or more, or is held by one; people:
    (id, label, merged_into_id)."""
    hit = F.lit(False)
    for t in sorted({t.lower() for t in tokens if len(t) >= 2}):
        hit = hit | P.term_fits(F.lower("label"), F.lit(t))
    return people.where(F.col("merged_into_id").isNull() & hit).select("id").distinct()


def correct(tags: DataFrame, plan: Plan, most: int = 2000) -> str | None:
    """The query with each unknown token replaced by the tag most like it; None where nothing changes, or where the
    library has more than ``most`` tags, for which guesses are too many (a rule of the search, not of its size)."""
    known = tags.where("tag is not null").select(F.lower("tag").alias("tag")).distinct()
    if known.limit(most + 1).count() > most:
        return None
    tokens = list(planner.tokenise(plan.text))
    there = {r.tag for r in known.where(F.col("tag").isin(tokens)).collect()}
    out = []
    for t in tokens:
        near = text.nearest_tag(known, "tag", t).collect() if len(t) >= 2 and t not in there else []  # one row at most
        out.append(near[0].tag if near else t)
    return " ".join(out) if out != tokens else None


def search(library: DataFrame, query: str, today: date, tags: dict[str, set[str]] | None = None, limit: int = 20, people: DataFrame | None = None, faces: DataFrame | None = None, **how) -> DataFrame:
    """The answer with fallbacks: a corrected spelling first, then shorter queries; (id, score, reason, pos, parts, used).

    Without ``tags`` the library's own are used. people (id, label, merged_into_id) and faces (id, person_id) let names lead
    to the rows that show the persons."""
    if not planner.tokenise(query):
        return run(library.limit(0), planner.make("nothing", today), limit).withColumn("used", F.lit(""))

    def answer(q: str) -> tuple[DataFrame, Plan]:
        plan = planner.make(q, today, vocabulary(library, q) if tags is None else tags)
        shown = None
        if people is not None and faces is not None and not plan.exact_tag:
            ids = resolve_people(people, [*plan.persons, *plan.tokens])
            if not ids.isEmpty():
                shown = faces.join(ids.withColumnRenamed("id", "person_id"), "person_id", "left_semi").select("id").distinct()
        return run(library, plan, limit, persons=shown, **how), plan

    out, plan = answer(query)
    if not out.isEmpty():
        return out.withColumn("used", F.lit(plan.text))
    known = library.select(F.explode("tags").alias("t")).select(F.col("t.tag_value").alias("tag"))
    better = correct(known, plan)
    for other in [*([better] if better else []), *planner.without_conditions(plan)]:
        found, _ = answer(other)
        if not found.isEmpty():
            return found.withColumn("used", F.lit(other))
    return out.withColumn("used", F.lit(plan.text))


class ResultCache:
    """Answers kept for a while: the oldest goes beyond ``most``. Keys are the query, limit, mode and place."""

    def __init__(self, seconds: float = 60.0, most: int = 256, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.most, self.clock = seconds, most, clock
        self._kept: OrderedDict[tuple, tuple[float, list]] = OrderedDict()

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> list:
        """The rows of an answer, at most its limit."""
        at, rows = self._kept.get(key, (float("-inf"), None))
        if rows is None or self.clock() - at > self.seconds:
            rows = make().collect()
            self._kept.pop(key, None)
            self._kept[key] = (self.clock(), rows)
            while len(self._kept) > self.most:
                self._kept.popitem(last=False)
        return rows


def suggest(tags: DataFrame, log: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(suggestion, source): tags first, those that begin with the prefix and frequent ones before, then recent queries
    that had results; each once without regard to case. tags: (tag_value); log: (query, result_count, at)."""
    hit = tags.where(P.contains_ci(F.col("tag_value"), prefix) & ~P.is_internal_person(F.col("tag_value"))).groupBy("tag_value").agg(F.count("*").alias("n"))
    hit = ranking.top(hit, 4 * limit, F.desc("n"), F.col("tag_value"))
    starts = F.startswith(F.lower("tag_value"), F.lit(prefix.lower()))
    a = hit.select(F.col("tag_value").alias("suggestion"), F.lit(0).alias("source"), F.when(starts, 0).otherwise(1).alias("k1"), (-F.col("n")).cast("double").alias("k2"))
    b = log.where((F.col("result_count") > 0) & P.contains_ci(F.col("query"), prefix)).groupBy("query").agg(F.max("at").alias("at"))
    b = ranking.top(b, 4 * limit, F.desc("at"), F.col("query")).select(F.col("query").alias("suggestion"), F.lit(1).alias("source"), F.lit(0).alias("k1"), (-F.unix_micros(F.col("at").cast("timestamp"))).cast("double").alias("k2"))
    w = Window.partitionBy(F.lower("suggestion")).orderBy("source", "k1", "k2", "suggestion")
    rows = a.unionByName(b).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.orderBy("source", "k1", "k2", "suggestion").limit(limit).select("suggestion", "source")
