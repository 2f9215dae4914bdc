"""From a typed query to a plan: terms, dates, counts, exclusions, what is required, intent and mode.

Planning is driver-side work on one short string; the plan becomes columns in ``search``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date

from shutterloom.plans import dates
from shutterloom.plans import words as W


@dataclass(frozen=True)
class Plan:
    query: str
    text: str
    keywords: str = ""
    tokens: tuple[str, ...] = ()
    persons: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    visuals: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    days: tuple[date, date] | None = None
    daypart: str | None = None
    weekdays: tuple[int, ...] = ()
    faces: tuple[int | None, int | None] = (None, None)
    exclusive: bool = False
    all_persons: bool = False
    #: What every hit must have, besides the conditions above: any of person, place, visual.
    needs: frozenset[str] = frozenset()
    intent: str = "hybrid"
    exact_tag: str | None = None
    known_place: bool = False
    variants: tuple[str, ...] = field(default=())

    @property
    def fixed(self) -> tuple:
        """The conditions that no fallback may relax, where set."""
        return tuple(c for c in (self.excluded, self.daypart, self.weekdays, self.faces if self.faces != (None, None) else None) if c)

    @property
    def has_hard_filters(self) -> bool:
        return bool(self.fixed or self.needs or self.days)


#: What a query must have found, by what it names: (requirement, all of these, any of these or nothing).
_REQUIRED = (
    ("visual", ("visual",), ("person", "place alone", "date")),
    ("place", ("certain place", "locative"), ()),
    ("place", ("certain place alone",), ("person", "visual", "date")),
    ("place", ("certain place", "person"), ()),
    ("person", ("person",), ("only", "everyone", "count", "date", "needs place", "needs visual")),
)


def requirements(named: dict[str, bool]) -> frozenset[str]:
    out: set[str] = set()
    for what, every, some in _REQUIRED:
        known = {k for k, v in named.items() if v} | {f"needs {x}" for x in out}
        if known.issuperset(every) and (not some or known.intersection(some)):
            out.add(what)
    return frozenset(out)


def normalise(query: str) -> str:
    """Blanks collapsed, known typing slips repaired, particles cut off where two characters or more are left."""
    known = {*W.PERSON, *W.PLACE, *W.VISUAL, *W.TEXT, *W.TRAVEL, *W.CELEBRATION, *W.SCREEN, *W.TRANSLATE}
    out = []
    for t in query.split():
        t = W.TYPOS.get(t.lower(), t)
        if t not in known and re.search("[가-힣]$", t):
            cut = next((t[: -len(p)] for p in W.PARTICLES if t.endswith(p) and len(t) - len(p) >= 2), t)
            t = cut
        out.append(t)
    return " ".join(out)


def _pieces(token: str) -> list[str]:
    """A Hangul token of four syllables or more without its endings, and parted at joiners; kept nouns stand apart."""
    for joiner in W.JOINERS:
        left, at, right = token.partition(joiner)
        if at and len(left) >= 2 and len(right) >= 2:
            return _pieces(left) + _pieces(right)
    ending = next((e for e in sorted([*W.PARTICLES, *W.ENDINGS, *W.KEPT], key=len, reverse=True) if token.endswith(e) and len(token) - len(e) >= 2), None)
    if ending is None:
        return [token]
    return _pieces(token[: -len(ending)]) + ([ending] if ending in W.KEPT else [])


def tokenise(text: str) -> tuple[str, ...]:
    raw = [t.lower() for t in re.findall(r"[0-9A-Za-z가-힣_]+", text)]
    return tuple(dict.fromkeys(p for t in raw for p in (_pieces(t) if len(t) >= 4 and re.search("[가-힣]", t) else [t])))


def found(text: str, vocabulary: list[str] | set[str]) -> tuple[str, ...]:
    """Terms of a vocabulary that a text holds: whole words, or in Hangul two letters or more."""
    low = text.lower()
    hits = [t for t in vocabulary if (re.search(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])", low) if t.isascii() else len(t) >= 2 and t in low or t in low.split())]
    return tuple(dict.fromkeys(hits))


def face_count(text: str) -> tuple[int | None, int | None]:
    q = text.lower()
    number = r"(\d+|" + "|".join(W.NUMBERS) + ")"
    value = lambda s: W.NUMBERS.get(s) or int(s)
    if re.search(r"\b(?:alone|solo|selfie)\b|혼자|독사진", q):
        return 1, 1
    m = re.search(r"\b(two|three|four) of us\b|\b(two|three|four) together\b|(둘이|셋이|넷이)", q)
    if m:
        n = {"two": 2, "three": 3, "four": 4, "둘이": 2, "셋이": 3, "넷이": 4}[m[1] or m[2] or m[3]]
        return n, n
    if re.search(r"\bgroup (?:photo|shot)\b|\btogether\b|단체 ?사진|같이 찍", q):
        return 2, None
    unit = r"\s*(?:people|persons?|faces|명|사람)"
    for pattern, make in (
        (rf"at least {number}{unit}|{number}{unit} ?(?:이상|or more)", lambda n: (n, None)),
        (rf"more than {number}{unit}|{number}{unit} ?초과", lambda n: (n + 1, None)),
        (rf"at most {number}{unit}|{number}{unit} ?이하", lambda n: (None, n)),
        (rf"fewer than {number}{unit}|{number}{unit} ?미만", lambda n: (None, max(0, n - 1))),
        (rf"\b{number}{unit}", lambda n: (n, n)),
    ):
        m = re.search(pattern, q)
        if m:
            return make(value(next(g for g in m.groups() if g)))
    return None, None


def exclusions(text: str, terms: Iterable[str]) -> tuple[str, ...]:
    """Those of the recognised ``terms`` that stand next to a marker: after an English one, before a Korean one."""
    low, out = text.lower(), []
    for t in sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t)):
        before = rf"\b(?:{'|'.join(W.EXCLUDING_EN)})\s+(?:any\s+|an?\s+|the\s+)?{re.escape(t)}(?![a-z0-9])"
        if re.search(before, low) or re.search(rf"{re.escape(t)}(?:은|는|이|가|을|를)?\s*(?:{'|'.join(W.EXCLUDING_KO)})", low):
            out.append(t)
    return tuple(out)


def daypart(text: str) -> str | None:
    low = text.lower()
    return next((p for p in W.DAYPARTS if re.search(rf"\b{p}\b", low)), None) or next((p for k, p in W.DAYPARTS_KO.items() if k in low), None)


def weekdays(text: str) -> tuple[int, ...]:
    low = text.lower()
    if re.search(r"weekend|주말", low):
        return 5, 6
    if re.search(r"weekday|평일", low):
        return 0, 1, 2, 3, 4
    said = lambda i: re.search(rf"\b{W.DAYS[i][:3]}(?:{W.DAYS[i][3:]})?\b|{W.DAYS_KO[i]}요일", low)
    return tuple(i for i in range(7) if said(i))


def keyword_text(tokens: tuple[str, ...], excluded: tuple[str, ...], whole: str) -> str:
    """The words to search text for: without those of dates, times of day, weekdays and exclusions."""
    stop = {*W.TIME_WORDS, *W.DAYS, *W.DAYPARTS, *W.DAYPARTS_KO, *W.MONTHS, *(m[:3] for m in W.MONTHS if m != "may"), *W.EXCLUDING_EN, *W.EXCLUDING_KO, *excluded}
    kept = [t for t in tokens if t not in stop and not re.fullmatch(r"(?:19|20)\d\d년?|\d+(?:월|일|년)", t) and not t.endswith("요일")]
    return " ".join(kept) or whole


def route(plan: Plan, requested: str = "hybrid", word_hits: int = 0, phrase_hits: int = 0, ocr_hits: int = 0) -> tuple[str, str]:
    """(mode, reason); the first rule that fits. The hits are those of the text channel, and of which kind."""
    q = plan.query
    has = lambda vocabulary: bool(found(q, vocabulary))
    face = has(W.PERSON) or bool(plan.persons)
    text, screen = has(W.TEXT), has(W.SCREEN)
    code = bool(re.search(r"[\d\-_:/\[\]()#]", q))
    short = len(q) <= 12
    rules = (
        (requested != "hybrid", requested, "manual"),
        (plan.intent == "ocr" and not face, "ocr", "planner-ocr"),
        (face and (text or screen or code), "hybrid", "auto-mixed"),
        (face, "semantic", "auto-face"),
        ((has(W.TRAVEL) or plan.known_place) and not text, "semantic", "auto-travel"),
        (has(W.CELEBRATION) and not text, "semantic", "auto-celebration"),
        (plan.intent == "visual" and not text and not word_hits and not phrase_hits, "semantic", "planner-visual"),
        (text and not ocr_hits, "ocr", "auto-text-hint"),
        (screen and (word_hits or phrase_hits or short), "ocr", "auto-screen-text"),
        (code, "ocr", "auto-code"),
        (word_hits and (short or word_hits >= 2 or code), "ocr", "auto-word-match"),
    )
    return next(((mode, why) for hit, mode, why in rules if hit), ("hybrid", "fallback"))


def variants(plan_text: str, core: str) -> tuple[str, ...]:
    """Texts to encode for vector search: core, sentence, translation, original."""
    translated = " ".join(W.TRANSLATE.get(t, t) for t in core.split())
    more = " ".join(dict.fromkeys(w for t in translated.split() for group in W.SYNONYMS if t in group for w in group))
    return tuple(dict.fromkeys(x for x in (core, *(T.format(translated) for T in W.TEMPLATES), translated, more, plan_text) if x))


def _named(text: str, tokens: tuple[str, ...], tags: Iterable[str]) -> tuple[str, ...]:
    """Known tags that the text holds, and tokens of three letters or more that some tag holds."""
    low = [t.lower() for t in tags]
    return tuple(dict.fromkeys([*found(text, set(tags)), *(t for t in tokens if len(t) >= 3 and t not in W.LITTLE and any(t in v and t != v for v in low))]))


def make(query: str, today: date, tags: dict[str, set[str]] | None = None) -> Plan:
    """The plan of a query. ``tags``: known tag values by role (person, place, visual), for exact and dynamic matches."""
    tags = {k: set(v) for k, v in (tags or {}).items()}
    text = normalise(query)
    tokens, low = tokenise(text), text.lower()
    exact = {v.lower(): v for values in tags.values() for v in values}.get(low)
    names = _named(text, tokens, tags.get("person", ()))
    there = _named(text, tokens, tags.get("place", ()))
    places = tuple(dict.fromkeys([*(W.PLACE_ALIASES.get(p, p) for p in found(text, [*W.PLACE, *W.PLACE_ALIASES])), *there]))
    visuals = tuple(dict.fromkeys([*found(text, W.VISUAL), *found(text, tags.get("visual", set()))]))
    texts, crowd = found(text, W.TEXT), found(text, W.PERSON)
    excluded = exclusions(query, [*names, *places, *visuals, *texts, *crowd])
    names, places, visuals, texts, crowd = (tuple(t for t in ts if t.lower() not in excluded) for ts in (names, places, visuals, texts, crowd))
    visuals = tuple(v for v in visuals if not any(v != p and v in p for p in places))
    days, part, week = (None, None, ()) if exact else (dates.parse(text, today), daypart(text), weekdays(text))
    faces = face_count(text)
    padded = f" {low} "
    exclusive = bool(names) and any(o in low for o in W.ONLY)
    everyone = len(names) >= 2 and not any(o in padded for o in W.OR_MARKERS)
    certain, alone = [p for p in places if p not in W.SCENE], [p for p in places if p not in visuals]
    needs = requirements({
        "person": bool(names), "visual": bool(visuals), "date": days is not None, "certain place": bool(certain), "place alone": bool(alone),
        "certain place alone": any(p in certain for p in alone), "locative": any(m in padded for m in W.LOCATIVE),
        "only": exclusive, "everyone": everyone, "count": faces != (None, None),
    })
    keywords = text if exact else keyword_text(tokens, excluded, text)
    seen = bool(names or crowd or places or visuals or days)
    intent = "mixed" if texts and seen else "ocr" if texts else "visual" if seen else "keyword" if keywords != " ".join(tokens) else "hybrid"
    core = " ".join(t for t in tokenise(keywords) if t not in W.PHOTO_WORDS)
    return Plan(query, text, keywords, tokenise(keywords), names, places, visuals, excluded, days, part, week, faces, exclusive, everyone, needs, intent, exact, any(p in places for p in there), variants(text, core))


def without_conditions(plan: Plan) -> list[str]:
    """Shorter queries to try when nothing was found: visual terms alone, each of two places, each of two persons."""
    if plan.fixed:
        return []
    out = [" ".join(plan.visuals[:3])] if plan.visuals else []
    return [x for x in dict.fromkeys([*out, *plan.places[:2], *plan.persons[:2]]) if x and x != plan.text]


def wanted_order(query: str) -> str | None:
    """newest or oldest, where a query asks for hits in time order."""
    low = query.lower()
    return "newest" if re.search(r"\b(?:newest|latest)\b|최신", low) else "oldest" if re.search(r"\boldest\b|가장 오래된", low) else None
