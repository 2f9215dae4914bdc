"""Variant spellings of the names of one person or organisation.

1. Every display name and alias is normalised and parsed: accents, titles, remarks, order and separators are undone;
   placeholders, family roles and bare forenames name nobody (a Korean name of a known family name is whole in one word). What is left is a core token (the family name, or the own
   name of an organisation) and a companion (forename, initial, kind of organisation), kept together with all words
   of the name. Equal ones are one node, so a name that a third of all rows carry is one node.
2. A symmetric-delete index over the distinct core tokens (and over unknown companions) proposes tokens at a small edit
   distance: tokens that share a remainder after deleting one letter. Such a group holds distinct tokens only, so its
   size is bounded by token length times alphabet. Tokens count from 3 letters; between two of 3 letters only equality
   does, as most such names (Kim, Lim) are a letter apart. Nodes are proposed where both tokens are equal or similar; where
   one has the two tokens alone, the others of equal tokens meet it instead of each other.
3. Proposed nodes are verified by aligning all their words: an optimal assignment in which words may be equal, differ by
   one typing slip, be an initial, a nickname, a beginning or an abbreviation of the other. A word of the shorter name
   that stands for none of the other's (another middle name or initial) rejects the pair.
4. Initials, ambiguous nicknames and beginnings of an unlisted forename (3 letters at least) lead to a person only if
   their words align with exactly one among those of that family name.
5. Connected components over the nodes, with a row's names joined to each other, give the entities.

Defined results: null or blank names and null, empty or unreadable alias lists name nobody, but a plain name in place
of the list is an alias; rows with a null id are left out; repeated rows count once; empty tables give empty results;
texts of any length are handled whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.operators.components import components
from shutterloom.session import cut_lineage, scratch

# Common forenames, their irregular short forms, and the words names are built with.
FORENAMES = """
adelaide albert alexander alexandra alfred alice amelia andrew angela anna anthony arthur barbara beatrice benjamin bernard
bridget caroline catherine charles charlotte christine christopher claire constance daniel david deborah dmitri donald dorothy
douglas edmund edward eleanor elizabeth emily emma emmanuel ernest eugene eva florence frances francis frederick gabriel
geoffrey george gertrude gloria greta gregory harold harriet helen henrietta henry herbert hubert hugh imogen ingrid irene
isabella isaac jacob jacqueline james jane janet jeffrey jennifer jessica joan john jonathan joseph josephine joshua judith
julia karen kasimir kendrick kenneth laura lawrence leonard lillian louis louise lucy margaret maria martha martin mary
matilda matthew maximilian michael nathaniel nicholas noemi octavia olivia oscar oswald pamela patricia patrick paul penelope
peter philip priscilla quentin rachel raymond rebecca richard robert ronald rosalind rudolph ruth samantha samuel sarah
sebastian simon sophia stanley stephanie stephen susan susannah sylvester theodore theresa thomas timothy ulrich una valentina
victor victoria vincent virginia walter william winifred xavier yolanda yvette zachary zelda
""".split()
SHORT = {
    "alexander": "lex alec sasha xander", "andrew": "drew", "anthony": "tony", "barbara": "babs", "beatrice": "trixie bee",
    "catherine": "kate kathy kitty katie kat cat", "charles": "charlie charley chuck chaz", "christopher": "kit topher", "dmitri": "dima mitya",
    "dorothy": "dot dottie dolly", "edmund": "ned ted teddy", "edward": "ned ted teddy", "eleanor": "nora nell nellie",
    "elizabeth": "liz lizzie beth betty betsy bess eliza libby", "emmanuel": "manny", "florence": "flossie",
    "frances": "fanny fran frankie", "francis": "frank", "gabriel": "gabe", "gregory": "gregg", "harold": "hal harry",
    "henrietta": "hettie etta", "henry": "hank hal harry", "hubert": "bert bertie", "isabella": "bella izzy", "jacqueline": "jackie jacqui",
    "james": "jim jimmy", "john": "jack johnny", "joseph": "joe joey", "leonard": "len lenny leo", "jonathan": "jonny johnny", "lawrence": "larry laurie", "lillian": "lily lilly",
    "louise": "lulu", "margaret": "meg peggy maggie peg greta daisy", "matilda": "tilly tilda mattie", "michael": "mick mike mickey",
    "nathaniel": "nate nat", "octavia": "tavy tavia", "olivia": "livvy liv", "oswald": "ozzie oz", "patricia": "trish tricia patsy",
    "penelope": "nell", "priscilla": "cilla prissy", "rebecca": "becca becky", "richard": "dick rick ricky", "robert": "bob bobby bert",
    "ronald": "ron", "rosalind": "roz rosie ros", "sarah": "sally", "stephen": "steve", "susannah": "sue susie suzy", "susan": "sue suzy",
    "sylvester": "sly", "theodore": "ted teddy", "thomas": "tom tommy", "timothy": "tim", "valentina": "val tina",
    "victoria": "tori vicky", "virginia": "ginny", "william": "bill billy will willy", "winifred": "freddie win", "yolanda": "yoli",
    "xavier": "xavi zavi", "zachary": "zack", "kasimir": "kaz", "quentin": "quin", "rudolph": "rolf", "ulrich": "uli ulli",
}
TITLES = "dr prof professor capt captain rev sir lady lord mr mrs ms miss mx jr sr ii iii iv phd md hon col maj lt sgt the of".split()
ROLES = (
    "mom mum mama mother dad papa father grandma granny nana grandmother grandpa grandad granddad grandfather aunt auntie uncle cousin coach"
    " teacher neighbour neighbor brother sister son daughter baby kid birthday friend me myself wife husband boss nanny niece nephew godmother godfather"
    " 엄마 아빠 어머니 아버지 할머니 할아버지 이모 고모 삼촌 언니 누나 오빠 형 동생 아들 딸 친구 선생님"
).split()
KINDS = (
    "association band choir chamber church club college committee company council cycling fire football foundation garden group hiking hospital"
    " institute league library museum orchestra photo primary rowing running sailing school scouts service society swimming team tennis theatre"
    " trust union university youth chess drama ladies mens village community history brass allotment bowling cricket rugby hockey secondary high"
).split()
KIND_SHORT = {"assn": "association", "assoc": "association", "ch": "chamber", "gdn": "garden", "grp": "group", "soc": "society", "sch": "school", "prim": "primary", "cyc": "cycling", "ftbl": "football", "comm": "committee", "orch": "orchestra", "univ": "university"}
LEGAL = {"ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "llc": "llc", "plc": "plc", "gmbh": "gmbh", "ag": "ag", "bv": "bv", "kg": "kg"}
PARTICLES = "van von der den de la le di da del dos du ter ten zu zum bin al".split()
#: Korean family names that open a name written in one word.
FAMILY_KO = "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 전 홍 고 문 양 손 배 백 허 유 남 심 노 하 곽 성 차 주 우 구 민 진 지 엄 채 원 천 방 공 남궁 황보 제갈 선우".split()
_PLACEHOLDER = re.compile(r"^(?:person|people|unknown|unnamed|unidentified|untitled|anonymous|nobody|someone|face|cluster|group|user|guest|new person|no name|name|n/?a|none|null|tbd|test|인물|사람|미상|이름없음)?[\s_#:.-]*\d*$", re.I)
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "ʼ": "'"})
_HANGUL = re.compile("[가-힣]+")


#: Letters from which the index holds halves of a token instead of all that is left after deleting one letter.
LONG_TOKEN = 64


#: Largest cost a word of two names that align: an initial next to a slip, 0.6 over two words, is within.
NEAR = 0.32


def slips(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours between two tokens."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _stem(short: str) -> str:
    stem = re.sub(r"(?:ie|ey|y|i)$", "", short)
    if stem != short:
        stem = re.sub(r"ck$", "c", re.sub(r"([^aeiou])\1$", r"\1", stem))
    return re.sub(r"ck$", "c", stem) if len(stem) > 3 else stem


class Lexicon:
    """What is known of names beside the tables: forenames, their short forms, role words, kinds of organisation.

    ``short`` maps a full forename to its irregular short forms, and may be handed in as a table of another language;
    forenames that no list has are told by their place in the name, and match by initials, beginnings and slips alone.
    """

    def __init__(self, forenames: Iterable[str] = FORENAMES, short: dict[str, str] | None = None, roles: Iterable[str] = ROLES, kinds: Iterable[str] = KINDS) -> None:
        short = SHORT if short is None else short
        self.forenames = frozenset(forenames) | frozenset(short)
        self.roles, self.kinds, self.titles = frozenset(roles), frozenset(kinds), frozenset(TITLES)
        self.listed: dict[str, set[str]] = {}
        for name, forms in short.items():
            for s in forms.split():
                self.listed.setdefault(s, set()).add(name)
        # beginnings of the forenames, bare or with a short ending after a consonant: for slips in regular short forms
        self.regular: dict[str, set[str]] = {}
        for name in self.forenames:
            for n in range(2, min(6, len(name) - 1)):
                ends = ("", "y", "ie", name[n - 1] + "y", name[n - 1] + "ie")[0 if n > 2 else 3 :]
                for end in ends if name[n - 1] not in "aeiouy" else ends[:1] if n > 2 else ():
                    if len(name[:n] + end) >= 4:
                        self.regular.setdefault(name[:n] + end, set()).add(name)
        self._known: dict[str, tuple[int, frozenset[str]]] = {}

    def standing(self, token: str) -> tuple[int, frozenset[str]]:
        """(how sure, the full forenames a token may stand for): 3 a forename, 2 a listed short form, 1 by rule or by one
        slip, 0 none."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) > 100_000:
                self._known.clear()
            found = self._known[token] = self._standing(token)
        return found

    def _standing(self, token: str) -> tuple[int, frozenset[str]]:
        if token in self.forenames:
            return 3, frozenset([token])
        if token in self.listed:
            return 2, frozenset(self.listed[token])
        names = frozenset()
        if 2 <= len(token) <= 7:
            stem = _stem(token)
            names = frozenset(n for n in self.forenames if len(stem) >= 2 and n.startswith(stem) and len(n) - len(stem) >= 2 and len(n) > len(token))
            if not names and len(token) >= 4 and any(n.endswith(token) for n in self.forenames):
                names = frozenset({n for n in self.forenames if n.endswith(token)}.union(*(ns for s, ns in self.regular.items() if slips(s, token))))
            elif stem == token and len(token) > 5:
                names = frozenset()
        if not names and len(token) >= 3:
            names = frozenset(n for n in self.forenames if slips(n, token))
            names = names or frozenset(n for s, ns in self.listed.items() if len(s) >= 4 and slips(s, token) for n in ns)
            if not names and 4 <= len(token) <= 8:
                names = frozenset(n for s, ns in self.regular.items() if slips(s, token) for n in ns)
        return (1 if names else 0), names

    def forenames_of(self, token: str) -> frozenset[str]:
        return self.standing(token)[1]

    def kind(self, token: str) -> str | None:
        if token in self.kinds:
            return token
        if token in KIND_SHORT:
            return KIND_SHORT[token]
        near = [k for k in self.kinds if len(token) >= 5 and slips(k, token)]
        return near[0] if len(near) == 1 else None

    def parse(self, name: str | None) -> list[tuple[str, str, str, str]]:
        """(core, companion, sort, words) of a name; sort is full, turned (the other order where no forename is known),
        unclear (several forenames), initial, acronym, org; words are all its tokens in alphabetical order. Empty: nobody."""
        if not name or _PLACEHOLDER.match(name.strip()):
            return []
        text = re.sub(r"([^\W\d_])(?<=[a-zß-ÿ])(?=[A-Z][a-z])", r"\1 ", name)  # words run together
        mixed = any(c.islower() for c in text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(_LETTERS)
        text = unicodedata.normalize("NFC", text)
        text = re.sub(r"\([^)]*\)|\[[^\]]*\]|\"[^\"]*\"", " ", text)
        head, comma, tail = text.partition(",")
        if comma and tail.strip() and not self.titles & set(re.findall(r"[^\W\d_]+", tail.lower())):
            text = f"{tail} {head}"
        spelled = [t.strip("'") for t in re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", text)]
        loud = {t.lower() for t in spelled if mixed and 2 <= len(t) <= 4 and t.isupper()}
        tokens = [t.lower() for t in spelled if t.lower() not in self.titles]
        named = [t for t in tokens if t not in self.roles]
        if len(named) < len(tokens) and len(named) < 2:
            return []
        if named and all(_HANGUL.fullmatch(t) for t in named):
            whole = "".join(named)  # family name and forename are written in one word or apart
            apart = len(named) > 1 and len(named[0]) <= 2 and len(whole) >= 3
            return [(whole, "", "full", whole)] if apart or 3 <= len(whole) <= 4 and (whole[0] in FAMILY_KO or whole[:2] in FAMILY_KO) else []
        long = [t for t in named if len(t) > 1]
        legal = [LEGAL[t] for t in long if t in LEGAL]
        if legal and len(long) > len(legal):
            return [("-".join(t for t in long if t not in LEGAL), legal[-1], "org", _words([t for t in long if t not in LEGAL]))]
        kinds = [k for t in long if (k := self.kind(t))]
        core = [t for t in long if not self.kind(t)]
        if len(kinds) >= 2 and core:
            return [("-".join(core), "+".join(sorted(kinds)), "org", _words([*core, *kinds]))]
        plain = [t for t in long if t not in PARTICLES]
        long = plain if len(plain) >= 2 or len(plain) == 1 and len(long) > 1 and len(named) > len(long) else long
        if not long:
            return []
        out = []
        if len(long) == 2 and not kinds:
            own, short = sorted(long, key=len, reverse=True)
            if 2 <= len(short) <= 4 and not self.forenames_of(short) and len(own) > len(short) and self.standing(own)[0] < 2:
                if short in loud or len(short) <= 3 and not set(short) & set("aeiouy"):
                    return [(own, short, "acronym", _words(named))]
                out.append((own, short, "acronym", _words(named)))
        if len(long) == 1:
            initials = [t for t in named if len(t) == 1]
            if not initials or named[-1] == initials[-1] and self.forenames_of(long[0]) or len(long[0]) < 4:
                return []  # a bare name, or a forename with the initial of a family name
            return [(part, initials[0], "initial", _words(named)) for part in _parts(long[0])]
        sure = {t: self.standing(t)[0] for t in long}
        given = [t for t in long if sure[t] >= 2 or sure[t] == 1 and t == long[0]]
        if len(given) == len(long) or not given:  # the order decides; the other order is possible where nothing is known
            first, last = long[0], long[-1]
            orders = [(last, first)] if given else [(last, first), (first, last)]
        else:
            first = max(given, key=lambda t: (sure[t] >= 2, -long.index(t)))
            rest = [t for t in long if t not in given]
            orders = [(rest[-1] if long[0] == first else rest[0], first)]
            if sure[first] == 1 and len(long) == 2 and sure[long[1]] == 1:
                orders.append((first, long[1]))  # either may be the forename
        for turned, (last, first) in enumerate(orders):
            full = sorted(self.forenames_of(first))
            comp, sort = (full[0], "full") if len(full) == 1 else (first, "unclear" if full else "turned" if turned else "full")
            out += [(part, comp, sort, _words(named)) for part in _parts(last)]
        return out

    def token_cost(self, a: str, b: str) -> float:
        """0 for equal tokens, less than 1 where one may stand for the other, 1 otherwise."""
        if a == b:
            return 0.0
        if _HANGUL.search(a) or _HANGUL.search(b):
            return 1.0  # another syllable is another name
        if len(a) == 1 or len(b) == 1:
            return 0.4 if a[0] == b[0] else 1.0
        if min(len(a), len(b)) >= 4 and slips(a, b):
            return 0.2
        if self.forenames_of(a) & self.forenames_of(b):
            return 0.3
        short, long = sorted((a, b), key=len)
        if len(short) >= 3 and long.startswith(short):
            return 0.4
        if len(short) <= 4 and long.startswith(short[0]) and re.match(".*".join(map(re.escape, short)), long):
            return 0.4
        return 1.0

    def align(self, a: list[str], b: list[str]) -> float:
        """Cost of the optimal assignment of the tokens of two names, shared over the shorter one's tokens."""
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 1.0
        n = len(a)
        if n > 8:  # equal words of long names first; with more than 8 others no pair is near
            common = Counter(a) & Counter(b)
            a, b = list((Counter(a) - common).elements()), list((Counter(b) - common).elements())
            if len(a) > 8:
                return 1.0
        best = [0.0] + [9.0 * n] * ((1 << len(a)) - 1)  # by the words of ``a`` that have a partner
        for y in b:
            costs = [self.token_cost(x, y) for x in a]
            nxt = best[:]
            for used, cost in enumerate(best):
                if cost < 9 * n:
                    for j, c in enumerate(costs):
                        if not used >> j & 1:
                            nxt[used | 1 << j] = min(nxt[used | 1 << j], cost + c)
            best = nxt
        return best[-1] / n

    def same_words(self, a: str, b: str, acronym: str | None = None) -> bool:
        """Whether the words of two names align: each of the shorter name stands for one of the other's. ``acronym``
        stands for all kinds of organisation in ``b``."""
        x, y = a.split(" "), b.split(" ")
        if acronym is not None:
            y = [t for t in y if not self.kind(t)] + [acronym]
        cost = self.align(x, y)
        return cost <= NEAR and cost * min(len(x), len(y)) < 0.999  # a word without a partner costs 1


def _parts(token: str) -> list[str]:
    return [p for p in token.split("-") if len(p) >= 3] or [token]


def _words(tokens: list[str]) -> str:
    return " ".join(sorted(p for t in tokens for p in t.split("-") if p))


def _aliases(text: str | None) -> list[str]:
    try:
        value = json.loads(text) if text else []
    except ValueError:
        return [text]  # a plain name instead of a list
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def _mentions(lexicon: Lexicon):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, aliases in zip(b["id"], b["name"], b["aliases"]):
                for n in dict.fromkeys([name, *_aliases(aliases)]):
                    rows += [(i, *node) for node in lexicon.parse(n)]
            yield pd.DataFrame(rows, columns=["id", "core", "companion", "sort", "words"]).astype({"id": "int64"})

    return read


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(token, other), both ways: pairs of distinct ``token`` values one slip apart, by a symmetric-delete index.

    Its size is the square of a token's length, so tokens longer than ``LONG_TOKEN`` are indexed by their halves: one
    slip leaves one half as it is. Tokens of exactly that length are in both, to meet neighbours on either side.
    """
    cuts = tokens.select("token").distinct().where((F.length("token") >= 3) & ~F.col("token").rlike("[가-힣]")).withColumn("n", F.length("token"))
    one_less = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.col("n"))))
    # a slip leaves the first or the last half of a long token alone, up to the letter at the middle
    halves = F.flatten(F.transform(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1), lambda m: F.array(F.md5(F.concat(F.lit("<"), m, F.substring("token", F.lit(1), F.floor(m / 2).cast("int") - 1))), F.md5(F.concat(F.lit(">"), m, F.substring("token", F.col("n") - F.floor(m / 2).cast("int") + 2, F.col("n")))))))
    spread = F.when(F.col("n") <= LONG_TOKEN, F.array_union(F.array("token"), one_less)).otherwise(F.array())
    spread = F.when(F.col("n") >= LONG_TOKEN, F.concat(spread, halves)).otherwise(spread)
    cuts = cuts.select("token", F.explode(spread).alias("cut"))
    pairs = cuts.alias("a").join(cuts.alias("b"), "cut").where(F.col("a.token") < F.col("b.token")).select(F.col("a.token").alias("token"), F.col("b.token").alias("other")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[slips(x, y) for x, y in zip(b["token"], b["other"])]]

    pairs = cut_lineage(pairs.mapInPandas(verify, "token string, other string"))
    return pairs.unionByName(pairs.select(F.col("other").alias("token"), F.col("token").alias("other")))


def _aligned(pairs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Pairs of nodes (..., words, words2) whose words align."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            acronyms = [g if s == "acronym" else None for g, s in zip(b["companion"], b["sort"])]
            yield b[[lexicon.same_words(x, y, g) for x, y, g in zip(b["words"], b["words2"], acronyms)]]

    return pairs.mapInPandas(check, pairs.schema)


def entities(people: DataFrame, id_col: str = "id", name_col: str = "display_name", alias_col: str = "aliases_json", lexicon: Lexicon | None = None) -> DataFrame:
    """(id, entity): rows that name somebody, with the number of their entity."""
    lexicon = lexicon or Lexicon()
    rows = people.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(alias_col).cast("string").alias("aliases")).where("id is not null")
    mentions = cut_lineage(rows.mapInPandas(_mentions(lexicon), "id long, core string, companion string, sort string, words string").distinct())
    key = lambda c, g, w: F.xxhash64(F.col(c), F.col(g), F.col(w))
    nodes = cut_lineage(mentions.select("core", "companion", "sort", "words").distinct())
    near = similar_tokens(nodes.select(F.col("core").alias("token")))
    sure = nodes.where("sort in ('full', 'turned', 'unclear', 'org')")
    renamed = lambda df: df.select(*[F.col(c).alias(c + "2") for c in ("core", "companion", "words")])
    other = renamed(sure)
    # the same core and companion among different words: all meet the two words alone, or else each other
    spelled = nodes.select("core", "companion", "words").distinct().withColumn("n", F.size(F.split("words", " ")))
    hub = spelled.groupBy("core", "companion").agg(F.count("*").alias("many"), F.min(F.struct("n", "words")).alias("hub")).where("many > 1")
    spelled = spelled.withColumn("sort", F.lit("full")).join(hub, ["core", "companion"])
    short = spelled.where("hub.n <= 2 and words <> hub.words").select("core", "companion", "sort", "words", F.col("core").alias("core2"), F.col("companion").alias("companion2"), F.col("hub.words").alias("words2"))
    spelled = spelled.where("hub.n > 2")
    each = spelled.join(renamed(spelled), (F.col("core") == F.col("core2")) & (F.col("companion") == F.col("companion2")) & (F.col("words") < F.col("words2")))
    # the same companion under a similar core
    typed = sure.join(near, F.col("core") == F.col("token")).where("core < other").join(other, (F.col("other") == F.col("core2")) & (F.col("companion") == F.col("companion2")))
    # similar companions that no list explains, under the same core or a similar one
    unknown = nodes.where("sort in ('full', 'turned')").select("companion").distinct()
    unknown = unknown.mapInPandas(lambda it: (b[[not lexicon.forenames_of(x) for x in b["companion"]]] for b in it), "companion string")
    close = similar_tokens(unknown.select(F.col("companion").alias("token")))
    around = near.select(F.col("token").alias("here"), F.col("other").alias("there")).unionByName(sure.select(F.col("core").alias("here"), F.col("core").alias("there")).distinct())
    slipped = sure.join(close, F.col("companion") == F.col("token")).where("companion < other").join(around, F.col("core") == F.col("here")).join(other, (F.col("there") == F.col("core2")) & (F.col("other") == F.col("companion2")))
    cols = ["core", "companion", "sort", "words", "core2", "companion2", "words2"]
    links = short.select(*cols)
    for part in (each, typed, slipped):
        links = links.unionByName(part.select(*cols))
    links = _aligned(links, lexicon)
    own = mentions.groupBy("id").agg(F.min(key("core", "companion", "words")).alias("a"))  # a row's names belong together
    joined = mentions.join(own, "id").select("a", key("core", "companion", "words").alias("b"))
    hard = cut_lineage(links.select(key("core", "companion", "words").alias("a"), key("core2", "companion2", "words2").alias("b")).unionByName(joined).where("a <> b").distinct())
    whole = components(hard)

    # initials, ambiguous short forms, acronyms and beginnings: only where they fit exactly one of that core (or of similar cores)
    doubtful = nodes.where("sort in ('initial', 'unclear', 'acronym', 'full')")
    wide = doubtful.withColumn("look", F.col("core")).unionByName(doubtful.join(near, F.col("core") == F.col("token")).select("core", "companion", "sort", "words", F.col("other").alias("look")))

    def options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, g, s, w, k in zip(b["core"], b["companion"], b["sort"], b["words"], b["look"]):
                if s == "full":
                    wanted = ["^" + g] if 3 <= len(g) <= LONG_TOKEN and not lexicon.forenames_of(g) else []
                else:
                    wanted = sorted(lexicon.forenames_of(g)) if s == "unclear" else ["=" + g]
                out += [(c, g, s, w, k, x) for x in wanted]
            yield pd.DataFrame(out, columns=["core", "companion", "sort", "words", "look", "want"])

    def offers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, g, s, w in zip(b["core"], b["companion"], b["sort"], b["words"]):
                if s == "org" and g.count("+") < 4:
                    given = {"=" + "".join(p) for p in itertools.permutations(k[0] for k in g.split("+"))}
                else:
                    given = {g, "=" + g[:1]} if s in ("full", "turned") else set()
                if s == "full":
                    given |= {"^" + g[:n] for n in range(3, min(len(g) - 1, LONG_TOKEN + 1))}
                out += [(c, g, w, x) for x in given]
            yield pd.DataFrame(out, columns=["core2", "companion2", "words2", "offer"])

    asked = wide.mapInPandas(options, "core string, companion string, sort string, words string, look string, want string")
    offered = sure.mapInPandas(offers, "core2 string, companion2 string, words2 string, offer string")
    met = asked.join(offered, (F.col("look") == F.col("core2")) & (F.col("want") == F.col("offer"))).select(*cols).distinct()
    met = _aligned(met, lexicon).withColumn("b", key("core2", "companion2", "words2"))
    met = met.join(whole, F.col("b") == F.col("node"), "left").withColumn("to", F.coalesce("component", "b"))
    mine = met.withColumn("a", key("core", "companion", "words")).where("a <> b")
    soft = mine.groupBy("a").agg(F.min("to").alias("b"), F.max("to").alias("top")).where(F.col("b") == F.col("top")).select("a", "b")
    final = components(hard.unionByName(soft))
    placed = mentions.select("id", key("core", "companion", "words").alias("at")).join(final, F.col("at") == F.col("node"), "left")
    return placed.groupBy("id").agg(F.min(F.coalesce("component", "at")).alias("entity"))


def same_pairs(people: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: two rows of one entity."""
    with scratch() as keep:
        e = keep(entities(people, lexicon=lexicon))
    return e.select(F.col("id").alias("id_a"), "entity").join(e.select(F.col("id").alias("id_b"), "entity"), "entity").where("id_a < id_b").select("id_a", "id_b")
