"""Variant spellings of names: phonetic codes of sorted tokens as blocks, Jaro-Winkler with a nickname table, connected components.

A name is read as a person (given name or its initial, and the other names), an organisation (its kind and proper part) or a mission (its
proper part and number). Names that read alike form a node. Nodes of one scope and one given name, kind or number meet in a block if the phonetic codes
of their other tokens, sorted, are the same but for one token, or half of a single one is. They are linked if their tokens are alike by Jaro-Winkler and a few
edits, as written or as they sound. Partial names, such as a surname, an initial or an acronym, join the one entity of their scope that they fit, and none if they
fit several.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import is_blank, materialize, table
from .neardup import bucket_pairs

#: Nickname -> given names.
NICKNAMES = {
    k: v.split()
    for k, v in {
        "alex": "alexandre alexandra alexander", "xana": "alexandra", "sandra": "alexandra", "lexi": "alexandra", "xandre": "alexandre", "toni": "antonio", "to": "antonio", "tony": "antonio anthony",
        "bia": "beatriz", "cati": "catarina", "cat": "catarina", "chris": "christopher", "kit": "christopher", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "edu": "eduardo", "dudu": "eduardo", "ned": "edward", "ed": "edward eduardo",
        "eddie": "edward", "beth": "elizabeth", "liz": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "nanda": "fernanda", "chico": "francisco", "xico": "francisco", "paco": "francisco", "fred": "frederick", "freddie": "frederick",
        "fritz": "frederick", "gabi": "gabriela", "gui": "guilherme", "bela": "isabel", "belinha": "isabel", "bel": "isabel", "quim": "joaquim", "ze": "jose", "pepe": "jose", "josie": "josephine", "jo": "josephine", "kate": "katherine",
        "kitty": "katherine", "kathy": "katherine", "katie": "katherine", "nono": "leonor", "nonor": "leonor", "manel": "manuel", "manny": "manuel", "meg": "margaret", "peggy": "margaret", "maggie": "margaret", "guida": "margarida", "nick": "nicholas", "nicky": "nicholas",
        "bob": "robert", "rob": "robert", "bobby": "robert", "sam": "samuel", "tete": "teresa", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "tom": "tomas thomas", "val": "valentim", "bill": "william", "will": "william", "billy": "william",
        "zu": "zulmira", "ben": "benjamin", "dan": "daniel", "jim": "james", "jack": "john", "mike": "michael", "dick": "richard", "rick": "richard", "joe": "joseph",
    }.items()
}
#: Words before a name, and roles that alone name nobody.
TITLES = set("dr dra doutor doutora prof professor professora sr sra senhor senhora dona dom d. tio tia capitao capita mr mrs ms miss cmdr commander capt captain astronaut astronauta cosmonaut comandante col eng sir lady padre frei coronel major general the o a".split())
ROLES = set("mae pai guarda narrador narradora velho velha capitulo acho pagina rei rainha menino menina doutor rapaz homem mulher filho filha avo report relatorio today first second third fifth decades thousands".split())
#: Words of organisations' names and their usual abbreviations; "" is left out.
ORG_WORDS = {
    "agencia": "agency", "agency": "agency", "ag": "agency", "espacial": "space", "space": "space", "launch": "launch", "systems": "systems", "system": "systems", "sys": "systems", "orbital": "orbital", "research": "research", "res": "research",
    "institute": "institute", "inst": "institute", "instituto": "institute", "council": "council", "coun": "council", "conselho": "council", "center": "center", "centre": "center", "centro": "center", "university": "university", "univ": "university",
    "corporation": "", "corp": "", "company": "", "co": "", "limited": "", "ltd": "", "inc": "", "lda": "", "of": "", "de": "", "do": "", "da": "", "for": "", "and": "", "the": "",
}
EXPANDED = {"ori": ["institute", "orbital", "research"]}
LONG_ORG_WORDS = [w for w in ORG_WORDS if len(w) > 5]
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}
ROMAN = {w: i for i, w in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
#: Spellings of one sound, the longer ones first; then letters of one group.
SPELLINGS = [("sch", "s"), ("ph", "f"), ("th", "t"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("gh", "g"), ("qu", "k"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("ie", "i"), ("v", "f"), ("y", "i"), ("z", "s"), ("x", "s"), ("q", "k"), ("c", "k")]
SOUNDS = str.maketrans("pqkgtvynzxç", "bccgdfimssc")
#: Words within a person's name that are left out or kept at will.
PARTICLES = set("da de do das dos del della der den di du la las le les los van von zu".split())
#: Words of given names that go to the driver, the most frequent ones.
MOST_GIVEN = 100_000
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+\.?")
DASHES, LETTER, NO_NAME = regex.compile(r"[‐-―−]"), regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{N}(\"']")
CAPITALS, IN_BRACKETS, SERIES = regex.compile(r"\p{Lu}{3,6}"), regex.compile(r"\(\p{Lu}{2,6}\)"), regex.compile(r"(\p{L}{3,})-?(\d{1,2})")
#: A word is a given name if it is in names of this share of all scopes, and of three at least.
COMMON = 0.05


def folded(w: str) -> str:
    w = "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c)).replace("ß", "ss")
    return w.replace("vv", "w").replace("rn", "m")


class Sounds(dict):
    """Word to (as it sounds, its phonetic code); bounded.

    As it sounds: spellings of one sound made one, doubled letters single, no h. The code: its first letter, its consonants in groups, and the
    vowel it ends in, which tells Maria from Mario.
    """

    def __missing__(self, w: str) -> tuple[str, str]:
        if len(self) > 1 << 18:
            self.clear()
        s = w
        for a, b in SPELLINGS:
            s = s.replace(a, b)
        s = regex.sub(r"(.)\1+", r"\1", s.replace("h", "") or s)
        body = regex.sub(r"[aeiou]", "", s[1:]).translate(SOUNDS)
        code = s[:1].translate(SOUNDS) + regex.sub(r"(.)\1+", r"\1", body) + (s[-1] if len(s) > 1 and s[-1] in "aeiou" else "")
        v = self[w] = s, code
        return v


KNOWN = Sounds()


def sound(w: str) -> str:
    return KNOWN[w][0]


def phonetic(w: str) -> str:
    return KNOWN[w][1]


def sorted_tokens(ws: list[str]) -> str:
    return " ".join(sorted(ws, key=lambda w: (phonetic(w), w)))


def letters(w: str) -> str:
    """Digits that were read for letters."""
    return w.replace("0", "o").replace("1", "l").replace("5", "s")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbours exchanged as one edit, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return rows[-1][-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, match = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                match.append(x)
                break
    m = len(match)
    if not m:
        return 0.0
    other = [y for y, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(match, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


def halves(core: str) -> list[str]:
    """Phonetic codes of the first and the last half, of either length that one edit may leave."""
    s = core.translate(SOUNDS)
    n = len(s)
    if n < 4:
        return [f"={s}"]
    return sorted({f"<{s[:k]}" for k in (n // 2, (n + 1) // 2)} | {f">{s[n - k :]}" for k in (n // 2, (n + 1) // 2)})


def blocks(core: str) -> list[str]:
    """Keys of the blocks of a proper part: the phonetic codes of its tokens, sorted, all and without each one, and the halves of it as one word."""
    codes = [phonetic(w) for w in core.split(" ")]
    less = {"-" + " ".join(codes[:i] + codes[i + 1 :]) for i in range(len(codes))} if len(codes) > 1 else set()
    return sorted({"~" + " ".join(codes)} | less | set(halves(core.replace(" ", ""))))


def alike(kind: str, a: str, b: str) -> bool:
    """Whether two proper parts are spellings of one: as words, token by token or as one word, or as they sound."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) > 1:
        # each token takes the most similar one left; one edit in all for each two tokens
        left, cost = list(y), 0
        for w in x:
            v = max(left, key=lambda v: (jaro_winkler(w, v), v))
            left.remove(v)
            if w != v and sound(w) != sound(v):
                if jaro_winkler(w, v) < 0.88:
                    break
                cost += edits(w, v, 2)
        else:
            if cost <= max(1, len(x) // 2):
                return True
    a, b = "".join(x), "".join(y)
    most = 2 if kind == "P" and min(len(a), len(b)) > 8 else 1
    if min(len(a), len(b)) < 4:
        return False
    return sound(a) == sound(b) or jaro_winkler(a, b) >= 0.88 and edits(a, b, most) <= most


class Givens:
    """Given names with their spellings of one edit."""

    def __init__(self, names: set[str]):
        self.nick = {folded(k): [folded(v) for v in vs] for k, vs in NICKNAMES.items()}
        self.names = names | set(self.nick) | {v for vs in self.nick.values() for v in vs}
        self.near: dict[str, set[str]] = {}
        self.by_code: dict[str, list[str]] = {}
        for n in self.names:
            if len(n) > 3:
                for d in self._cut(n):
                    self.near.setdefault(d, set()).add(n)

    @staticmethod
    def _cut(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    def of(self, w: str) -> list[str]:
        """The given names that a word may stand for; none if it is not one."""
        if w in self.nick:
            return self.nick[w]
        if w in self.names:
            return [w]
        if len(w) < 4:
            return []
        found = {n for d in self._cut(w) for n in self.near.get(d, ()) if edits(w, n, 1) <= 1}
        return sorted(found) if len(found) == 1 else []

    def sounding(self, w: str) -> list[str]:
        """The one given name that sounds like a word, or else its phonetic code."""
        if not self.by_code:
            for n in self.names:
                self.by_code.setdefault(phonetic(n), []).append(n)
        found = self.by_code.get(phonetic(w), [])
        return found if len(found) == 1 else [f"~{phonetic(w)}"]


def org_word(w: str) -> str | None:
    """The standard form of a word of organisations' names, None for another word."""
    if w in ORG_WORDS:
        return ORG_WORDS[w]
    if len(w) > 4:
        for o in LONG_ORG_WORDS:
            if abs(len(o) - len(w)) < 2 and (o[:2] == w[:2] or o[-3:] == w[-3:]) and edits(o, w, 1) <= 1:
                return ORG_WORDS[o]
    return None


def read_name(name: str, givens: Givens) -> tuple[str, list[str], str, list[str]] | None:
    """(kind, qualifiers, core, acronyms); kinds: P full person, I initial and surname, S surname, G given name, O, A acronym, M. None: names nobody."""
    text = DASHES.sub("-", name.replace(" ", " ")).strip()
    if not LETTER.search(text) or NO_NAME.match(text):
        return None
    bare = text.replace(".", "").strip()
    if CAPITALS.fullmatch(bare) and ("." in text[:-1] or len(bare) < 6):
        acronym = ("A", [], folded(bare), [])
    else:
        acronym = None
    text = IN_BRACKETS.sub(" ", text)
    comma = text.count(",") == 1
    head, _, tail = text.partition(",")
    words = WORDS.findall(f"{tail} {head}" if comma else text)
    toks = [(folded(w.rstrip(".")), w.endswith(".")) for w in words]
    if sum(len(w) == 1 for w, _ in toks) > 2:
        return acronym
    # organisations: two of their words at least, or one and a known short form
    org = [org_word(letters(w)) for w, _ in toks]
    kind = sorted({o for o in org if o} | {x for w, _ in toks for x in EXPANDED.get(w, ())})
    if len(kind) >= 2:
        core = sorted_tokens([letters(w) for (w, _), o in zip(toks, org) if o is None and w not in EXPANDED])
        plain = [letters(folded(w.rstrip("."))) for w in WORDS.findall(text)]
        initials = "".join(w[0] for w in plain if org_word(w) != "" and w not in EXPANDED) if not any(w in EXPANDED for w in plain) else "".join(w if w in EXPANDED else w[0] for w in plain if org_word(w) != "")
        return ("O", [" ".join(kind)], core, [initials]) if len(core) > 2 else acronym
    kept = [(w, dot) for w, dot in toks if w not in TITLES and w not in ("mission", "no", "missao")]
    marked = len(kept) < len(toks) and any(w in ("mission", "no", "missao") for w, _ in toks)
    if not kept or all(w in ROLES for w, _ in kept):
        return None
    # missions: a proper part and a number
    one = SERIES.fullmatch(kept[0][0]) if len(kept) == 1 else None
    if one:
        return "M", [one[2]], one[1], []
    if len(kept) == 2 and not kept[0][1]:
        w, n = kept[0][0], kept[1][0]
        number = int(n) if n.isdigit() and len(n) < 3 else NUMBERS.get(n) or (None if kept[1][1] or kept[1][0] in givens.names or (len(n) == 1 and givens.of(letters(w))) else ROMAN.get(n))
        if number and len(w) > 2 and not w.isdigit():
            return "M", [str(number)], letters(w), []
    if marked and len(kept) != 1:
        return None
    kept = [(letters(w), dot) for w, dot in kept]
    if any(c.isdigit() for w, _ in kept for c in w):
        return None
    if len(kept) > 2:
        proper = [(w, dot) for w, dot in kept if w not in PARTICLES]
        kept = proper if len(proper) > 1 else kept
    # persons
    starts = [w for w, dot in kept if len(w) == 1 or (dot and len(w) == 3 and w not in givens.nick)]
    full = [w for w, dot in kept if w not in starts]
    if not full:
        return None
    if len(full) == 1:
        w = full[0]
        if starts:
            return "I", [starts[0]], w, []
        g = givens.of(w) if w in givens.names or len(toks) == 1 or len(kept) < len(toks) else []
        if g and (w in givens.names or len(w) > 3):
            return "G", g, "", []
        return acronym or ("S", [], w, []) if len(w) > 3 else acronym
    exact = [i for i, w in enumerate(full) if w in givens.names]
    near = exact or [i for i, w in enumerate(full) if givens.of(w)]
    if not near:
        return "P", givens.sounding(full[0]), sorted_tokens(full[1:]), []
    rest = sorted_tokens([w for i, w in enumerate(full) if i != near[0]])
    return "P", givens.of(full[near[0]]), rest, []


def read_names(names: DataFrame, common: set[str]) -> DataFrame:
    """(scope, name) to (scope, name, kind, quals, core, acronyms, codes)."""
    kept = names.sparkSession.sparkContext.broadcast(common)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        givens, keys = Givens(kept.value), {}

        def keys_of(core: str) -> list[str]:
            if (k := keys.get(core)) is None:
                if len(keys) > 1 << 16:
                    keys.clear()
                k = keys[core] = blocks(core)
            return k

        for b in batches:
            rows = [(s, n, *r, keys_of(r[2])) for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := read_name(n, givens))]
            c = list(zip(*rows)) or [[]] * 7
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["scope", "name", "kind", "quals", "core", "acronyms", "codes"])

    return names.select("scope", "name").mapInArrow(go, "scope string, name string, kind string, quals array<string>, core string, acronyms array<string>, codes array<string>")


def common_words(names: DataFrame) -> set[str]:
    """Words in names of COMMON of all scopes, the MOST_GIVEN most frequent ones, so that they can go to the driver."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = {(s, w) for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in map(folded, (w for w in regex.findall(r"\p{L}{3,}", n) if not w.isupper()))}
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["scope", "word"])

    scopes = names.agg(F.count_distinct("scope")).first()[0]
    df = names.select("scope", "name").mapInArrow(go, "scope string, word string").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    df = df.filter(F.col("n") >= max(3, COMMON * scopes)).orderBy(F.col("n").desc(), "word").limit(MOST_GIVEN)
    return {r.word for r in df.toLocalIterator()} - TITLES - ROLES - set(ORG_WORDS) - set(NUMBERS) - set(ROMAN)


def _accepted(pairs: DataFrame) -> DataFrame:
    """Rows of pairs whose core_a and core_b are alike, with same: whether they are equal."""
    cols = pairs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(cols.index("core_a")).to_pylist(), b.column(cols.index("core_b")).to_pylist()
            k = b.column(cols.index("kind")).to_pylist()
            yield b.filter(pa.array([alike(*z) for z in zip(k, x, y)], pa.bool_()))

    return pairs.mapInArrow(go, pairs.schema)


def link_names(names: DataFrame) -> DataFrame:
    """(scope, name, entity) of the names that share an entity of their scope with another: scope string, name string in.

    NULL scopes, NULL and blank names, and words that name nobody are left out; repeated rows count once; no rows give no rows. Two
    proper parts that are alike but each borne by several names of the scope are different: a slip is seldom made twice.
    """
    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = names.select("scope", "name").filter(F.col("scope").isNotNull() & ~is_blank(F.col("name")))
    names = materialize(names.distinct(), "names")
    # reading a name takes long for its bytes, so the names are spread over a given number of tasks, not by size
    read = read_names(names.repartition(spread, "scope", "name"), common_words(names)).withColumn("node", F.xxhash64("scope", "kind", F.array_sort("quals"), "core"))
    read = materialize(read, "read")
    node = read.groupBy("node").agg(F.first("scope").alias("scope"), F.first("kind").alias("kind"), F.first("quals").alias("quals"), F.first("core").alias("core"), F.first("codes").alias("codes"), F.count(F.lit(1)).alias("n"))
    node = materialize(node, "nodes")
    whole = node.filter("kind in ('P', 'O', 'M')")
    keyed = whole.select("node", "scope", "kind", F.explode("quals").alias("qual"), "codes").select("node", "scope", "kind", "qual", F.explode("codes").alias("code"))
    met = bucket_pairs(keyed.select(F.col("node").alias("id"), F.xxhash64("scope", "kind", "qual", "code").alias("h")).distinct())
    side = lambda s: whole.select(F.col("node").alias(s), F.col("scope").alias(f"scope_{s}"), F.col("kind").alias(f"kind_{s}"), F.col("core").alias(f"core_{s}"), F.col("n").alias(f"n_{s}"))
    met = met.join(side("a"), "a").join(side("b"), "b").filter("scope_a = scope_b and kind_a = kind_b and (core_a = core_b or least(n_a, n_b) = 1)")
    edges = _accepted(met.select(F.col("kind_a").alias("kind"), "a", "b", "core_a", "core_b")).select("a", "b")
    entity = connected_components(edges)
    whole = materialize(whole.join(entity, "node", "left").select("node", "scope", "kind", "quals", "core", "codes", "n", F.coalesce("label", "node").alias("label")), "whole")
    person = whole.filter("kind = 'P'")
    # initials and surnames: the entities whose surname is alike, equal ones first
    part = node.filter("kind in ('I', 'S')").select("scope", F.col("node").alias("node_a"), F.col("kind").alias("part"), F.get("quals", F.lit(0)).alias("start"), F.col("core").alias("core_a"), F.col("n").alias("n_a"), F.explode("codes").alias("code"))
    have = person.select("scope", "label", "quals", F.col("core").alias("core_b"), F.explode("codes").alias("code"), F.col("n").alias("n_b"))
    fits = F.col("start").isNull() | F.exists("quals", lambda q: q.startswith(F.col("start")))
    met = part.join(have, ["scope", "code"]).filter(fits & ((F.col("core_a") == F.col("core_b")) | (F.col("n_a") == 1))).select(F.lit("S").alias("kind"), "node_a", "label", "core_a", "core_b").distinct()
    scored = _accepted(met).withColumn("same", F.col("core_a") == F.col("core_b"))
    fit = scored.groupBy("node_a").agg(F.max("same").alias("any"), F.count_distinct(F.when(F.col("same"), F.col("label"))).alias("n_same"), F.min(F.when(F.col("same"), F.col("label"))).alias("same"), F.count_distinct("label").alias("n_near"), F.min("label").alias("near"))
    count = F.when(F.col("any"), F.col("n_same")).otherwise(F.col("n_near"))
    joined = fit.select(F.col("node_a").alias("node"), F.when(count == 1, F.when(F.col("any"), F.col("same")).otherwise(F.col("near"))).alias("label"), (count > 1).alias("several"))
    # given names alone and acronyms: counted by scope, without pairs
    by_given = person.select("scope", F.explode("quals").alias("q"), "label").groupBy("scope", "q").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label"))
    given = node.filter("kind = 'G'").select("node", "scope", F.explode("quals").alias("q")).join(by_given, ["scope", "q"])
    by_initials = read.filter("kind = 'O'").select("node", "scope", F.explode("acronyms").alias("q")).join(whole.select("node", "label"), "node").groupBy("scope", "q").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label"))
    short = node.filter("kind = 'A'").select("node", "scope", F.col("core").alias("q")).join(by_initials, ["scope", "q"])
    counted = given.select("node", "k", "label").unionByName(short.select("node", "k", "label")).groupBy("node").agg(F.sum("k").alias("k"), F.min("label").alias("label"))
    joined = joined.unionByName(counted.select("node", F.when(F.col("k") == 1, F.col("label")).alias("label"), (F.col("k") > 1).alias("several")))
    labels = whole.select("node", "label", F.lit(False).alias("several")).unionByName(joined)
    return read.select("scope", "name", "node").join(labels, "node", "left").filter("not coalesce(several, false)").select("scope", "name", F.coalesce("label", "node").alias("entity"))


def scoped_names(spark, d: str) -> DataFrame:
    """(scope, name): a scope is a book, or a source; the prefix keeps them apart."""
    book, ties, wiki = (table(spark, d, t) for t in ("personagens_final", "relacoes_fortes", "wiki_human_spaceflight_entities"))
    of = lambda p, df, i, c: df.select(F.concat(F.lit(p), F.col(i)).alias("scope"), F.col(c).alias("name"))
    return of("b:", book, "livro_id", "personagem").unionByName(of("b:", ties, "livro_id", "source")).unionByName(of("b:", ties, "livro_id", "target")).unionByName(of("s:", wiki, "source_id", "text"))


def p1_entities(spark, d: str) -> DataFrame:
    """Each name with the least name of its entity in the scope and the number of its spellings."""
    links = link_names(scoped_names(spark, d))
    g = links.groupBy("scope", "entity").agg(F.min("name").alias("entity_name"), F.count_distinct("name").alias("spellings"))
    return links.join(g, ["scope", "entity"]).select(F.substring("scope", 3, 1 << 30).alias("scope_id"), "name", "entity_name", "spellings").distinct()


def p1_found(spark, d: str) -> DataFrame:
    links = materialize(link_names(scoped_names(spark, d)), "links")
    side = lambda s: links.select("scope", "entity", F.col("name").alias(f"name_{s}"))
    pairs = side("a").join(side("b"), ["scope", "entity"]).filter("name_a < name_b")
    return pairs.select(F.substring("scope", 3, 1 << 30).alias("scope_id"), "name_a", "name_b").distinct()
