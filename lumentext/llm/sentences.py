"""Sentence boundaries across languages and scripts: a hidden-event n-gram model.

Between any two words of a unit stands a hidden event, boundary or none; in scripts without blanks, between any two characters. The model is counted over
all texts without labels: ends and starts of units are certain boundaries, so a word that ends units as rarely as an abbreviation does is one.
Forward-backward posteriors over each unit's events decide.

Texts of most scripts mark their sentence ends, and there an event without a mark (in Thai, a blank) has no chance against the counts, so it is not looked
at: the odds of the others come from the mark with the word before it and the word that follows, each backing off to its class. In running text without any
mark, all events are open, and their odds are those of a trigram model over words and boundaries that backs off to bigrams and words. Its counts
are kept in Count-min tables of a fixed size, so what is broadcast does not grow with the data.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread, table
from .shingles import merged, mix

#: Marks with their closing marks. An event is there before a blank, in scripts without blanks at once, and where a blank was forgotten.
MARKED = re.compile(r"""[.!?…؟।॥]+["'”“»«’)\]›]*|[。！？｡]+["'”’)）」』]*""")
THAI = re.compile("[\u0e00-\u0e7f]")
THAI_BLANK = regex.compile(r"(?<=\p{Thai}[\p{Thai}\p{M}\p{N}]*)(?=\s+[\p{Thai}\p{N}])")
#: Quotations, within which no sentence ends; one that is never closed is none.
QUOTE = regex.compile(r"""["][^"]+["]|“[^”“]+”|„[^“”„]+[“”]|«[^»«]+»|»[^«»]+«|「[^」]+」|『[^』]+』""")
MARKS = ".…!?؟।॥。！？｡"
CLOSING = "\"'”“»«’)]」』）"
#: What a word ends with that a boundary may follow, and the last characters of such words.
STOPPED, EDGE = re.compile(rf"(?:{MARKED.pattern})\Z"), frozenset(MARKS + CLOSING + "›")
NO_BLANKS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: Blanks in scripts without them; events of texts that have no marks.
BLANK = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])(?=\s+[\p{Han}\p{Hiragana}\p{Katakana}\p{N}])")
TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}]+")
VOWEL = regex.compile(r"(?i)[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûü]")
#: Common abbreviations that a sentence rarely ends with; each counts as PRIOR occurrences within sentences, and not for a class of words that hardly abbreviate.
ABBREVIATIONS = "al approx cap capt cf cmdr col dr dra e.g est ex feat fig fr gen gov hr i.e jr lt m mme mr mrs ms no nr p pp prof rev s sgt sr sra st v vol vs z डॉ د ดร".split()
KNOWN, PRIOR, BACK_OFF, ALONE = frozenset(ABBREVIATIONS), 20, 4.0, 0.02
#: Words whose counts are kept, the most frequent ones inside sentences and as many others; all others are left to their class.
VOCABULARY = 200_000
#: Units of measure that have no vowel.
UNITS = set("mm cm dm km mg kg ml cl dl hl h s t g l km/h m/s kWh".split())
#: What an ordinal number before it names the day of.
MONTHS = set("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())


def _left(text: str, start: int, mark: int, stop: int) -> tuple[str, str, int]:
    """(word, class, where it starts) of what stands before the event at mark to stop."""
    if mark == stop:
        return "", "blank", mark
    if text[mark] in "。！？｡":
        # after a quotation that opens the sentence its speaker follows
        told = stop - mark > 1 and text[stop - 1] in CLOSING and stop < len(text) and NO_BLANKS.match(text, stop)
        return text[mark:stop], "told" if told else "mark", mark
    if text[mark] not in ".…" or text[mark : mark + 2] == "..":
        return text[mark], "mark", mark
    at = mark
    while at > start and not text[at - 1].isspace() and text[at - 1] not in "(\"“„«‘[—":
        at -= 1
    return *WORDS[text[at:mark]], at


class Words(dict):
    """Word before a full stop to (word in lower case, class); bounded."""

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) > 1 << 18:
            self.clear()
        if word.isdigit():
            kind = "number" if len(word) > 2 else "ordinal"
        elif any(c.isdigit() for c in word):
            kind = "figure"
        elif "." in word and max(map(len, word.split("."))) < 4:
            kind = "dotted"
        elif len(word) == 1:
            kind = "letter" if word.isupper() or not word.islower() else "unit"
        elif word in UNITS:
            kind = "unit"
        elif word.isascii() and not VOWEL.search(word):
            kind = "skeleton"
        elif word[:1].isupper():
            kind = "name"
        else:
            kind = "word" if len(word) > 3 else "short"
        v = self[word] = word.lower() if not word[0:1].isdigit() else "", kind
        return v


WORDS = Words()


def _right(text: str, at: int, end: int) -> tuple[str, str]:
    """(word, class) of what follows."""
    while at < end and text[at].isspace():
        at += 1
    c = text[at] if at < end else " "
    if c in "-–—":
        n = at + 1
        while n < end and text[n].isspace():
            n += 1
        return "", "dash lower" if n < end and text[n].islower() else "dash"
    if c.isupper():
        stop = at + 1
        while stop < end and text[stop].isalpha():
            stop += 1
        return text[at:stop], "upper"
    if c.islower():
        return "", "lower"
    if c.isdigit():
        return "", "digit"
    if c in "\"“„«»‘'¿¡「『([":
        return "", "open"
    return "", "letter" if c.isalpha() else "other"


def units(text: str, by_line: bool) -> Iterator[tuple[int, int]]:
    """Start and end of each unit: lines, or the whole text."""
    at = 0
    for line in text.split("\n") if by_line else [text]:
        s, e = at, at + len(line)
        at = e + 1
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            yield s, e


def events(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """(mark, end) of the events inside a unit that no quotation holds. A quotation's own end is an event if a mark ends it."""
    found = []
    for m in MARKED.finditer(text, s, e):
        a, b = m.span()
        if text[a] in "。！？｡" or b < e and text[b].isspace():
            found.append((a, b))
        elif b + 1 < e and b - a == 1 and text[a] in ".!?" and text[b].isupper() and text[b + 1].islower() and a - s > 1 and text[a - 2 : a].isalpha() and text[a - 2].islower() and text[a - 1].islower():
            found.append((a, b))  # a blank was forgotten
    if THAI.search(text, s, e):
        found = sorted(found + [m.span() for m in THAI_BLANK.finditer(text, s, e)])
    if not found:
        return found
    quotes = [m.span() for m in QUOTE.finditer(text, s, e)]
    if quotes:
        kept, q = [], 0
        for a, b in found:
            while q < len(quotes) and quotes[q][1] <= a:
                q += 1
            if q == len(quotes) or a < quotes[q][0] or b >= quotes[q][1]:
                kept.append((a, b))
        found = kept
    return [x for x in found if x[1] < e]


def _exception(word: str, kind: str) -> bool:
    """Whether a fixed abbreviation tells nothing of its class, whose other words hardly abbreviate."""
    return word in KNOWN and kind in ("name", "word")


def _inside(x: str, w: str) -> bool:
    """Whether no boundary can stand between the words x and w."""
    return x[-1] not in "\"”»“" and not STOPPED.search(x) and not THAI_BLANK.search(f"{x} {w}")


def count_events(texts: list[str | None], by_line: bool, n: Counter) -> None:
    """Add to ``n``: how often each word and class stands before an event or ends a unit, and follows a boundary or a word.

    Boundaries are the starts of units that end with a mark; of these units all words are counted that no boundary can stand before.
    """
    words: Counter = Counter()
    mid: Counter = Counter()
    for t in texts:
        if not t:
            continue
        words.update(t.split())
        for s, e in units(t, by_line):
            for a, b in events(t, s, e):
                word, kind, _ = _left(t, s, a, b)
                n["in", word] += 1
                if not _exception(word, kind):
                    n["in", kind, ""] += 1
            stop = e
            while stop > s and t[stop - 1] in CLOSING:
                stop -= 1
            if stop > s and t[stop - 1] in MARKS:
                a = stop - 1
                while a > s and t[a - 1] in MARKS:
                    a -= 1
                word, kind, at = _left(t, s, a, e)
                if at > s:
                    n["end", word] += 1
                    if not _exception(word, kind):
                        n["end", kind, ""] += 1
                    word, kind = _right(t, s, e)
                    n["start", word] += 1
                    n["start", kind, ""] += 1
                    ws, thai = t[s:e].split(), THAI.search(t, s, e)
                    mid.update([w if w not in "-–—" else f"{w} {y[:1]}" for x, w, y in zip(ws, ws[1:], [*ws[2:], ""]) if not (thai or x[-1] in EDGE) or _inside(x, w)])
            elif not by_line and stop > s and "\u0e00" <= t[stop - 1] <= "\u0e7f":
                n["end", "blank", ""] += 1
    for w, k in mid.items():
        word, kind = _right(w, 0, len(w))
        n["mid", word] += k
        n["mid", kind, ""] += k
    for w, k in words.items():
        if len(w) < 5 and w.isalpha():
            n["plain", w.lower()] += k


class Model:
    """Log odds of a boundary at a mark from the words on both sides; and the n-gram counts."""

    def __init__(self, n: dict, grams: Grams | None = None):
        self.n, self.left_odds, self.right_odds, self.grams = n, {}, {}, grams or Grams()
        # names and words of more than three letters hardly abbreviate: how often such a boundary ends its unit
        plain = ("word", "name", "mark")
        e = sum(n.get(("end", k, ""), 0) for k in plain)
        self.rate = (e + 1) / (e + sum(n.get(("in", k, ""), 0) for k in plain) + 2)
        self.starts = sum(v for k, v in n.items() if len(k) == 3 and k[0] == "start") + 1
        self.mids = sum(v for k, v in n.items() if len(k) == 3 and k[0] == "mid") + 1
        self.known = {a: PRIOR for a in ABBREVIATIONS}

    def left(self, word: str, kind: str) -> float:
        if (v := self.left_odds.get((word, kind))) is None:
            get = self.n.get
            usual = {"letter": 0.01, "skeleton": 0.1, "dotted": 0.2, "ordinal": 0.5, "told": 0.01}.get(kind, 0.95)
            e, i = get(("end", kind, ""), 0), get(("in", kind, ""), 0)
            p = min(1.0, (e + 10 * self.rate * usual) / (e + i + 10) / self.rate)
            vocal = kind in ("short", "word", "name")
            e, i = get(("end", word), 0), get(("in", word), 0) + self.known.get(word, 0)
            # an abbreviation is short and seldom stands without its mark
            if word and kind not in ("mark", "told") and not (vocal and (len(word) > 4 or get(("plain", word), 0) > e + i)):
                p = min(1.0, (e + BACK_OFF * self.rate * p) / (e + i + BACK_OFF) / self.rate)
            p = min(max(p, 0.001), 0.98)
            v = self.left_odds[word, kind] = math.log(p / (1 - p))
        return v

    def right(self, word: str, kind: str) -> float:
        if (v := self.right_odds.get((word, kind))) is None:
            get = self.n.get
            b = (get(("start", kind, ""), 0) + (0.5 if kind != "letter" else 5)) / self.starts
            m = (get(("mid", kind, ""), 0) + (0.5 if kind != "open" else 0)) / self.mids + 1e-6
            least = -6.0
            if kind == "dash lower":  # the speaker of the words before
                b, m = 1e-3 * m, m
            if word:
                # a name is seldom first, but may be
                least = -1.0
                b, m = get(("start", word), 0) / self.starts + 1e-3 * b, get(("mid", word), 0) / self.mids + 1e-3 * m
            v = self.right_odds[word, kind] = min(4.0, max(least, math.log(b / m)))
        return v


class Codes(dict):
    """Token to its number, odd if it ends a sentence by a mark; None for scripts without blanks. Bounded."""

    def __missing__(self, w: str) -> int | None:
        if len(self) > 1 << 20:
            self.clear()
        v = self[w] = None if NO_BLANKS.search(w) else token_code(w)
        return v


def token_code(w: str) -> int:
    core = w.strip("\"'“”„«»‘’()[]¿¡,;:")
    bare = core.rstrip(MARKS)
    ends = bare != core and (core[-1] not in ".…" or len(bare) > 3) and bare.lower() not in ABBREVIATIONS
    return xxhash.xxh3_64_intdigest(bare.lower().encode("utf-8", "surrogatepass")) & ~1 | ends


class Grams:
    """How often words, pairs and triples of words occur, boundaries included, in Count-min tables of fixed size: never too low, and too high by a fixed share of all."""

    CELLS, ROWS, ORDERS, BOUNDARY = 1 << 19, 2, 3, np.uint64(2)
    KEEP = 3.0

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((self.ORDERS, self.ROWS, self.CELLS), np.int64) if counts is None else counts.reshape(self.ORDERS, self.ROWS, self.CELLS)
        self.total = int(self.counts[0, 0].sum())
        self.codes = Codes()

    def _cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return (mix(h + np.uint64(row * 0x51ED27)) & np.uint64(self.CELLS - 1)).astype(np.int64)

    def _hashes(self, x: np.ndarray) -> list[np.ndarray]:
        pair = mix(x[:-1]) + x[1:]
        return [x, pair, (mix(pair[:-1]) + x[2:])[x[1:-1] != self.BOUNDARY] if len(x) > 2 else pair[:0]]

    def sequence(self, line: str) -> list[int]:
        """Numbers of the tokens of a line."""
        out = [self.codes[w] for w in line.split()]
        if None in out:
            out = []
            for w in TOKEN.findall(line):
                if w[0] in MARKS and out:
                    out[-1] |= 1
                else:
                    out.append(token_code(w))
        return out

    def add(self, texts: list[str | None], by_line: bool) -> None:
        """Count the sentences of texts, by lines or whole, that end with a mark."""
        flat: list[int] = []
        for t in texts:
            for line in (t.split("\n") if by_line else [t]) if t else ():
                if (end := line.rstrip().rstrip(CLOSING)) and end[-1] in MARKS:
                    flat.append(int(self.BOUNDARY))
                    flat += self.sequence(line)
        if not flat:
            return
        x = np.array(flat, np.uint64)
        x = np.insert(x, np.flatnonzero(x & np.uint64(1)) + 1, self.BOUNDARY) & ~np.uint64(1)
        x = x[np.concatenate([[True], (x[1:] != x[:-1]) | (x[1:] != self.BOUNDARY)])]
        for order, h in enumerate(self._hashes(x)):
            for row in range(self.ROWS):
                self.counts[order, row] += np.bincount(self._cells(h, row), minlength=self.CELLS)

    def _get(self, order: int, h: np.ndarray) -> np.ndarray:
        return np.minimum(*(self.counts[order, row][self._cells(h, row)] for row in range(self.ROWS))).astype(float)

    def share(self, a: np.ndarray | None, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Probability of c after b, and before it a unless None; each order backs off to the next lower one."""
        k = self.KEEP
        p = (self._get(0, c) + 0.5) / (self.total + 0.5 * self.CELLS)
        pair = mix(b) + c
        p = (self._get(1, pair) + k * p) / (self._get(0, b) + k)
        if a is None:
            return p
        before = mix(a) + b
        return (self._get(2, mix(before) + c) + k * p) / (self._get(1, before) + k)

    def boundaries(self, text: str, s: int, e: int) -> list[int]:
        """Where sentences of an unmarked unit end, but for the last: forward-backward over an event between any two tokens.

        A state is whether the event before the last token is a boundary, as that decides what it follows.
        """
        spans = [m.span() for m in TOKEN.finditer(text, s, e)]
        if len(spans) < 4 or not self.total:
            return []
        x = np.array([token_code(text[a:b]) & ~1 for a, b in spans], np.uint64)
        edge = np.full(len(x), self.BOUNDARY)
        before = np.concatenate([edge[:1], x[:-1]])
        # [what stood before the token: token, boundary][what follows: none, boundary]
        on, first = [self.share(before[:-1], x[:-1], x[1:]), self.share(edge[1:], x[:-1], x[1:])], self.share(None, edge[1:], x[1:])
        stop = [self.share(before, x, edge), self.share(edge, x, edge)]
        fwd = np.zeros((len(x), 2))
        fwd[0] = 0, 1
        for i in range(1, len(x)):
            f = fwd[i - 1]
            fwd[i] = f[0] * on[0][i - 1] + f[1] * on[1][i - 1], (f[0] * stop[0][i - 1] + f[1] * stop[1][i - 1]) * first[i - 1]
            fwd[i] /= fwd[i].sum()
        back, out = np.array([stop[0][-1], stop[1][-1]]), []
        for i in range(len(x) - 1, 0, -1):
            post = fwd[i] * back
            if post[1] > post[0]:
                out.append(spans[i - 1][1])
            back = np.array([on[k][i - 1] * back[0] + stop[k][i - 1] * first[i - 1] * back[1] for k in (0, 1)])
            back /= back.sum()
        return out[::-1]


def posteriors(odds: list[float], alone: list[bool]) -> list[float]:
    """Probability of a boundary at each event by forward-backward; ``alone``: only one word since the event before, or the unit's start."""
    fwd, a = [], (0.0, 1.0)  # before the unit there is a boundary
    for o, x in zip(odds, alone):
        p = 1 / (1 + math.exp(-o))
        b, none = p * (a[0] + a[1] * (ALONE if x else 1.0)), (1 - p) * (a[0] + a[1])
        a = (none / (b + none), b / (b + none))
        fwd.append(a)
    out, back = [0.0] * len(odds), (1.0, 1.0)
    for i in range(len(odds) - 1, -1, -1):
        none, b = fwd[i][0] * back[0], fwd[i][1] * back[1]
        out[i] = b / (b + none)
        p, f = 1 / (1 + math.exp(-odds[i])), ALONE if alone[i] else 1.0
        n0, n1 = p * back[1] + (1 - p) * back[0], p * f * back[1] + (1 - p) * back[0]
        back = (n0 / (n0 + n1), n1 / (n0 + n1))
    return out


def sentences(text: str | None, by_line: bool, model: Model) -> list[tuple[int, int]]:
    """Start and end of each sentence."""
    out = []
    for s, e in units(text, by_line) if text else ():
        found, ends = events(text, s, e), []
        unmarked = not by_line and not found and text[s:e].rstrip(CLOSING)[-1:] not in MARKS
        if unmarked:
            found = [m.span() for m in BLANK.finditer(text, s, e)]
        if found:
            odds, alone, before = [], [], s
            for a, b in found:
                word, kind, at = _left(text, s, a, b)
                if a == b or text[a] in "。！？｡":  # no blank before the next word, or no word that could be known
                    odds.append(model.left(word, kind))
                    alone.append(False)
                else:
                    after = _right(text, b, e)
                    odds.append(-9.0 if kind == "ordinal" and after[0] in MONTHS else model.left(word, kind) + model.right(*after))
                    alone.append(at == before and kind != "mark")
                before = b
                while before < e and text[before].isspace():
                    before += 1
            ends = [b for (_, b), p in zip(found, posteriors(odds, alone)) if p > 0.5]
        elif unmarked:
            ends = model.grams.boundaries(text, s, e)
        for b in ends:
            out.append((s, b))
            s = b
            while s < e and text[s].isspace():
                s += 1
        if s < e:
            out.append((s, e))
    return out


#: Cells of a block of the n-gram counts as they are merged.
BLOCK = 1 << 16


def train(parts: list[tuple[DataFrame, bool]], least: int = 5) -> Model:
    """The model of all texts of ``parts``, (text) and whether lines are units.

    Words met fewer than ``least`` times, and those after the VOCABULARY most frequent inside sentences and as many at their ends and starts, are left to their class, so the model's size does not grow with the texts.
    """
    total = None
    for df, by_line in parts:

        def count(batches: Iterator[pa.RecordBatch], by_line: bool = by_line) -> Iterator[pa.RecordBatch]:
            n, grams = Counter(), Grams()
            for b in batches:
                texts = b.column(0).to_pylist()
                count_events(texts, by_line, n)
                grams.add(texts, by_line)
                if len(n) > 200_000:
                    yield as_batch(n)
                    n.clear()
            yield as_batch(n)
            yield from grams_batch(grams)

        one = df.mapInArrow(count, "what string, word string, kind boolean, n long, block long, counts binary")
        total = one if total is None else total.unionByName(one)
    total = materialize(total, "counts")
    rows = total.filter("what is not null").groupBy("what", "word", "kind").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("kind"))
    of_word = rows.filter("kind or word <> ''").groupBy("word", "kind", (F.col("what") == "mid").alias("mid")).agg(F.sum("n").alias("all"), F.collect_list(F.struct("what", "n")).alias("x"))
    # words inside sentences apart, as they are many more and would displace the others
    kept = [of_word.filter(x).orderBy(F.col("kind").desc(), F.col("all").desc(), "word").limit(VOCABULARY) for x in ("mid", "not mid")]
    kept = kept[0].unionByName(kept[1])
    n = {(x.what, r.word, "") if r.kind else (x.what, r.word): x.n for r in kept.toLocalIterator() for x in r.x}
    counts = np.zeros(Grams.ORDERS * Grams.ROWS * Grams.CELLS, np.int64)
    for r in merged(total.filter("block is not null").select("block", "counts"), np.add, np.int64).toLocalIterator():  # one row a block
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return Model(n, Grams(counts))


def grams_batch(grams: Grams) -> Iterator[pa.RecordBatch]:
    flat = grams.counts.reshape(-1, BLOCK)
    use = np.flatnonzero(flat.any(axis=1))
    n, packed = len(use), [zlib.compress(flat[i].tobytes(), 1) for i in use]
    none = lambda t: pa.nulls(n, t)
    yield pa.RecordBatch.from_arrays([none(pa.string()), none(pa.string()), none(pa.bool_()), none(pa.int64()), pa.array(use.astype(np.int64)), pa.array(packed, pa.binary())], names=["what", "word", "kind", "n", "block", "counts"])


def as_batch(n: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([len(k) == 3 for k in keys], pa.bool_()), pa.array([n[k] for k in keys], pa.int64()),
            pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary()),
        ],
        names=["what", "word", "kind", "n", "block", "counts"],
    )


def split_sentences(df: DataFrame, by_line: bool, model: Model) -> DataFrame:
    """(id, start_pos, end_pos) of the sentences of (id, text), from their first to their last non-blank character.

    Positions count code points. NULL, empty and blank texts have none; no rows give no rows; repeated rows give their sentences once.
    by_line: every line break ends a unit; otherwise it is only a blank. No shuffle but for removing repeated rows.
    """
    kept = df.sparkSession.sparkContext.broadcast((dict(model.n), zlib.compress(model.grams.counts.tobytes(), 1)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, packed = kept.value
        m = Model(n, Grams(np.frombuffer(zlib.decompress(packed), np.int64)))
        for b in batches:
            spans, count = [], np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                one = sentences(t, by_line, m)
                count[i] = len(one)
                spans += one
            x = np.array(spans, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), count))), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["id", "start_pos", "end_pos"])

    rows = df.select("id", "text")
    return rows.mapInArrow(go, f"id {rows.schema[0].dataType.simpleString()}, start_pos int, end_pos int")


#: field -> table, id, text, whether lines are units
FIELDS = {
    "wiki_space_exploration_top_sentences.sentence": ("wiki_space_exploration_top_sentences", "sent_id", "sentence", False),
    "corpus.text": ("corpus", "crawl_id", "text", True),
}


def p7_found(spark, d: str) -> DataFrame:
    parts = {f: (spread(table(spark, d, t).select(F.col(i).alias("id"), F.col(x).alias("text"))), by_line) for f, (t, i, x, by_line) in FIELDS.items()}
    model = train([(df.select("text"), by_line) for df, by_line in parts.values()])
    out = [split_sentences(df, by_line, model).select(F.lit(f).alias("field"), F.col("id").alias("rec_id"), "start_pos", "end_pos") for f, (df, by_line) in parts.items()]
    return out[0].unionByName(out[1])
