"""Text functions from Column to Column, all inside the JVM. NULL in gives NULL out, unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: White space of any kind, no-break spaces included.
WS = r"(?U:\s)"


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once: within f it is a variable, not an expression that is repeated for each element."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def any_of(c: Column, parts: list[str], how: str = "contains") -> Column:
    """True if the text contains, starts or ends with one of the parts."""
    tests = [getattr(c, how)(p) for p in parts]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return sub(c, f"^{WS}+|{WS}+$")


def strip(c: Column, chars: str | None = None) -> Column:
    """Without white space of any kind, or without the given characters, at both ends."""
    if chars is None:
        return trimmed(c)
    return F.btrim(c, F.lit(chars))


def norm_spaces(c: Column) -> Column:
    """White space runs, no-break spaces included, made one blank; trimmed."""
    return F.trim(sub(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """Split at white space; the empty list for blank text."""
    return F.filter(F.split(norm_spaces(c), " "), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def split_semicolons(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), norm_spaces), lambda x: x != "")


def dedup_list(c: Column) -> Column:
    """Distinct non-empty items in their first order."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def smart_join(parts: Column) -> Column:
    """Fragments joined with blanks, but none before closing and after opening punctuation."""
    return F.aggregate(
        F.filter(parts, lambda x: x.isNotNull() & (x != "")),
        F.lit(""),
        lambda a, x: F.when(a == "", x).when(has(x, r"^[\]).,;:]") | has(a, r"[(\[/]$"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)),
    )


def extract_date(c: Column) -> Column:
    """The first dd/mm/yyyy, with - hh:mm if it follows; NULL if there is none."""
    return F.regexp_substr(c, F.lit(r"\d{2}/\d{2}/\d{4}(?:\s*-\s*\d{2}:\d{2})?"))


# cleaning of documents, pass by pass


def normalize_basic(c: Column) -> Column:
    c = sub(sub(c, r"\r\n?", "\n"), " ", " ")
    c = sub(c, r"[%￾]")
    c = sub(c, r"[^\x00-\x7FÀ-ɏ’‘“”–—]")
    return sub(c, r"\[\d+\]|\[update\]|\[note\s*\d*\]")


def keep_lines(c: Column, keep, strip_lines: bool = False) -> Column:
    """The lines of which keep(stripped line) is true; blank lines stay, as empty lines where lines are stripped."""
    lines = F.split(c, "\n")
    if strip_lines:
        lines = F.transform(lines, trimmed)
    return F.array_join(F.filter(lines, lambda x: (strip(x) == "") | keep(strip(x))), "\n")


def remove_common_noise(c: Column, lines: list[str] = V.NOISE_LINES, patterns: list[str] = V.NOISE_PATTERNS) -> Column:
    return keep_lines(c, lambda x: ~x.isin(lines) & ~has(x, "|".join(patterns)), strip_lines=True)


def remove_contents(c: Column) -> Column:
    """Without lines of a table of contents."""
    return keep_lines(c, lambda x: ~has(x, r"\.{5,}\s*\d+\s*$") & ~(has(x, r"^\d+(\.\d+)*\s+.+$") & F.lower(x).contains("strategy")))


def fix_hyphenation(c: Column) -> Column:
    return sub(c, r"(?U)(\w)-\n(\w)", "$1$2")


def is_title(c: Column) -> Column:
    """Each run of letters starts upper and goes on lower, and there is one."""
    return has(c, r"^\P{L}*\p{Lu}\p{Ll}*(?:\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$")


def join_broken_lines(c: Column) -> Column:
    """Lines joined to the one before unless that ends a sentence or a bullet or short title follows. A line after a blank one joins the blank."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        alone = (x == "") | has(last, r"[.!?:;]$") | has(x, r"^[•\-*]") | ((n_words(x) <= 5) & is_title(x))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), x)))
        return F.when(F.size(acc) == 0, F.array(x)).when(alone, F.concat(acc, F.array(x))).otherwise(joined)

    return F.array_join(F.aggregate(F.transform(F.split(c, "\n"), trimmed), F.array().cast("array<string>"), step), "\n")


def replace_all(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements in the order given: headings that ran into their text, and the like."""
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def remove_corrupted_lines(c: Column) -> Column:
    def good(x: Column) -> Column:
        letters = F.length(sub(x, r"\P{L}"))
        blanks = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
        bad = has(x, r"^(?:https?://|\(https://|\d+\s+ESA/|\d+\s+EL3)") | has(x, r"(?:\b[A-Za-z]\b\s+){8,}") | ((letters > 20) & (blanks > letters * 0.7))
        return ~bad

    return keep_lines(c, good)


def collapse_blank_lines(c: Column) -> Column:
    return F.concat(strip(sub(sub(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")), F.lit("\n"))


def clean_document(c: Column, headings: dict[str, str] | None = None) -> Column:
    """All passes in their order, which matters."""
    for f in (normalize_basic, remove_common_noise, remove_contents, fix_hyphenation, join_broken_lines):
        c = f(c)
    return collapse_blank_lines(remove_corrupted_lines(replace_all(c, V.JOINED_HEADINGS if headings is None else headings)))


def clean_sentence(c: Column, artefacts: dict[str, str] = V.SENTENCE_ARTEFACTS) -> Column:
    """A sentence without the headings that ran into it."""
    return strip(replace_all(c, artefacts))


def clean_book(c: Column, marker: str = V.BOOK_MARKER) -> Column:
    """A book from its first chapter on, lower-cased, with single line breaks."""
    c = sub(c, r"\r\n?", "\n")
    at = F.instr(c, marker)
    return sub(F.lower(F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c)), r"\n+", "\n")


def book_sentences(c: Column, letters: str = V.BOOK_LETTERS) -> Column:
    """Sentences of a clean book, of its language's letters alone."""
    plain = sub(c, f"[^{letters}.!?]+", " ")
    return F.filter(F.transform(F.split(plain, "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def clean_lang_trailing(c: Column, codes: list[str] = V.LANGUAGE_CODES) -> Column:
    """An item without a language code after it."""
    return strip(sub(norm_spaces(c), rf"(?i) +(?:{'|'.join(codes)})$"))


def cut_back_matter(c: Column, markers: list[str] = V.BACK_MATTER, least: int = 500) -> Column:
    """Cut at the first marker, in list order, whose first place is after ``least`` characters."""
    places = [F.regexp_instr(c, F.lit(rf"\b{re.escape(m)}\b")) for m in markers]
    at = F.coalesce(*(F.when(p > least + 1, p) for p in places))
    return F.when(at.isNull(), c).otherwise(strip(F.substring(c, F.lit(1), at - 1)))


def slugify(c: Column) -> Column:
    return F.btrim(sub(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "_"), F.lit("_"))


def clean_citations(c: Column) -> Column:
    return norm_spaces(sub(c, r"\[\d+\]"))


def clean_for_chunks(c: Column) -> Column:
    """Without citation notes and question spans, which need no word boundary, and leading punctuation."""
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    c = sub(c, r"(?i)While every effort has been made to follow citation style rules.*?if you have any questions\.", " ")
    c = sub(c, r"(?i)(What|How|Why|When|Where|Who)[^?]{10,160}\?", " ")
    c = sub(sub(c, r"\[\d+\]"), f"{WS}+", " ")
    return strip(sub(c, r"^[,\s;:.-]+"))


# sentences and tokens


def split_sentences(c: Column, least: int = 30) -> Column:
    """Split after . ! ? before white space; trimmed, and only those longer than ``least`` characters."""
    return F.filter(F.transform(F.split(c, f"(?<=[.!?]){WS}+"), trimmed), lambda s: F.length(s) > least)


def tokens_a(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+(?:'[a-z]+)?|\d+"), F.lit(0))


def tokens_b(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def tokens_c(c: Column, stop: list[str] = V.STOPWORDS) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(stop))


def tokens_d(c: Column, stop: list[str], least: int = 3) -> Column:
    """Words of three characters and more that are no stop words; NULL for sentences of fewer than ``least`` of them."""
    t = F.filter(words(F.lower(c)), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.when(F.size(t) >= least, t)


def ngrams(tokens: Column, n: int) -> Column:
    """All n consecutive tokens as arrays; none for shorter lists."""
    none = F.array().cast("array<array<string>>")
    return F.coalesce(let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.slice(t, i, n)))), none)


def chunk_words(c: Column, most: int = V.CHUNK_WORDS, overlap: int = V.CHUNK_OVERLAP, least: int = V.CHUNK_MIN) -> Column:
    """Overlapping windows of words, joined by blanks; none shorter than ``least``. A text of up to ``most`` words is one window."""
    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w), F.lit(most - overlap)), lambda s: F.slice(w, s, most))
        return F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).when(F.size(w) <= most, F.array(w)).otherwise(many)

    return F.transform(F.filter(let(words(c), cut), lambda x: F.size(x) >= least), lambda x: F.array_join(x, " "))


def starts_with_any(c: Column, parts: list[str]) -> Column:
    return any_of(c, parts, "startswith")


def is_valid_sentence(s: Column, least: int = 6) -> Column:
    n, low = n_words(s), strip(F.lower(s))
    few = F.size(F.filter(words(s), lambda w: F.length(w) <= 2))
    bad = (
        (n < least)
        | ((n <= 8) & is_title(s))
        | starts_with_any(low, V.INVALID_PREFIXES)
        | any_of(low, V.INVALID_FRAGMENTS)
        | (starts_with_any(low, V.SHORT_PREFIXES) & (n < 12))
        | (has(s, r"\b\d+\.\s") & (n < 12))
        | has(s, r"(?:\b[A-Za-z]\b\s+){6,}")
        | (few / n > 0.45)
    )
    return F.coalesce(~bad, F.lit(False))


def is_candidate_sentence(s: Column, least: int = 8, most: int = 45) -> Column:
    s = strip(s)
    n, low = n_words(s), F.lower(s)
    months = "|".join(V.MONTHS_EN)
    bad = (
        (n < least)
        | (n > most)
        | starts_with_any(low, V.CANDIDATE_PREFIXES)
        | has(s, r"^\p{Ll}")
        | (has(s, rf"^(?:{'|'.join(V.PRONOUNS)})\b") & (n < 12))
        | has(s, r"^\d+(\.\d+)*\s+")
        | any_of(low, ["figure ", "table "])
        | has(s, "[:?]$")
        | (has(low, rf"\b(?:{months})\s+\d{{4}}\b") & (n < 12))
    )
    return F.coalesce(~bad, F.lit(False))


# entities


def entity_text(c: Column) -> Column:
    c = norm_spaces(c)
    m = F.create_map(*(F.lit(x) for kv in V.ENTITY_TEXT.items() for x in kv))
    return F.coalesce(F.try_element_at(m, c), c)


def entity_label(label: Column, text: Column) -> Column:
    return F.when(text.isin(V.ENTITY_AS_LOC), F.lit("LOC")).when(text.isin(V.ENTITY_AS_GPE), F.lit("GPE")).otherwise(label)


def is_clean_entity(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) >= 2) & ~has(t, r"(?:\b[A-Za-z]\b\s+){4,}") & ~has(t, r"(?U)[^\w\s\-+.'/&()]")


# links, answers, rendering


def domain_of(url: Column) -> Column:
    """The authority of a URL, lower-cased, without any www. ; the empty string without one."""
    return F.replace(F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit("")), F.lit("www."), F.lit(""))


def link_score(url: Column, kind: Column) -> Column:
    d = domain_of(url)
    good = reduce(lambda a, b: a + b, (F.when(d.contains(g), 20).otherwise(0) for g in V.GOOD_DOMAINS))
    extra = F.lit(0)
    for k, (points, domains) in V.TYPE_DOMAINS.items():
        extra = F.when((kind == k) & any_of(d, domains), points).otherwise(extra)
    return F.when(any_of(F.lower(url), V.BAD_URLS), F.lit(-100)).otherwise(good + extra)


def normalize_answer(c: Column) -> Column:
    """Lower case, then without articles, then without punctuation; in this order."""
    return norm_spaces(sub(sub(F.lower(c), r"\b(a|an|the)\b", " "), r"[!-/:-@\[-`{-~]"))


def postprocess_answer(c: Column) -> Column:
    c = strip(c)
    for x in V.ANSWER_ARTEFACTS:
        c = F.replace(c, F.lit(x), F.lit(""))
    return F.btrim(c, F.lit(V.ANSWER_MARKS))


def clean_generated(c: Column) -> Column:
    return strip(F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'")))


def latex_escape(c: Column) -> Column:
    """Backslash first, braces after it: so a backslash becomes a command whose braces are escaped."""
    for a, b in (("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def md_link(title: Column, url: Column) -> Column:
    safe = F.replace(F.replace(title, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.when(url.isNull() | (url == ""), title).otherwise(F.concat(F.lit("["), safe, F.lit("]("), url, F.lit(")")))


def embedding_text(title: Column, kind: Column, text: Column) -> Column:
    return F.format_string("%s (%s). %s", title, kind, text)


def qa_context(title: Column, kind: Column, source: Column, artist: Column, text: Column) -> Column:
    meta = F.format_string("The document title is %s. The document type is %s. The source is %s.", title, kind, source)
    who = F.when(artist.isNotNull() & (artist != ""), F.concat(F.lit(" The artist associated with this document is "), artist, F.lit("."))).otherwise("")
    return F.concat(meta, who, F.lit("\n\n"), text)


def shortened(c: Column, most: int = 18) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def date_pt(d: Column) -> Column:
    return F.format_string("%d de %s de %d", F.day(d), F.get(F.array(*map(F.lit, V.MONTHS_PT)), F.month(d) - 1), F.year(d))


def is_explanation(q: Column) -> Column:
    q = F.lower(q)
    return starts_with_any(q, V.EXPLANATION_STARTS) | any_of(q, V.EXPLANATION_WORDS)


def is_bad_explanation(answer: Column, question: Column) -> Column:
    a, q = strip(F.lower(answer)), strip(F.lower(question))
    return (a == "") | (n_words(a) < 8) | any_of(a, V.BAD_ENDINGS, "endswith") | q.contains(a) | any_of(a, V.BAD_FRAGMENTS)


def subject_of(question: Column) -> Column:
    """The subject of a question of importance, by the first pattern that fits."""
    found = [F.nullif(F.regexp_extract(question, "(?i)" + p, 1), F.lit("")) for p in V.SUBJECT_PATTERNS]
    return F.coalesce(*(F.rtrim(strip(x), F.lit("?.")) for x in found), F.lit(V.NO_SUBJECT))


def explanation(question: Column, evidence: Column) -> Column:
    """An answer made from evidence sentences: what recognition they show, or else the first of them."""
    text = F.lower(F.array_join(evidence, " "))
    points = []
    for every, some, phrase in V.SIGNALS:
        test = any_of(text, some) if some else reduce(lambda a, b: a & b, (text.contains(x) for x in every))
        points.append(F.when(test, F.lit(phrase)))
    p = F.array_compact(F.array(*points))
    n = F.size(p)
    listed = F.when(n == 1, F.get(p, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(p, n - 1)))
    top = strip(F.get(evidence, F.lit(0)))
    none = F.when(F.length(top) > 20, F.concat(F.lit(V.BASED_ON), top)).otherwise(V.NO_EXPLANATION)
    some = F.concat(subject_of(question), F.lit(V.DUE_TO), listed, F.lit(V.SUPPORTED))
    return F.when(F.size(evidence) <= 0, F.lit(V.NO_EVIDENCE)).when(n == 0, none).otherwise(some)


def align_labels(labels: Column, word_ids: Column, ignore: int = -100) -> Column:
    """Labels of subwords: the first of each word keeps its label; special ones (NULL) and the others get ``ignore``."""
    before = lambda i: F.get(word_ids, i - 1)
    return F.transform(word_ids, lambda w, i: F.when(w.isNull() | ((i > 0) & F.equal_null(w, before(i))), F.lit(ignore)).otherwise(F.get(labels, w)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) <= 0) | (F.size(y) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def softmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(v, lambda x: x / total)))


def unit(a: Column) -> Column:
    """The vector of length 1; a zero vector stays."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))
