"""Operators on text and names, on invented cases."""

import pytest

pytest.importorskip("lumentext.llm")
from lumentext.llm import boilerplate, names, sentences  # noqa: E402
from lumentext.llm.queries import oracle_sql, queries  # noqa: E402


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# 1: names

GIVEN = {"teresa", "robert", "alexandra", "alexandre", "femanda", "hugo", "ines"}


@pytest.mark.parametrize(
    "name, want",
    [
        ("Teresa Limavel", ("P", ["teresa"], "limavel")),
        ("LIMAVEL, TERESA", ("P", ["teresa"], "limavel")),
        ("Limavel Teté", ("P", ["teresa"], "limavel")),
        ("Dr. Teresa M. Limavel.", ("P", ["teresa"], "limavel")),
        ("Tersea Limavel", ("P", ["teresa"], "limavel")),
        ("T. Limavel", ("I", ["t"], "limavel")),
        ("Ter. Limavel", ("I", ["ter"], "limavel")),
        ("Limavel", ("S", [], "limavel")),
        ("Capitão Limavel", ("S", [], "limavel")),
        ("teresa", ("G", ["teresa"], "")),
        ("Nanda Cormel", ("P", ["femanda"], "cormel")),
        ("Rob Kuvel", ("P", ["robert"], "kuvel")),
        ("Agência Espacial de Kuvel", ("O", ["agency space"], "kuvel")),
        ("Kuvel Space Agncy", ("O", ["agency space"], "kuvel")),
        ("the Kuvel Launch Systems Ltd", ("O", ["launch systems"], "kuvel")),
        ("Launch Sys. (Kuvel)", ("O", ["launch systems"], "kuvel")),
        ("Inst. for Orbital Research, Kuvel", ("O", ["institute orbital research"], "kuvel")),
        ("Kuvel ORI", ("O", ["institute orbital research"], "kuvel")),
        ("K.O.R.I.", ("A", [], "kori")),
        ("Kuvel 7", ("M", ["7"], "kuvel")),
        ("Mission Kuvel VII", ("M", ["7"], "kuvel")),
        ("Kuvel‑7", ("M", ["7"], "kuvel")),
        ("Kuvel No. 7", ("M", ["7"], "kuvel")),
        ("Kuvel7", ("M", ["7"], "kuvel")),
        ("Sr.", None),
        ("Professora", None),
        ("1969", None),
        ("14 March 2008", None),
        ("", None),
        ("• Kuvel", None),
    ],
)
def test_read_name(name, want):
    got = names.read_name(name, names.Givens(GIVEN))
    assert (got and got[:3]) == want


def test_link_names(spark):
    a = ["Teresa Limavel", "T. Limavel", "Limavel", "Teté Limavel", "Limavel, Teresa", "Teresa Limavle", "Professora", "Robert Limavek", "Hugo Kuvel", "Inês Kuvel", "Kuvel", "I. Kuvel", "Zafen 7", "Zafen VII", "Zafen 8", "Hugo"]
    b = ["Teresa Limavel", "Alexandra Tomavel", "Alexandre Tomavel", "A. Tomavel", "Kuvel Launch Systems Ltd", "KLS", "Launch Systems (Kuvel)"]
    extra = [("x", g.capitalize() + " Xy" + "abcdefgh"[i] * 4) for g in ("teresa", "hugo", "ines", "robert", "alexandra", "alexandre") for i in range(1)]
    data = [("a", n) for n in a] + [("b", n) for n in b] + [("a", None), (None, "Teresa Limavel"), ("a", " "), ("a", "Limavel")] + extra + [(s, n.split()[0] + " Pq" + s * 4) for s in "cde" for _, n in extra]
    df = spark.createDataFrame([(*r, 1) for r in data], "scope string, name string, node int")
    groups = {}
    for r in names.link_names(df).collect():
        groups.setdefault((r.scope, r.entity), set()).add(r.name)
    got = {(s, frozenset(g)) for (s, _), g in groups.items() if len(g) > 1}
    assert got == {
        ("a", frozenset(["Teresa Limavel", "T. Limavel", "Limavel", "Teté Limavel", "Limavel, Teresa", "Teresa Limavle"])),
        ("a", frozenset(["Inês Kuvel", "I. Kuvel"])),
        ("a", frozenset(["Hugo Kuvel", "Hugo"])),
        ("a", frozenset(["Zafen 7", "Zafen VII"])),
        ("b", frozenset(["Kuvel Launch Systems Ltd", "KLS", "Launch Systems (Kuvel)"])),
    }
    assert names.link_names(df.limit(0)).count() == 0


def test_sounds_orders_and_long_names_link(spark):
    groups = [
        ["Maria Silva Santos", "Maria Santos Silva", "Santos Silva, Maria", "Maria da Silva Santos"],
        ["Stephen Hawking", "Steven Hawking"],
        ["Maria Phillips", "Maria Filips"],
        ["Dr. Maria Clara de Sousa e Silva", "Maria Clara Sousa Silva", "Maria Clara de Souza Silva"],
        ["John Ronald Reuel Tolkien Smith", "John Reuel Ronald Tolkien Smith"],
        ["Mario Phillips"],
        ["Ana Costa Lima Prado"],
    ]
    df = spark.createDataFrame([("s", n) for g in groups for n in g], "scope string, name string")
    got = {}
    for r in names.link_names(df).collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert {frozenset(g) for g in got.values() if len(g) > 1} == {frozenset(g) for g in groups if len(g) > 1}


def test_measures():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("abc", "xyz") == 0 and names.edits("abcd", "abdc", 2) == 1 and names.edits("abcd", "wxyz", 2) == 3
    for w in ("limavel", "zunubonto"):
        for i in range(len(w)):
            for v in (w[:i] + w[i + 1 :], w[:i] + "k" + w[i:], w[:i] + "o" + w[i + 1 :]):
                assert set(names.halves(w)) & set(names.halves(v)), (w, v)


# 2: boilerplate


def test_template_lines_where_marks_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(boilerplate.with_marks, "__defaults__", ("inner", -1))
    test_template_lines(spark)


def test_template_lines(spark):
    para = "In the long year of {0} the quiet band of Pelimur{0} wrote many songs about the river and the slow garden by the sea, they said."
    pages, want = [], set()
    for i in range(24):
        lines = ["Home | News | Shop | Login" if i % 2 else "News | Login | Home | Shop", "", para.format(i), "Early years", para.format(i + 50), "Sponsored: a lamp", f"Guests » Ana Limavel{i}, Rui Kuvel{i}", para.format(i + 90), "Sponsored: a boat", f"© {1990 + i} Kuvelin. All rights reserved."]
        pages.append((i, "kuvelin.example", "\n".join(lines)))
        want |= {(i, n) for n in (0, 5, 8, 9)}
    pages += [(100, "kuvelin.example", None), (101, "kuvelin.example", ""), (102, "other.example", "Just a line."), (103, None, para.format(7))]
    df = spark.createDataFrame([(*p, 3) for p in pages], "page long, host string, text string, no int").fillna({"host": ""})
    assert set(rows(boilerplate.template_lines(df), "page", "no")) == want
    assert boilerplate.template_lines(df.limit(0)).count() == 0


def test_template_lines_are_the_same_at_two_sizes(spark):
    para = "In the long year of {0} the quiet band of Pelimur{0} wrote many songs about the river and the slow garden by the sea, they said."
    given = [a + b for a in ("An", "Ru", "Ev", "Le", "Id", "To", "Mi", "Ma", "So", "Ke", "Li", "Da") for b in ("a", "ira", "el", "oa", "ina", "ur", "is", "eo", "alia", "om")]
    who = lambda i: f"{given[i * 7919 % 800 % 120]} {given[i * 7919 % 800 // 7]}ves"

    def page(i):
        people = [who(i), who(i + 377)]
        return "\n".join(["Home | News | Shop | Login", para.format(i), para.format(i + 5000), ["", " · ".join(people)][i % 2], "Read next, a boat", f"© {1990 + i % 30} Kuvelin. All rights reserved."])

    found = []
    for n in (240, 2400):
        df = spark.createDataFrame([(i, f"h{i % 6}.example", page(i)) for i in range(n)], "page long, host string, text string")
        found.append({x for x in rows(boilerplate.template_lines(df), "page", "no") if x[0] < 240})
    assert found[0] == found[1] == {(i, n) for i in range(240) for n in (0, 4, 5)}


def test_label_at_the_edge_by_chance_on_one_host(spark):
    para = "In the long year of {0} the quiet band of Pelimur{0} wrote many songs about the river and the slow garden by the sea, they said."
    pages = []
    for h in range(12):
        for i in range(20):
            n = 100 * h + i
            own = [f"Players: Ana Limavel{n}"] if i < 8 else []
            last = i < (5 if h == 0 else 2)  # after the article
            pages.append((n, f"h{h}.example", "\n".join(["Home | News | Shop | Login", para.format(n), *([] if last else own), para.format(n + 5000), *(own if last else [])])))
    df = spark.createDataFrame(pages, "page long, host string, text string")
    assert set(rows(boilerplate.template_lines(df), "page", "no")) == {(p, 0) for p, _, _ in pages}


def test_long_notices_and_copied_articles(spark):
    para = "In the long year of {0} the quiet band of Pelimur{0} wrote many songs about the river and the slow garden by the sea, they said."
    notice = "We use small files to remember what you chose, to count our readers and to show what may be of use to you; read more on our pages."
    pages = [(i, "kuvelin.example", "\n".join([notice, para.format(i), para.format(i + 50), notice])) for i in range(24)]
    pages += [(i, "kuvelin.example", "\n".join([notice, *(para.format(n) for n in (900, 901, 902))])) for i in range(100, 108)]  # one article
    df = spark.createDataFrame(pages, "page long, host string, text string")
    assert set(rows(boilerplate.template_lines(df), "page", "no")) == {(i, n) for i in range(24) for n in (0, 3)} | {(i, 0) for i in range(100, 108)}


def test_last_lines_that_begin_alike_and_a_long_notice_on_every_page(spark):
    para = "In the long year of {0} the quiet band of Pelimur{0} wrote many songs about the river and the slow garden by the sea, they said."
    pages = [(i, "a.example", "\n".join(["Home | News | Shop | Login", para.format(i), para.format(i + 50), f"He died in Paris, aged {8 + i}."])) for i in range(5)]
    notice = "We and our partners use cookies and other small files to remember your choices, count our readers and show what may please you on all our pages."
    pages += [(100 + i, "b.example", "\n".join([notice, para.format(200 + i), para.format(300 + i)])) for i in range(40)]
    df = spark.createDataFrame(pages, "page long, host string, text string")
    assert set(rows(boilerplate.template_lines(df), "page", "no")) == {(i, 0) for i in range(5)} | {(100 + i, 0) for i in range(40)}


# 7: sentences


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    n = Counter()
    texts = ["The ship left the port in May 1963. Dr. Alves met Mrs. Reis at No. 7. It was late. They went home.", "He slept. Prof. Lima of the U.S. team read vol. 3 aloud. Nobody spoke.", "Am 18. Mai ging Hr. Kuhn nach Rom. Es war kalt. Er blieb."] * 20
    sentences.count_events(texts, True, n)
    return sentences.Model(dict(n))


@pytest.mark.parametrize(
    "text, want",
    [
        ("He met Dr. Alves. They spoke of No. 7 at 9.30 a.m. near the port. Good!", ["He met Dr. Alves.", "They spoke of No. 7 at 9.30 a.m. near the port.", "Good!"]),
        ('"Stop it. Go home," said Mrs. Reis. He left.', ['"Stop it. Go home," said Mrs. Reis.', "He left."]),
        ('They called it "a slow river." Nobody spoke.', ['They called it "a slow river."', "Nobody spoke."]),
        ("— Não abras! — gritou Rui. Ele saiu.", ["— Não abras! — gritou Rui.", "Ele saiu."]),
        ("¿Quién fue? ¡Nadie! «No. Nunca», dijo Ana.", ["¿Quién fue?", "¡Nadie!", "«No. Nunca», dijo Ana."]),
        ("Am 18. November kam er. Es war kalt.", ["Am 18. November kam er.", "Es war kalt."]),
        ("为什么？因为3.5公里。“等等。别走。”他说。走了！", ["为什么？", "因为3.5公里。", "“等等。别走。”他说。", "走了！"]),
        ("「待て。早い。」と彼は言った。行った。", ["「待て。早い。」と彼は言った。", "行った。"]),
        ("वह गया। क्यों? पता नहीं।", ["वह गया।", "क्यों?", "पता नहीं।"]),
        ("هل ذهب؟ نعم ذهب.", ["هل ذهب؟", "نعم ذهب."]),
        ("เขาไปแล้ว เธออยู่ที่3.5กม", ["เขาไปแล้ว", "เธออยู่ที่3.5กม"]),
        ("1. First song (3:10)", ["1. First song (3:10)"]),
        ("The crew of Samuel A. Lima left in 1978. Clemente stayed.", ["The crew of Samuel A. Lima left in 1978.", "Clemente stayed."]),
        ("    ", []),
        ("", []),
        (None, []),
    ],
)
def test_sentences(model, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, False, model)] == want


def test_unmarked_texts_are_split_by_the_n_gram_model():
    from collections import Counter

    rng = __import__("random").Random(1)
    who, did, where = ["i", "he", "she", "they", "we"], ["went", "stayed", "slept", "walked", "sang"], ["home", "there", "outside", "late", "again"]
    say = lambda: f"{rng.choice(who).capitalize()} {rng.choice(did)} {rng.choice(where)}."
    zh = lambda: rng.choice("他她我") + rng.choice(["去了", "看了", "买了"]) + rng.choice(["商店", "面包", "公园"]) + "。"
    texts = [" ".join(say() for _ in range(4)) for _ in range(300)] + ["".join(zh() for _ in range(4)) for _ in range(300)]
    n, grams = Counter(), sentences.Grams()
    sentences.count_events(texts, False, n)
    grams.add(texts, False)
    model = sentences.Model(dict(n), sentences.Grams(grams.counts))
    split = lambda t: [t[a:b] for a, b in sentences.sentences(t, False, model)]
    assert split("i went home he stayed there she sang again") == ["i went home", "he stayed there", "she sang again"]
    assert split("他去了商店她买了面包我看了公园") == ["他去了商店", "她买了面包", "我看了公园"]
    assert split("他去了商店 他买了面包 然后回家") == ["他去了商店", "他买了面包", "然后回家"]
    assert sentences.sentences("i went home he stayed there", True, model) == [(0, 27)]  # a line without a mark is one unit
    assert split("he") == ["he"]


def test_all_words_of_a_unit_are_counted():
    from collections import Counter

    def count(texts, by_line=True):
        n = Counter()
        sentences.count_events(texts, by_line, n)
        return n

    n = count(["The old men of the south came down with the whole crew to Ostra in May. It rained – as always – in Ostra, they said."])
    assert (n["mid", "Ostra"], n["mid", "May"], n["mid", "It"], n["mid", "dash lower", ""], n["mid", "lower", ""]) == (2, 1, 0, 2, 19)
    assert n["mid", "lower", ""] + n["mid", "upper", ""] + n["mid", "dash lower", ""] == 24  # all words but the first and the one after the mark
    # no word that a boundary may stand before
    assert count(["वह गया। वह आया। वह गया।"])["mid", "letter", ""] == 3
    assert count(["a b (c d.) Eva f «g.» Ida h “i j” Uma k."])["mid", "upper", ""] == 0
    assert count(["เขาไปแล้ว เธออยู่ ไปแล้ว!"], False)["mid", "letter", ""] == 0

    # a name that never begins a sentence, but stands far from the beginnings
    texts = ["The old men of the south came down by night with the whole Kant. Ostra in the winter of that year."] * 20 + ["They came to the Kant.", "He saw the sea."] * 40
    model = sentences.Model(dict(count(texts)))
    assert model.right("Ostra", "upper") > 0  # never seen but after a mark
    model = sentences.Model(dict(count(texts + ["The old men of the south came down by night to Ostra in the winter."] * 20)))
    assert model.right("Ostra", "upper") == -1


def test_words_inside_sentences_displace_no_others(spark, monkeypatch):
    monkeypatch.setattr(sentences, "VOCABULARY", 30)
    texts = [f"The men and women went with all of the others to Nader{chr(97 + i)} in the winter." for i in range(26) for _ in range(9)] + ["The men and Abk. Reis went."] * 6
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n = sentences.train([(df, True)]).n
    assert n["in", "abk"] == 6 and n["mid", "Naderc"] == 9


def test_units_and_positions(spark, model):
    text = " Menu | Home \n\nHe came. He left. \n1. Song\n"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "a\nb.", 0)], "id long, text string, start_pos int")
    got = [(r.id, text[r.start_pos : r.end_pos]) for r in sentences.split_sentences(df, True, model).filter("id = 1").collect()]
    assert [x for _, x in got] == ["Menu | Home", "He came.", "He left.", "1. Song"]
    assert rows(sentences.split_sentences(df, False, model).filter("id = 4"), "start_pos", "end_pos") == [(0, 4)]
    assert sentences.split_sentences(df.limit(0), True, model).count() == 0
    assert sentences.train([(df.select("text"), True)]).n


# queries


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql()])
def test_runs(spark, data, name):
    df = queries()[name](spark, data)
    assert df.count() == df.distinct().count() > 0


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_as_sql(spark, data, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, data).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    level = lambda x: sorted(repr(tuple(round(float(v), 5) if isinstance(v, float) else v for v in r)) for r in x[sorted(x.columns)].astype(object).itertuples(index=False, name=None))
    assert level(df) == level(want)
