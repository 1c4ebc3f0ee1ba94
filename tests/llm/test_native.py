"""Quality rules, line dedup and decontamination against brute force, and odd inputs."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, quality_rules
from millrace.llm.common import table
from millrace.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, kept string, anchor string"


def odd(spark, *texts):
    """Rows with nulls, and extra columns whose names clash with the operators' own."""
    rows = [(i if i else None, t, None, "s" if i % 2 else None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rules_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 300, "a\x0bb\x0cc\rd\te f", "l\nl\n\nl", "é|ß# $ü <>", "w" * 5000, " ".join(str(i % 97) for i in range(9000))]


def test_base_counts(spark, small):
    got = [tuple(r) for r in quality_rules.clean(odd(spark, *TEXTS)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got) == sorted(map(rules_by_hand, TEXTS))
    docs = table(spark, small, "documents")
    want = {r.doc_id: rules_by_hand(r.text) for r in docs.collect()}
    for r in quality_rules.op5_line_rules(spark, small).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        n, _, _, _, repeated = want[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.kept and r.base_failed)


def test_failing_lines_go(spark):
    prose = "This is a plain sentence with quite enough words to stand on its own feet here."
    other = "Another one follows it and says something that nobody has said above, at some length."
    text = f"Home | News | Sports | Contact\n{prose}\nAll rights reserved.\n{other}\nWORDS!! SHOUTED!! OUT!! LOUD!!\nMenu"
    r = quality_rules.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.clean_text == f"{prose}\n{other}" and r.kept
    junk = "\n".join(["a | b | c | d | e"] * 3 + [f"x{i} | y{i} | z{i} | u{i}" for i in range(9)])
    assert not quality_rules.clean(spark.createDataFrame([(1, junk)], "doc_id long, text string")).first().kept


MENUS = ["Home / News / Sports / Weather / Contact", "Home · About · Products · Careers · Contact", "[Home] [News] [Sport] [About us] [Contact]", "Accueil › Actualités › Monde", "Startseite » Nachrichten » Wetter und Klima", "Home News Sports Weather Contact", "Inicio • Noticias • Deportes • Contacto."]
NOTICES = ["Tous droits réservés. © 2020 Le Journal", "Alle Rechte vorbehalten. Nachdruck nur mit Genehmigung.", "Todos los derechos reservados. Prohibida la reproducción.", "Ce site utilise des cookies pour vous offrir le meilleur service.", "Copyright (c) 2019 by the authors of this page.", "DIESE SEITE VERWENDET COOKIES, UM IHNEN ZU DIENEN."]
PROSE = [
    "He said (and/or wrote) that the price was 5/6 of what it had been in 1999 [12] and would fall.",
    "Les droits de l'homme sont réservés à tous, dit-il, et la suite l'a bien montré dans ce pays.",
    "Das Wetter in Berlin war an diesem Tag schlecht – so schlecht – dass niemand vor die Tür ging.",
    "El aviso del capitán llegó tarde; nadie en la ciudad había leído más que las primeras líneas.",
    "the last line of a paragraph that was broken off in the middle of a sentence without a mark",
    "Anna Maria Schmidt und Peter Paul Huber heirateten im Mai.",
    "",
    "  ",
]


def test_rules_of_lines_in_four_languages(spark):
    lines = [*MENUS, *NOTICES, *PROSE]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(quality_rules.line_fails(F.col("line"), F.lit(True))).collect()]
    assert got == [True] * len(MENUS + NOTICES) + [False] * len(PROSE)


def test_columns_named_like_the_operators_own(spark):
    text = "Menu\n" + " ".join(f"word{i}" for i in range(60)) + " end.\nshared line"
    names = [*quality_rules.ADDED, "judged", "drop_keys", "row_number", "own_site", "left_lines", "n_lines", "n_dropped", "_left", "_row"]
    df = spark.createDataFrame([(i, f"own {i}\n{text}", "s", *names) for i in range(8)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    results = [quality_rules.passed(df), *(line_dedup.without_boilerplate(df, max_broadcast_lines=n) for n in (1000, 0))]
    for out in results:
        assert out.columns == df.columns and out.count() == 8
        assert all(r[n] == n for r in out.collect() for n in names)
    for n in (1000, 0):
        out = line_dedup.drop_boilerplate(df, max_broadcast_lines=n)
        assert {(r.text, r.n_lines, r.n_dropped, r._left, r._row) for r in out.collect()} == {(f"own {i}", 4, 3, "_left", "_row") for i in range(8)}
    assert quality_rules.clean(df).columns == ["doc_id", "text", "source", *names[len(quality_rules.ADDED) :], *quality_rules.ADDED]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(duck.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("max_broadcast_lines", [1000, 0])
def test_line_dedup_by_site(spark, max_broadcast_lines):
    texts = [f"shared \nown {i}\n\n shared" for i in range(20)] + [None, "", "own 3"]
    df = odd(spark, *texts)
    got = line_dedup.drop_boilerplate(df, max_broadcast_lines=max_broadcast_lines)
    assert got.columns[: len(df.columns)] and set(df.columns) <= set(got.columns)
    left = Counter(r.text for r in got.collect())
    assert left == Counter([f"own {i}\n" for i in range(20)] + ["", "", "own 3"])
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def hits_by_hand(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for t in docs:
        w, cov, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if of := wins.get(tuple(w[k : k + n])):
                    cov.update(range(k, k + n))
                    found |= of
        yield len(w), len(cov), tuple(sorted(found))


#: The constant table, a broadcast join and a shuffled join.
WAYS = [{}, {"max_table_bytes": -1}, {"max_table_bytes": -1, "max_broadcast": 0}]


@pytest.mark.parametrize("how", WAYS)
def test_hits(spark, how):
    long = " ".join(f"Word{i}" for i in range(30))
    items = [(1, long), (2, "short item É"), (3, None), (4, ""), (5, "solo"), (6, "SHORT ITEM É")]
    docs = [long, long.lower() + " tail", " ".join(f"word{i}" for i in range(12)), "a short-item.é b", "a short item É b short item É", "solo solo", None, "", "...", long + " x " + long, "Short iteM É"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(odd(spark, *docs), bench, **how)
    assert Counter((r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == Counter(hits_by_hand(docs, items))
    assert decontaminate.hits(odd(spark, *docs), bench.limit(0), **how).where("n_hit > 0").isEmpty()
    assert decontaminate.hits(odd(spark).limit(0), bench, **how).count() == 0


def test_op4_digest(spark, small):
    docs, bench = table(spark, small, "documents").collect(), table(spark, small, "benchmark").collect()
    want = {}
    for d, (n, h, ids) in zip(docs, hits_by_hand([d.text for d in docs], [(b.item_id, b.text) for b in bench]), strict=True):
        want[d.doc_id] = (n, h, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), h > 0 and 20 * h >= n)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op4_decontaminate(spark, small).collect()}
    assert got == want and any(x[4] for x in want.values())


@pytest.mark.parametrize("how", WAYS)
def test_items_without_id_and_string_ids(spark, how):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "one Two Three four FIVE")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), ("b'\"\\", "four five"), ("a", "four five"), ("a", "four five")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(docs, bench, **how).collect()}
    assert got == {1: (3, 3, []), 2: (2, 2, ["a", "b'\"\\"]), 3: (5, 5, ["a", "b'\"\\"])}


@pytest.mark.parametrize("how", WAYS)
def test_spans_are_cut(spark, how):
    item = " ".join(f"w{i}" for i in range(13))
    rows = [(1, "-- " + "filler, " * 300 + item + "! The end."), (2, item), (3, "clean"), (4, None)]
    clash = ["spans", "_out", "judged", "items", "n_hit", "doc_row", "hit_row", "bitmap", "row"]
    docs = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in clash)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, **how)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "-- " + "filler, " * 300 + "The end.", 3: "clean", 4: None}
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in clash)
    assert out.select(F.sum("doc_id")).first()[0] == 8
