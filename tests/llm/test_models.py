"""PII spans, quality scores, page texts and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract, pii, quality_model
from millrace.llm.common import table, written

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_by_hand(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    parts = [*"ab.@-+()12 0_%é9", "x@y.com", "4111111111111111", "192.168.1.1", "1.2.3.4.5", "+1 (234) 567-8901"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == base_by_hand(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a[at]" * 50_000, "A" * 300_000):
        pii.candidates(t, pii.base_spans(t))


def test_op1(spark, small):
    want = {r.doc_id: base_by_hand(r.text) for r in table(spark, small, "documents").collect()}
    for r in pii.op1_pii(spark, small).collect():
        listed = ",".join("%s:%d:%d" % s for s in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want[r.doc_id]) for k, _ in BASE]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_votes_find_secrets_and_leave_numbers(spark):
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    texts = [f'words token = "{hexes(40)}" more' for _ in range(30)] + [f"password={hexes(18)} x" for _ in range(30)] + [f"released under Version {i}.0 in 19{i % 90 + 10}" for i in range(60)] + [None, "", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [pii.KINDS[s.kind] for s in r.spans] for r in pii.detect(df).collect()}
    assert all(found[i] == ["secret"] for i in range(60)) and not any(found[i] for i in range(60, len(texts)))
    assert pii.detect(df.limit(0)).count() == 0
    assert pii.redact("mail a@b.cd now", [{"kind": 0, "start": 5, "end": 11}]) == "mail [EMAIL] now"


def plain_em(votes, rounds, held):
    """EM candidate by candidate, as the textbook has it, from the same start."""
    start = {1: {"-": 0.1, "0": 0.5, "+": 0.4}, 0: {"-": 0.4, "0": 0.5, "+": 0.1}}
    rates = [{y: dict(start[y]) for y in (0, 1)} for _ in votes[0]]
    prior = 0.5
    for _ in range(rounds):
        post = []
        for v in votes:
            like = {y: (prior if y else 1 - prior) * np.prod([r[y][x] for r, x in zip(rates, v, strict=True)]) for y in (0, 1)}
            post.append(like[1] / (like[0] + like[1]))
        prior = min(max((sum(post) + 1) / (len(votes) + 2), 0.02), 0.98)
        for y in (0, 1):
            share = [p if y else 1 - p for p in post]
            for k, r in enumerate(rates):
                r[y] = {x: (sum(w for w, v in zip(share, votes, strict=True) if v[k] == x) + held * start[y][x]) / (sum(share) + held) for x in "-0+"}
    return post, rates


def test_em_recovers_the_rates_of_simulated_labelers():
    rng = random.Random(3)
    true = [{1: (0.05, 0.15, 0.8), 0: (0.7, 0.2, 0.1)}, {1: (0.0, 0.6, 0.4), 0: (0.0, 0.98, 0.02)}, {1: (0.2, 0.2, 0.6), 0: (0.5, 0.2, 0.3)}, {1: (0.1, 0.8, 0.1), 0: (0.4, 0.55, 0.05)}]
    truth = [int(rng.random() < 0.3) for _ in range(4000)]
    votes = ["".join(rng.choices("-0+", r[y])[0] for r in true) for y in truth]
    patterns = sorted(set(votes))
    counts = np.array([votes.count(p) for p in patterns], float)
    post, rates = pii.fit_labelers(patterns, counts)
    for k, r in enumerate(true):
        for y in (0, 1):
            assert np.abs(rates[y, k] - r[y]).max() < 0.08
    of = dict(zip(patterns, post, strict=True))
    right = sum((of[v] >= 0.5) == y for v, y in zip(votes, truth, strict=True))
    chance = lambda v, y: (0.3 if y else 0.7) * np.prod([r[y]["-0+".index(x)] for r, x in zip(true, v, strict=True)])
    best = sum((chance(v, 1) >= chance(v, 0)) == y for v, y in zip(votes, truth, strict=True))
    assert right >= best - 0.01 * len(truth)
    few = votes[:300]
    patterns = sorted(set(few))
    post, rates = pii.fit_labelers(patterns, np.array([few.count(p) for p in patterns], float), rounds=12)
    want, want_rates = plain_em(few, 12, 20.0)
    of = dict(zip(patterns, post, strict=True))
    assert np.allclose([of[v] for v in few], want) and np.allclose(rates[1, 2], [want_rates[2][1][x] for x in "-0+"])


def test_span_classifier_is_the_ridge_optimum():
    rng = np.random.default_rng(1)
    spans = [("secret", v, f"secret|len{k}|dig{k % 3}") for v in ("+++0+", "-00--", "0000+") for k in range(4)]
    targets, counts = rng.random(len(spans)), rng.integers(1, 50, len(spans)).astype(float)
    p = pii.fit_spans(spans, targets, counts)
    names = sorted({n for s in spans for n in pii._features(*s)})
    x = np.array([[n in pii._features(*s) for n in names] + [True] for s in spans], float)
    w = np.linalg.lstsq(x, np.log(p / (1 - p)), rcond=None)[0]
    loss = lambda w: -(counts * (targets * (x @ w) - np.log1p(np.exp(x @ w)))).sum() + 0.05 * w @ w
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(0, 0.05, (200, len(w))))


def test_every_kind_has_its_own_evidence():
    cases = [
        ("phone", "(212) 555-0182", "call ", "(100) 000-0000", "version "),
        ("national_id", "219-45-1234", "his ssn ", "078-05-1120", "isbn "),
        ("iban", "DE89 3704 0044 0532 0130 00", "konto ", "DE89 3704 0044 0532 0130 01", "revision "),
        ("email", "jane [at] example [dot] com", "write to ", "x [at] y [dot] zzzz", "version "),
        ("secret", "0a1b2c3d4e5f60718293", "token = ", "4.0.11", "version "),
    ]
    for kind, good, before, bad, other in cases:
        value = lambda v: sum({"+": 1, "0": 0, "-": -1}[c] for c in v)
        assert value(pii.votes(kind, good, before)) >= 2 > 0 >= value(pii.votes(kind, bad, other))
    seen = {}
    for kind, good, before, bad, other in cases:
        for span, near, n in ((good, before, 30), (bad, other, 40)):
            seen[(kind, pii.votes(kind, span, near), pii.shape(kind, span))] = n
    accepted = pii.verdicts(seen)
    assert {k for k, *_ in accepted} == {c[0] for c in cases} and len(accepted) == len(cases)


@pytest.mark.parametrize("text", ["write to jane.doe (at) example (dot) com please", f"use sk_{'abcdefghij' * 2} here", f"key {'QWERTYUIOP' * 2} here", f"sum {'abcdef' * 3} here"])
def test_candidates_need_no_digit_elsewhere(spark, text):
    df = spark.createDataFrame([(1, text), (2, f"{text} 5 = 5")], "doc_id long, text string")
    alone, beside = (r.found for r in pii.scan(df).orderBy("doc_id").collect())
    assert len(alone) == 1 and alone[0] in beside


@pytest.mark.parametrize("before, secret", [("token=", "eyJ" + "aB3-_" * 80), ("see ", "sk_" + "a1B2" * 30), ("see ", "0a1b" * 50), ("see ", "x" * 50 + "1/" + "y" * 90)])
def test_long_secrets_are_whole(before, secret):
    text = f"{before}{secret} and more"
    assert [(s, e) for _, s, e, *_ in pii.candidates(text, pii.base_spans(text))] == [(len(before), len(before) + len(secret))]


def test_a_secret_ends_where_an_address_starts():
    text = "token=" + "x1" * 150 + "/a@b.cd"
    assert [(s, e) for _, s, e, *_ in pii.candidates(text, pii.base_spans(text))] == [(6, 307)]


def test_unbounded_runs_take_linear_time():
    for t in ("_-" * 150_000, "a-" * 150_000, "sk_" * 100_000, "token=" * 50_000, "f" * 300_000 + "g", "a/" * 150_000, "a_" * 150_000 + "."):
        pii.candidates(t, pii.base_spans(t))


def test_quality_on_held_out_rows(spark, small):
    got = {r.doc_id: r for r in quality_model.op2_nbsvm(spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in table(spark, small, "labels").collect()]
    judged = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(judged) > 10 and sum(p == y for p, y in judged) / len(judged) > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.train(docs, none)
    assert [round(r.score, 6) for r in quality_model.score(docs, model).collect()] == [0.5] * 3
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert quality_model.score(docs.limit(0), quality_model.train(docs, one)).count() == 0


def indicators_by_hand(text):
    """The places of a text's indicators, gram by gram."""
    ws = (text or "").split()
    mix = lambda *parts: int(quality_model._mix(*[np.uint64(p) for p in parts]))
    word = [zlib.crc32(w.lower().encode()) for w in ws]
    form = [zlib.crc32(quality_model.shape(w).encode()) for w in ws]
    low = lambda x: x & 0xFFFFFFFF
    pairs = range(len(ws) - 1)
    out = {mix(low(mix(x, 1)), 0) for x in word} | {mix(low(mix(word[i], word[i + 1], 7)), 0) for i in pairs}
    for grams in ([low(mix(x, 2)) for x in form], [low(mix(form[i], form[i + 1], 3 + (ws[i] == ws[i + 1]))) for i in pairs]):
        for g in set(grams):
            out |= {mix(g, 0)} | {mix(g, k + 1) for k, share in enumerate((0.02, 0.1, 0.3)) if grams.count(g) >= share * len(ws)}
    out |= {mix(np.ceil(np.log2(len(ws) + 1)), 5), mix(np.floor(10 * len(set(ws)) / max(len(ws), 1)), 6)}
    return sorted({x % quality_model.PLACES for x in out})


def test_indicators_against_plain_grams():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [None, "", "one", "a a A B2 b2 -- x", *(" ".join(rng.choice(["the", "The", "cat", "x1", "N!", "3"]) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    places, offsets = quality_model.Indicators()(pa.array(texts, pa.string()))
    assert [places[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [indicators_by_hand(t) for t in texts]


def test_log_ratio_by_hand():
    x, y = [np.array([1, 2]), np.array([1, 3]), np.array([2, 3, 4])], np.array([1, 1, 0])
    r = quality_model.log_ratio(x, y)
    n = quality_model.PLACES
    of = lambda a, b: np.log((a + 1) / (4 + n)) - np.log((b + 1) / (3 + n))
    assert np.allclose(r[[1, 2, 3]], [of(2, 0), of(1, 1), of(1, 1)]) and r[4] == r[5] == 0


def test_dual_descent_is_the_optimum_of_the_hinge_loss():
    """Against projected gradient steps on the same dual problem, and by the gap between primal and dual."""
    rng = np.random.default_rng(2)
    n, cost = 60, 0.7
    y = rng.integers(0, 2, n)
    x = [np.sort(rng.choice(25, 6, replace=False)) for _ in range(n)]
    v = [rng.normal(0, 1, 6) + 0.4 * (2 * k - 1) for k in y]
    w = quality_model.dual_descent(x, v, y, cost=cost, rounds=3000)
    a = np.zeros((n, 25))
    for i in range(n):
        a[i, x[i]] = v[i]
    sign = 2.0 * y - 1
    upper = cost * n / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    primal = lambda u: u @ u / 2 + (upper * np.maximum(0, 1 - sign * (a @ u))).sum()
    q = (sign[:, None] * a) @ (sign[:, None] * a).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, upper)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert abs(primal(w[:25]) - dual) < 1e-2 * dual and primal(w[:25]) >= dual - 1e-6
    assert np.abs(w[:25] - a.T @ (sign * alpha)).max() < 0.05


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"word{i % 2} text {i % 2}") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    seen, whole = [], quality_model.fit
    quality_model.fit = lambda x, y: seen.append((len(x), sum(map(len, x)))) or whole(x, y)
    try:
        for how in ({}, {"max_rows": 50}, {"max_places": 300}):
            model = quality_model.train(docs, labels, **how)
        assert quality_model.score(docs, model).count() == 401
    finally:
        quality_model.fit = whole
    assert seen[0][0] > 250 and seen[1][0] == 50 and 200 < seen[2][1] <= 300
    odd = docs.where("doc_id is null").select(quality_model.held_out().alias("h")).first()
    assert odd.h is False


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 80)
    x = [np.array([k + 10 * int(c) for k in range(3)] + [50 + i]) for i, c in enumerate(y)]
    w = quality_model._weights(x, y)
    assert all((w[p].sum() > 0) == (c == 1) for p, c in zip(x, y, strict=True))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><header><h1>Head &amp; tail</h1></header><p>First<br>line &lt;b&gt;<div class="ad-box">Buy</div><p class="lead">Second\n  line&nbsp;x<form><input> f</form>
<section class="comments"><article><p>Nice!</p></article></section></article><aside>more</aside><footer>foot</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(PAGE) == "Head & tail\nFirst line <b>\nSecond line x"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    assert html_extract.main_text("<article><h1>A</h1><p>b &am") == "A\nb &am"


@pytest.mark.parametrize("inner", ['<svg class="i" x="a/b>"/>', "<math/>", "<svg/>x<svg><path/></svg>", "<div><svg>x</div>", "<div><select><option>x</div>", "<div><video src=v></div>", "<div><object>x<svg>y</div>", "<svg>x<svg>y</svg>z</svg>", "<div><svg>x</div><svg>y</svg>"])
def test_skipped_elements_end_with_their_container(inner):
    got = html_extract.main_text(f"<article><p>a</p>{inner}<p>rest</p></article><footer>f</footer>")
    assert [x for x in got.split("\n") if x != "x"] == ["a", "rest"]


@pytest.mark.parametrize("shard_tokens", [1, 2_000_000])
def test_host_streams_without_a_main_zone(spark, shard_tokens):
    page = "<body><div><h1>Head {0}</h1><p>Unique text number {0} goes here.<p>Read more on our great site today.</div><div>Home</div></body>"
    rows = [(i, f"http://a.com/{i}", page.format(i)) for i in range(4)] + [(9, "http://b.com/", page.format(9)), (10, None, None), (11, "http://c.com", "<article>x</article>"), (11, "http://c.com", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in html_extract.extract(df).collect()]
    want = [(i, f"Head {i}\nUnique text number {i} goes here.") for i in range(4)]
    assert sorted(got) == sorted([*want, (9, "Head 9\nUnique text number 9 goes here.\nRead more on our great site today.\nHome"), (10, ""), (11, "x"), (11, "")])
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("mark", ["<!-- <article> -->", "<script>'<main>'</script>", "<main></main>", '<div class="sidebar"><article>Teaser {0}</article></div>', '<section class="comments"><article>Reply {0}</article></section>'])
def test_pages_without_main_text_go_to_the_host_stream(spark, mark):
    page = "<body>" + mark + "<div><h1>Head {0}</h1><p>Unique text number {0} goes here.<p>Read more on our great site today.</div></body>"
    df = spark.createDataFrame([(i, f"http://a.com/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"Head {i}\nUnique text number {i} goes here." for i in range(12)}


@pytest.mark.parametrize("max_marks", [1000, -1])
def test_host_evidence_counts_in_articles_too(spark, max_marks):
    """A whole block on more than half of a host's pages goes from its articles; shared sentences and an article shown twice stay."""
    notice = "This story is brought to you by the friends of our newsroom, thank you all."
    page = "<body><nav>Home</nav><article><h1>Head {0}</h1><p>Text number {0} of many, said once.</p><p>{1}</p></article><footer>f</footer></body>"
    rows = [(i, f"http://a.com/{i}", page.format(i, notice if i % 5 else "In the end it rained.")) for i in range(20)]
    rows += [(20 + i, f"http://a.com/again{i}", page.format("twice", "Shown twice.").replace("Home", f"Home {i}")) for i in range(2)]
    rows += [(30 + i, f"http://b.com/{i}", page.format(i, notice)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, max_marks=max_marks).collect()}
    own = lambda i, more: f"Head {i}\nText number {i} of many, said once.{more}"
    want = {i: own(i, "" if i % 5 else "\nIn the end it rained.") for i in range(20)}
    want |= {20 + i: own("twice", "\nShown twice.") for i in range(2)} | {30 + i: own(i, f"\n{notice}") for i in range(4)}
    assert got == want


def test_host_streams_agree_with_a_plain_search(spark):
    """Runs of open text that repeat on a host's pages, found by hand token window by token window."""
    rng, width = random.Random(12), 6
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(4, 25))) for _ in range(5)]
    pages = []
    for i in range(30):
        words = [" ".join(rng.choice("uvwxyz") + str(rng.randrange(10**6)) for _ in range(rng.randint(1, 20))) for _ in range(4)]
        for x in rng.sample(shared, rng.randint(0, 3)):
            words.insert(rng.randrange(len(words) + 1), x if rng.random() < 0.5 else f"{words.pop()} {x} {i}")
        pages.append((i % 3, words))
    df = spark.createDataFrame([(i, f"http://h{h}.com/", "".join(f"<p>{w}</p>" for w in ws)) for i, (h, ws) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, width=width).collect()}
    windows_of = lambda w: {tuple(t) for t in [w.split()] if len(t) < width} | {tuple(w.split()[k : k + width]) for k in range(len(w.split()) - width + 1)}
    for i, (h, ws) in enumerate(pages):
        others = [set().union(*map(windows_of, q)) for g, q in pages if g == h]
        out = []
        for w in ws:
            t = w.split()
            gone = set()
            for k in range(max(1, len(t) - width + 1)):
                win = tuple(t[k : k + width]) if len(t) >= width else tuple(t)
                if sum(win in o for o in others) >= 3:
                    gone |= set(range(k, k + len(win)))
            out.append(" ".join(x for k, x in enumerate(t) if k not in gone))
        assert got[i] == "\n".join(x for x in out if x), i


def windows_by_hand(words, width):
    t = words.split()
    return {tuple(t)} if len(t) < width else {tuple(t[k : k + width]) for k in range(len(t) - width + 1)}


def without_shared(words, others, width, need):
    t, gone = words.split(), set()
    for k in range(max(1, len(t) - width + 1)):
        win = tuple(t[k : k + width]) if len(t) >= width else tuple(t)
        if sum(win in o for o in others) >= need:
            gone |= set(range(k, k + len(win)))
    return " ".join(x for k, x in enumerate(t) if k not in gone)


@pytest.mark.parametrize("hot", [20_000, 0])
def test_templates_within_articles_go(spark, monkeypatch, hot):
    """Runs within the paragraphs of articles on half of a host's pages go, whatever stands around them, and others stay: as a search of all
    windows finds. With hot=0 each anchor is compared window by window."""
    whole = html_extract.host_boilerplate
    monkeypatch.setattr(html_extract, "host_boilerplate", lambda pages, width: whole(pages, width, hot=hot))
    rng, width = random.Random(13), 6
    say = lambda n: " ".join(rng.choice("uvwxyz") + str(rng.randrange(10**6)) for _ in range(n))
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)) for n in (9, 30, 4, 14)]
    pages = []
    for i in range(40):
        words = [say(rng.randint(1, 15)) for _ in range(4)]
        for x, often in zip(shared, (0.9, 0.7, 0.8, 0.3), strict=True):
            if rng.random() < often:
                k = rng.randrange(4)
                words[k] = f"{words[k]} {x} {say(2)}" if len(x.split()) >= width else words[k]
                words += [x] if len(x.split()) < width else []
        pages.append((i % 2, words))
    shape = "<body><nav>Home of all</nav><article>{}</article></body>"
    df = spark.createDataFrame([(i, f"http://h{h}.com/", shape.format("".join(f"<p>{w}</p>" for w in ws))) for i, (h, ws) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, width=width).collect()}
    changed = 0
    for i, (h, ws) in enumerate(pages):
        own = [set().union(*(windows_by_hand(w, width) for w in q)) for g, q in pages if g == h]
        want = "\n".join(x for x in (without_shared(w, own, width, len(own) / 2) for w in ws) if x)
        assert got[i] == want, i
        changed += want != "\n".join(ws)
    assert changed > 30


def test_crowded_anchors_are_spread(spark):
    """One passage in a different paragraph of each of 600 pages: its contexts share anchors, and no window's comparison holds more than its equals."""
    passage = " ".join(f"p{j}" for j in range(40))
    pages = [(i, "http://a.com/", f"<article><p>start{i} {passage} end{i}</p></article>") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    marks = {}
    for hot in (20_000, 100):
        rows = html_extract.host_boilerplate(df.select(F.lit("a.com").alias("_host"), F.col("html").alias("_html")), 30, hot=hot).collect()
        marks[hot] = {r.block: sorted(map(tuple, r.runs)) for r in rows}
    assert marks[20_000] == marks[100] and len(marks[100]) == 600
    assert all(r == [(k, k + 30, True) for k in range(1, 12)] for r in marks[100].values())


def test_anchors_of_windows():
    """Each window is in one context, and equal windows have equal anchors wherever they stand."""
    rng = random.Random(14)
    a = " ".join(str(rng.randrange(50)) for _ in range(400))
    b = f"x y z {' '.join(a.split()[100:200])} q"
    found = {}
    for k, lo, hi, anchor, h in html_extract._contexts(html_extract._tokens([a, b, "too short"]), 30):
        assert len(h) == hi - lo + 30
        for w in range(lo, hi + 1):
            assert (k, w) not in found
            found[k, w] = anchor, h[w - lo : w - lo + 30].tobytes()
    assert len(found) == 371 + 75
    by_window = {}
    for anchor, window in found.values():
        assert by_window.setdefault(window, anchor) == anchor
    assert all(found[1, 3 + k] == found[0, 100 + k] for k in range(71))


def test_a_block_that_another_holds_is_marked_too(spark):
    """A page has the run alone and within another paragraph: it counts once, and both go."""
    run = " ".join(f"r{j}" for j in range(31))
    page = "<body><div>{0} {1}</div><div>{1}</div><div>own {0}</div></body>"
    df = spark.createDataFrame([(i, "http://a.com/", page.format(f"n{i}", run)) for i in range(3)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {i: f"n{i}\nown n{i}" for i in range(3)}


def test_formulas_and_forms():
    assert html_extract.main_text("<article><p>energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> end</p></article>") == "energy E=m end"
    assert html_extract.main_text("<body><form><div>all of it</div><nav>n</nav></form></body>") == "all of it"
    assert html_extract.main_text("<body><p>text</p><form><div>field</div></form></body>") == "text"
    assert html_extract.main_text("<body><form><div>d</div><article>x</article></form></body>") == "x"


def test_shared_runs_of_long_pages_are_bounded():
    import tracemalloc

    text = " ".join(f"t{j}" for j in range(100_000))
    html_extract._tokens([text])
    tracemalloc.start()
    assert list(html_extract._shared_runs({text, f"{text} x"}, 30)) == [(text, 1)]
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()


def test_class_words_in_an_article():
    inner = '<p class="social">One.</p><p class="related-work">Two.</p><div class="notification-study">Three.</div><h2 class="menu">Four.</h2><section id="search-methods">Five.</section>'
    side = '<div class="ad-box">x</div><p class="ads">x</p><div class="social-share-buttons">x</div><ul class="related-links"><li>x</ul><div id="comments2">x</div><div class="newsletterSignup box">x</div><p hidden>x</p>'
    assert html_extract.main_text(f"<article>{inner}{side}</article>") == "One.\nTwo.\nThree.\nFour.\nFive."


@pytest.mark.parametrize("unit", ["<a ", '<p class="', "<script ", "<head>", "<svg>", "<svg ", "</p", "<!--", "<", "<p>", "<article>", "<nav><article>", "<div></b>", '<a "> "', "<a '>", '<a "x" <', "&lt", "<p class='a\">", "<title>", "</svg><math>", "<textarea></textarea", "</title  "])
@pytest.mark.parametrize("end", ["", ">", "\">", "</head><body>"])
def test_hostile_pages_take_linear_time(unit, end):
    import time

    page = unit * (400_000 // len(unit)) + end
    began = time.process_time()
    html_extract.page_blocks(page)
    assert time.process_time() - began < 4


def test_tags_that_break_off():
    assert html_extract.main_text('<article><p>a</p><p title="x>b</p></article>') == "a\nb"
    assert html_extract.main_text("<article><p>1 < 2 and 3 > 2</p><p>rest <b") == "1 < 2 and 3 > 2\nrest"
    assert html_extract.main_text('<article><p data-x="a > b">c</p></article>') == "c"


def test_an_article_alone_in_a_side_container_is_the_text():
    assert html_extract.main_text("<body><div class='overlay'><nav>n</nav><article>x</article></div></body>") == "x"
    assert html_extract.main_text("<body><form><div>d</div><article>x</article></form></body>") == "x"


@pytest.mark.parametrize("shard_tokens", [1, 2_000_000])
def test_host_streams_leave_copies_and_shared_passages(spark, monkeypatch, shard_tokens):
    whole = html_extract.host_boilerplate
    monkeypatch.setattr(html_extract, "host_boilerplate", lambda pages, width: whole(pages, width, shard_tokens))
    say = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    phrase, quote, notice = "at the end of the day it is", say("quote", 45), say("notice", 40)
    paragraphs = [f"{say(f'a{i}x', 20)} {phrase if i % 3 else quote if i < 12 else 'none'} {say(f'b{i}x', 20)}" for i in range(60)]
    paragraphs[59] = paragraphs[58]  # an article twice
    page = "<body><p>Home of news</p><p>Page {0}</p><div>{1}</div><div>by {0} {2}</div></body>"
    pages = [page.format(i, p, notice) for i, p in enumerate(paragraphs)]
    want = [f"Page {i}\n{p}\nby {i}" for i, p in enumerate(paragraphs)]
    again = say("again", 35)  # twice on each of two pages
    pages += [f"<body><div>{x} {again}</div><div>{again} {x}</div></body>" for x in ("one", "two")]
    want += [f"{x} {again}\n{again} {x}" for x in ("one", "two")]
    pages += ["<body><p>exact copy of a page</p></body>"] * 5
    want += ["exact copy of a page"] * 5
    df = spark.createDataFrame([(i, "http://big.com/" if i < 60 else "http://small.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == dict(enumerate(want))


def test_shared_runs_count_a_page_once():
    assert sorted(html_extract._shared_runs({"a b c d x", "y a b c d", "b c d z", "q"}, 2)) == [("a b", 1), ("b c d", 2)]
    assert sorted(html_extract._shared_runs({"a b a b", "a b a"}, 2)) == [("a b a", 1)]


def test_op7_is_the_article(spark, small):
    import html

    got = {r.page_id: r.text for r in html_extract.op7_main_text(spark, small).collect()}
    for r in table(spark, small, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c

    docs = table(spark, small, "documents")
    columns, kept = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = written(stage(spark, docs, small), name)
        assert docs.columns == columns and 0 < docs.count() <= kept
        assert docs.where("n_chars <> length(text)").isEmpty()
        kept = docs.count()
    packed = c.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == kept
