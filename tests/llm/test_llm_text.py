"""Quality, licenses, page text and language-model scores against plain versions."""

import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from llm_brute import alnum, spaced

from flatloom.llm import class_lm
from flatloom.llm.html_text import extract, main_text
from flatloom.llm.licenses import NOTICES, NoticeScanner, edits_allowed, license_scan, pieces
from flatloom.llm.quality import SIZE, Model, fit, learn, quality_score

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Quality


def bag(rng, n):
    x = rng.random((n, SIZE)).astype(np.float32)
    return x, np.array([0, 3, 4, n])


def test_gradients():
    rng = np.random.default_rng(0)
    x, begin = bag(rng, 9)
    y, model = np.array([1, 0, 1], dtype=np.float32), Model.fresh()
    model.parts = [p.astype(np.float64) for p in model.parts]

    def loss():
        p = model.forward(x.astype(np.float64), begin)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(x.astype(np.float64), begin, y)
    for part, gradient in zip(model.parts, found, strict=True):
        at = tuple(rng.integers(0, s) for s in part.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        down = loss()
        part[at] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-5


def test_one_bad_passage_decides():
    """Only the bag is labelled; one passage of a bad bag is bad, and attention finds it."""
    rng = np.random.default_rng(4)
    xs, sizes, ys = [], [], []
    for _ in range(400):
        n, good = rng.integers(1, 8), rng.random() < 0.5
        x = np.abs(rng.standard_normal((n, SIZE))).astype(np.float32) * 0.1
        x[:, 5] = 0
        if not good:
            x[rng.integers(n), 5] = 1
        xs.append(x)
        sizes.append(n)
        ys.append(good)
    x, begin, y = np.concatenate(xs), np.concatenate([[0], np.cumsum(sizes)]), np.array(ys, dtype=np.float32)
    half = 300
    model = fit(x[: begin[half]], begin[: half + 1], y[:half])
    found = model.forward(x, begin)
    assert ((found["p"] >= 0.5) == (y > 0))[half:].mean() > 0.95
    bad = np.flatnonzero((y == 0) & (np.diff(begin) > 2))
    hits = sum(np.argmax(found["a"][begin[b] : begin[b + 1]]) == np.argmax(x[begin[b] : begin[b + 1], 5]) for b in bad)
    assert hits > 0.8 * len(bad)


def test_quality_edges(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, 40 + i % 90).upper() if i % 3 == 0 else text(rng, 40 + i % 90)) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "  \n"), (203, text(rng, 40_000)), (None, "some text"), rows[0]]
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, score string, label int")
    marks = [(i, int(i % 3 != 0)) for i in range(150)] + [(7, None), (None, 1), (10_000, 1), (3, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    weights = learn(docs, labels)
    found = docs.withColumn("p", quality_score(weights, docs.text)).collect()
    assert len(found) == len(rows) and all(0 <= r.p <= 1 for r in found)
    right = [(r.p >= 0.5) == (r.doc_id % 3 != 0) for r in found if r.doc_id is not None and 150 <= r.doc_id < 200]
    assert sum(right) >= 0.95 * len(right)
    assert learn(docs, labels.limit(0)) is None
    assert {r.p for r in docs.select(quality_score(None, docs.text).alias("p")).collect()} == {0.5}
    assert docs.limit(0).select(quality_score(weights, docs.text)).collect() == []


# Licenses


def test_pieces():
    for notice in NOTICES:
        k = edits_allowed(notice)
        parts = pieces(notice, k)
        assert len(parts) == k + 1 and "".join(p for _, p in parts) == notice
        assert all(notice[a:].startswith(p) for a, p in parts)


def damaged(rng, notice, edits):
    for _ in range(edits):
        i = rng.randrange(len(notice))
        notice = rng.choice([notice[:i] + "~" + notice[i + 1 :], notice[:i] + notice[i + 1 :], notice[:i] + "q" + notice[i:]])
    return notice


def test_licenses(spark):
    rng, rows, planted = random.Random(2), [], {}
    for i, (notice, label) in enumerate(list(NOTICES.items()) * 4):
        k = edits_allowed(notice)
        planted[i] = (label, damaged(rng, notice.upper() if i % 2 else notice, i % (k + 1)))
        rows.append((i, text(rng, 30) + " " + planted[i][1] + " " + text(rng, 20)))
    rows += [(100, None), (101, ""), (102, "CC-BY, cc by cc\nby; cc bye"), (103, "All rights  RESERVED. General public license é"), (104, text(rng, 50_000))]
    docs = spark.createDataFrame([(*r, "x") for r in rows + [rows[0]]], "doc_id long, text string, labels string")
    found = {r.doc_id: r for r in license_scan(docs).collect()}
    assert len(found) == len(rows)
    for i, (label, notice) in planted.items():
        assert label in found[i].labels, notice
        assert all(r.edits <= 8 and r.begin < r.end for r in found[i].notices)
    for i, t in rows:
        low = (t or "").lower()
        want = {label for notice, label in NOTICES.items() if regex.search(f"(?:{regex.escape(notice)}){{e<={edits_allowed(notice)}}}", low[:4000])}
        assert {n.label for n in found[i].notices} == want
        assert found[i].n_words == len(alnum(t))
    assert [(p.word, p.label) for p in found[102].places] == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by")]
    assert [(p.word, p.label) for p in found[103].places] == [(0, "reserved"), (3, "gpl")]
    assert found[104].labels == [] and found[100].n_words == 0
    assert license_scan(docs.limit(0)).collect() == []


def test_adjacent_copies_are_all_found():
    notice = next(iter(NOTICES))
    first = notice.replace("licensed", "licenced").replace(", version", " version")
    scanner = NoticeScanner(NOTICES)
    for copies in ([first, notice], [first, notice, first], [notice, first, first, notice], [first, first, first]):
        text = "\n".join(copies)
        found = [(b, e, n) for label, b, e, n in scanner.scan(text) if label == "apache-2.0"]
        begins = [sum(len(c) + 1 for c in copies[:i]) for i in range(len(copies))]
        assert len(found) == len(copies), copies
        assert all(abs(f[0] - b) <= 3 and f[2] == (0 if c == notice else 2) for f, b, c in zip(found, begins, copies, strict=True))


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site header, with commas, many</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, a lot of them, really.</p></div><div class="ad">Buy, now, cheap, things</div>
<article><h1>Head &amp; line</h1><p><b>First, bold<br><p>Second   paragraph, with&nbsp;more
text &lt;here&gt;.</p><ul><li>one<li>two <a href="x">link</a></ul><form><p>name, mail</p></form></article>
<div id="comments"><p>Nice, article, I, like, it, a, lot, really, much, so, long, comment</p></div>
<aside><p>Related, things, to, read</p></aside><footer>&copy; 2020, Site</footer>"""


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (PAGE, "Head & line First, bold Second paragraph, with more text <here>. one two link"),
        (PAGE + "<p>cut o", "Head & line First, bold Second paragraph, with more text <here>. one two link"),
        (None, ""),
        ("", ""),
        ("no tags, only text", "no tags, only text"),
        ("<p>a, b</i></div></p><p>c", "a, b c"),
        ("<div>" * 5000 + "<p>deep, text</p>", "deep, text"),
        ("<p><a href='x'>all of it, a link</a></p>", ""),
        ("<p>one, two <!-- not > this --> three<script>x</script> four</p>", "one, two three four"),
        ("<p>&#xD800; x, &#0; &bogus; &am", None),
        ("<p>a, b <span class", "a, b"),
    ],
)
def test_main_text(page, expected):
    found = main_text(page)
    assert expected is None or found == expected


def test_best_container():
    para = "<p>" + "Long text, with commas, that scores. " * 5 + "</p>"
    page = f"<body><div><a href=x>one</a> <a href=y>two, three</a></div><div id=story>{para * 3}</div><div class=sidebar>{para * 9}</div></body>"
    assert main_text(page) == " ".join([("Long text, with commas, that scores. " * 5).strip()] * 3)


@pytest.mark.parametrize("n", [1, 5, 11, 13, 40])
@pytest.mark.parametrize("tag", ["article", "main", 'div itemprop="articleBody"'])
def test_article_is_kept_whole(n, tag):
    """On both sides of the points from which an inner div beats its article."""
    para = "Long text, with commas, that scores. " * 5
    page = f"<body><div>Outside, of it</div><{tag}><h1>Head</h1><div>{f'<p>{para}</p>' * n}</div><ul><li>one<li>two</ul><blockquote>Said</blockquote></{tag.split()[0]}></body>"
    assert main_text(page) == " ".join(["Head", *[para.strip()] * n, "one two Said"])


@pytest.mark.parametrize("n", [3, 40])
def test_short_siblings_are_kept(n):
    para = "Long text, with commas, that scores. " * 5
    links = "<ul><li><a href=x>one</a><li><a href=y>two, three</a></ul>"
    page = f"<body><h1>Head</h1>Between<div>{f'<p>{para}</p>' * n}</div>{links}<div>Short, section</div><ul><li>one<li>two</ul><blockquote>Said</blockquote><div class=sidebar>Not</div></body>"
    assert main_text(page) == " ".join(["Head Between", *[para.strip()] * n, "Short, section one two Said"])


PARA = "<p>Long text, with commas, that scores. And more of it, for good measure.</p>"
SAID = "Long text, with commas, that scores. And more of it, for good measure."


@pytest.mark.parametrize(
    "page, expected",
    [
        (f'<div class="content with-sidebar"><h1>H</h1>{PARA}</div>', f"H {SAID}"),
        (f'<div class="page no-sidebar"><article><h1>H</h1>{PARA}</article></div>', f"H {SAID}"),
        (f'<div class="sidebar"><h1>H</h1>{PARA}</div><p>x</p>', f"H {SAID} x"),
        (f'<article>{PARA}<section id="related-work"><p>Other work.</p></section><p class="share-price">9.50</p></article>', f"{SAID} Other work. 9.50"),
        (f'<article>{PARA}<div class="related-posts">Not</div><div id="share_buttons">Not</div><div class="comment-list">Not</div></article>', SAID),
        (f"<body><form><h1>H</h1>{PARA}</form></body>", f"H {SAID}"),
        (f"<body><form>{PARA}</form></body>", SAID),
        (f"<body>{PARA}<form><p>Send, please</p></form></body>", SAID),
        (f"<body><p>One, two</p><div id=comments><h1>Said</h1>{PARA * 30}</div></body>", "One, two"),
        (f"<body><nav>{PARA * 30}</nav><p>One, two</p></body>", "One, two"),
        (f"<article>{PARA}<svg><path d='x'><p>After</p></article>", f"{SAID} After"),
        (f"<article>{PARA}<p>a <svg><title>t</title><text>no</text></svg> b</p></article>", f"{SAID} a b"),
        (f"<article>{PARA}<div><video><source src=x></div><p>After</p></article>", f"{SAID} After"),
        (f"<article>{PARA}<script>x</script y><p>After</p></article>", f"{SAID} After"),
        (f"<article>{PARA}<p>In <math><mi>x</mi><mo>=</mo><mn>1</mn></math> it</p></article>", f"{SAID} In x=1 it"),
        ("<body><h1>One</h1><h2>Two</h2></body>", "One Two"),
        (f"<article>{PARA}<p title='a > b'>in</p><a \"<p>out</p></article>", f"{SAID} in out"),
    ],
)
def test_nothing_else_is_dropped(page, expected):
    assert main_text(page) == expected


@pytest.mark.parametrize(
    "page",
    ['<a "' * 40_000, "<a '>x" * 40_001, "<div>" * 40_000 + "</div>" * 40_000, "<div>" * 40_000 + "</span>" * 40_000, "<li>" * 40_000, "<" * 400_000, "<script>x</scrip " * 40_000],
)
def test_time_is_linear_in_the_page(page):
    """The square of these would take minutes."""
    began = time.monotonic()
    main_text(page + PARA)
    assert time.monotonic() - began < 10


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", None), (4, "u", "<p>&#xD800;a, b</p>", "x"), (1, "u", PAGE, "x")]
    rows.append((5, "u", "<article>" + "<p>some, text é</p>" * 20_000, "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert next(r for r in found if r.page_id == 5).text == " ".join(["some, text é"] * 20_000)
    assert extract(pages.limit(0)).collect() == []


# Language model


@pytest.mark.parametrize("vocabulary", [class_lm.VOCABULARY, 40, 0])
def test_class_scores(spark, vocabulary):
    rng, rows = random.Random(6), []
    groups = [WORDS[:100], WORDS[100:200], WORDS[200:]]
    for i in range(300):  # words of a group follow each other
        own = groups[i % 3]
        rows.append((i, " ".join(own[int(rng.random() ** 3 * 100)] for _ in range(rng.randrange(80)))))
    rows += [(300, None), (301, ""), (302, "unknown words alone"), (303, " ".join(WORDS) * 90)]
    held = {r[0] for r in rows if r[0] % 5 == 2}
    docs = spark.createDataFrame([(*r, "x") for r in rows + [rows[2]]], "doc_id long, text string, score string")
    training = docs.filter("doc_id % 5 <> 2")
    model = class_lm.learn(training, classes=3, frequent=30, vocabulary=vocabulary)
    found = class_lm.scores(docs, model).collect()
    assert len(found) == len(rows) + 1
    tokens = {k: [*spaced(t), None] for k, t in rows}
    c = Counter(w for k, t in tokens.items() if k not in held for w in t)
    n, v = sum(c.values()), len(c)
    assert (model.n_tokens, model.n_types) == (n, v)
    got = {r.doc_id: r for r in found}
    for k, t in tokens.items():
        assert (got[k].n_tokens, got[k].n_known) == (len(t), sum(c[w] > 0 for w in t))
        assert math.isclose(got[k].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    # The score by its definition, from every training word's class.
    tail = {r.hash: (r.n, r["class"]) for r in model.tail.collect()} if model.tail else {}
    place = {int(h): i for h, i in zip(model.lexicon.sorted, model.lexicon.order, strict=True)}
    assert len(tail) + len(place) == v and not set(tail) & set(place)
    hash_of = {w: class_lm.END if w is None else int(next(class_lm._tokens(pa.array([w])))[1][0]) for w in {w for t in tokens.values() for w in t}}

    def counted(w):
        h = hash_of[w]
        return (int(model.frequency[place[h]]), int(model.of[place[h]])) if h in place else tail.get(h, (0, 3))

    assert all(counted(w)[0] == c[w] for w in hash_of)
    steps, size, held_by = np.zeros((4, 4)), np.zeros(4), np.zeros(4)
    for k, t in tokens.items():
        if k not in held:
            for x, y in zip([None, *t], t, strict=False):
                steps[counted(x)[1], counted(y)[1]] += 1
    # Row 2 stands twice among the documents but is held out.
    for w, x in c.items():
        size[counted(w)[1]] += 1
        held_by[counted(w)[1]] += x
    size[3] += 1
    share = (held_by + 0.5) / (held_by + 0.5).sum()
    follow = (steps + class_lm.SMOOTH * share) / (steps.sum(axis=1, keepdims=True) + class_lm.SMOOTH)
    assert np.allclose(follow.sum(axis=1), 1) and np.allclose(10**model.transition, follow)
    for k, t in tokens.items():
        score = 0.0
        for x, y in zip([None, *t], t, strict=False):
            own = counted(y)[1]
            score += math.log10(follow[counted(x)[1], own]) + math.log10((c[y] + 0.5) / (held_by[own] + 0.5 * max(size[own], 1)))
        assert math.isclose(got[k].score, score, rel_tol=1e-9), k
    per_token = lambda name: sum(got[k][name] for k in held) / sum(got[k].n_tokens for k in held)
    if vocabulary > 300:
        assert per_token("score") > per_token("base_score") + 0.2
    assert class_lm.scores(docs.limit(0), model).collect() == []
    empty = class_lm.learn(training.limit(0))
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in class_lm.scores(docs, empty).collect())


@pytest.mark.parametrize("vocabulary", [1000, 7, 0])
def test_neighbours_are_counted_once(spark, monkeypatch, vocabulary):
    """What sweeps read: every step of the texts from both its words, a word whole in one row."""
    monkeypatch.setattr(class_lm, "NEIGHBOURS", 50)
    monkeypatch.setattr(class_lm, "ENTRIES", 3)
    rng = random.Random(3)
    texts = [None, "", *(" ".join(rng.choice(WORDS[:20]) for _ in range(rng.randrange(30))) for _ in range(40))]
    column = pa.array([t or "" for t in texts])
    ((_, tokens, first),) = class_lm._tokens(column)
    words = [h for h, _ in Counter(tokens.tolist()).most_common() if h != class_lm.END]
    lexicon = class_lm.Lexicon.of(np.array([*words[:vocabulary], class_lm.END]))
    ids, end, width = lexicon.ids(tokens), lexicon.rare - 1, lexicon.rare + 1
    wanted = Counter()
    for x, y in zip(class_lm._before(ids, first, end).tolist(), ids.tolist(), strict=True):
        wanted.update([(y, x), (x, y + width)])
    df = class_lm._texts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    table = class_lm._neighbours(df, lexicon, end, len(tokens))
    rows = list(class_lm._entries(table.toArrow().to_batches()))
    found = [(int(w), int(o), int(n)) for row in rows for w, o, n in zip(*row, strict=True)]
    assert sorted(found) == sorted((w, o, n) for (w, o), n in wanted.items())
    assert len({w for w, _ in wanted}) == sum(len(set(word.tolist())) for word, _, _ in rows)
    for most in (1, 255, 256, 70_000, 2**40):
        assert class_lm._unpacked(class_lm._packed(np.array([1, most])), 2).tolist() == [1, most]
    m = min(5, lexicon.rare)
    assert class_lm._frequent_bigrams(table, m).tolist() == [[wanted[y, x] for y in range(m)] for x in range(m)]


def _peak(work) -> int:
    """Bytes held at once at most while `work` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counters_hold_few_copies_of_their_keys():
    rng, n = np.random.default_rng(4), 1 << 20
    counter, sizes, total = class_lm._Counter(), [], []

    def count():
        for _ in range(16):
            for keys, counts in counter.add(rng.integers(0, 4 * n, n // 8)):
                sizes.append(len(keys))
                total.append(counts.sum())
        for keys, counts in counter.rest():
            sizes.append(len(keys))
            total.append(counts.sum())

    # 16 bytes for each of two million keys and counts, and as much again while they are put in order.
    assert _peak(count) < 72 * n
    assert sum(total) == 2 * n and max(sizes) <= 1 << 16


@pytest.mark.parametrize("kind", ["<u4", "<i8"])
def test_runs_are_made_a_few_parts_at_a_time(kind):
    rng, span = np.random.default_rng(5), 1000
    keys = np.where(rng.random(1 << 20) < 0.3, rng.integers(7 * span, 8 * span, 1 << 20), rng.integers(0, 2000 * span, 1 << 20))
    wanted = dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True)), strict=True))
    found, parts = {}, []

    def run():
        for batch in class_lm._runs(keys, span, kind):
            for part, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = np.frombuffer(low, kind)
                parts.append(part)
                found.update(zip((low.astype(np.int64) + part * span).tolist(), class_lm._unpacked(n, len(low)).tolist(), strict=True))

    run()
    assert found == wanted and parts == sorted(set(parts))
    assert _peak(lambda: [None for _ in class_lm._runs(keys, span, kind)]) < keys.nbytes * 1.5
    assert list(class_lm._runs(keys[:0], span, kind)) == []


def test_scoring_takes_small_batches_and_no_python_for_its_tables(spark, monkeypatch):
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []

    def materialise(df, step, write=class_lm.materialise):
        sizes.append((step, spark.conf.get(name)))
        return write(df, step)

    monkeypatch.setattr(class_lm, "materialise", materialise)
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, " ".join(WORDS[i % 30 : i % 30 + 9])) for i in range(60)], "doc_id long, text string")
    found = class_lm.scores(docs, class_lm.learn(docs, classes=3, frequent=10, vocabulary=20))
    assert {s for s, _ in sizes} >= {"token-counts", "neighbours", "class-steps", "local-scores"}
    assert {size for _, size in sizes} == {"2m"} and spark.conf.get(name) == before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_exchange_finds_groups():
    rng = np.random.default_rng(2)
    group = np.arange(30) % 3
    rates = np.where(group[:, None] == (group[None, :] + 1) % 3, 50, 1)
    of = class_lm.exchange(rng.poisson(rates).astype(float), 3)
    assert len({(a, b) for a, b in zip(of, group, strict=True)}) == 3
