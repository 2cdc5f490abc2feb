"""Parts of the operators against plain versions of them, and on inputs that would take long if time weren't proportional to length."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

NAIVE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def naive_spans(text):
    from tidemill.llm.pii import luhn

    digits = lambda x: re.sub("[^0-9]", "", x)
    good = [
        lambda x: True,
        lambda x: all(int(p) <= 255 for p in x.split(".")),
        lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x)),
        lambda x: 9 <= len(digits(x)) <= 15,
    ]
    found = [(m.start(), m.end(), k) for k, pattern in enumerate(NAIVE) for m in pattern.finditer(text) if good[k](m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@+-() 5_%é", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    from tidemill.llm.pii import base_spans

    assert [s[:3] for s in base_spans(text)] == naive_spans(text)


def test_base_spans_of_likely_texts():
    from tidemill.llm.pii import base_spans

    rng = random.Random(2)
    bits = ["a.b@x.co", "q@", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "x", " ", ".", "-", "é", "007.2.3.4.5.6.7.8"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=8))
        assert [s[:3] for s in base_spans(text)] == naive_spans(text)


@pytest.mark.parametrize("text", ["1" * 1_000_000 + " 1.2.3.4", "a" * 1_000_000 + "@b", "@a." * 300_000, "1." * 500_000, "+1" + " " * 1_000_000, "1 " * 500_000, "a@" * 500_000])
def test_long_runs_are_scanned_once(text):
    from tidemill.llm.pii import base_spans, terms

    began = time.time()
    terms(text, base_spans(text))
    assert time.time() - began < 10


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 200_000, "<x>" * 100_000 + "<h1>a" * 50_000, "<!x" * 300_000, "<p " + "a" * 1_000_000 + ">x", '<a b="' * 100_000, "<p a=" + "'x " * 100_000 + ">t", "<li><ul>" + "<x>" * 1000 + "<li>a</li>" * 50_000, "</p>" * 200_000])
def test_long_pages_are_read_once(page):
    from tidemill.llm.html_extract import Template, main_text

    began = time.time()
    main_text(page, Template())
    assert time.time() - began < 15


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="has-sidebar"><p>real text</p>', "real text"),
        ('<body class="no-comments"><article><p>x</article>', "x"),
        ('<div class="post-header"><h1>T</h1></div><p>x</p>', "T\n\nx"),
        ("<p class=it's>one</p><p>two don't</p><p>three</p>", "one\n\ntwo don't\n\nthree"),
        ("a < b <i>c</i> d <b and more", "a < b c d <b and more"),
        ('<p title="x>y</p>z', "y\n\nz"),
        ("<div class='comments'>c</div><p>t<div class='site-header'>h</div><div class='sidebar widget'>s</div><aside>a</aside>", "t"),
        ("<article>a<div class='user-comments'>c</div></article><p>b", "a"),
        (None, ""),
        ("<p>&amp;&nbsp; &lt;b&gt;</p>", "& <b>"),
    ],
)
def test_what_the_markup_decides(page, text):
    from tidemill.llm.html_extract import Template, main_text

    assert main_text(page, Template()) == text


def test_template_alone_finds_the_article(spark):
    from tidemill.llm.html_extract import Template, extract, main_text, named, templates
    from tidemill.llm.base import placed

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    stock = [" ".join(word() for _ in range(4)) for _ in range(6)]
    story = [" ".join(word() for _ in range(60)) for _ in range(40)]

    def page(k):
        # No <article>, no telling name: a menu and a notice from a small stock, an optional part, a fixed end.
        menu = "".join(f"<div><span>{rng.choice(stock)}</span></div>" for _ in range(3))
        notice = f"<section><p>{rng.choice(stock)}</p></section>" if k % 3 else ""
        return f"<html><body><div id=a1>{menu}</div>{notice}<div id=b2><h2>Title {k} {word()}</h2><p>{story[k]}</p><p>more {story[k][::-1]}</p></div><div id=c3>All rights kept</div></body></html>"

    html = [page(k) for k in range(40)]
    rows = [(k, "http://h.example/", x, "clash", 1) for k, x in enumerate([*html, *html[:6]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    want = [re.sub(r".*<h2>(.*)</h2><p>(.*)</p><p>(.*)</p></div><div id=c3>.*", "\\1\n\n\\2\n\n\\3", x) for x in html]
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert [got[k] for k in range(46)] == want + want[:6]
    assert all(main_text(x, Template()) != w for x, w in zip(html, want, strict=True))
    known = templates(named(placed(pages.select("page_id", "url", "html")))).collect()
    one = Template(dict(zip(known[0].tokens, known[0].classes, strict=True)), [], known[0].article, known[0].dropped)
    assert len(known) == 1 and [main_text(x, one, markup=False) for x in html] == want


def test_network_against_a_plain_pass_and_numeric_gradients():
    from tidemill.llm.base import joined_bytes
    from tidemill.llm.toxicity import HIDDEN, LOWER, Net, gradients, vocabulary, windows

    net = Net.fresh(3)
    texts = ["one two Three four", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "only", "12 !"]
    data, starts = joined_bytes(pa.array(texts))
    data = LOWER[data]
    word, number, bucket, grams, count = vocabulary(data)
    x = net.inputs(bucket, grams, count)
    first, size, n = windows(np.diff(np.searchsorted(word, starts)))
    sig = lambda z: 1 / (1 + np.exp(-z))

    def plain(rows):
        states = np.zeros((len(rows), 2 * HIDDEN))
        for d in (0, 1):
            h = np.zeros(HIDDEN)
            for t in range(len(rows)) if d == 0 else range(len(rows) - 1, -1, -1):
                i, r = rows[t] @ net.p["wx"][d] + net.p["b"][d], h @ net.p["wh"][d]
                reset, update = sig(i[:HIDDEN] + r[:HIDDEN]), sig(i[HIDDEN : 2 * HIDDEN] + r[HIDDEN : 2 * HIDDEN])
                new = np.tanh(i[2 * HIDDEN :] + reset * r[2 * HIDDEN :])
                h = update * h + (1 - update) * new
                states[t, d * HIDDEN : (d + 1) * HIDDEN] = h
        a = np.exp(states @ net.p["v"])
        return (a / a.sum()) @ states @ net.p["u"] + net.p["c"][0]

    want = [plain(x[number[f : f + s]].astype(float)) for f, s in zip(first, size, strict=True)]
    assert np.allclose(net.logits(x, number, first, size), want, atol=1e-4)
    worst = np.split(np.array(want), np.cumsum(n)[:-1])
    assert np.allclose(net.documents(*joined_bytes(pa.array(texts))), [max(w, default=-np.inf) for w in worst], atol=1e-4)

    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(6, x.shape[1])), np.zeros((1, x.shape[1]))])
    index = np.array([[0, 1, 2, 3], [4, 5, 6, 6]])
    real, y = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float), np.array([1.0, 0.0])

    def loss():
        logit = net.pooled(net.states(net.project(x), index, real), real)[0]
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    found, dx = gradients(net, x, index, real, y)
    for name, array, grad in [*((k, net.p[k], g) for k, g in found.items()), ("x", x[:-1], dx[:-1])]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in array.shape)
            kept, step = array[at], 1e-3
            array[at] = kept + step
            up = loss()
            array[at] = kept - step
            slope = (up - loss()) / (2 * step)
            array[at] = kept
            assert abs(slope - grad[at]) < 2e-3 + 0.02 * abs(slope), name


def test_toxicity_sample_is_bounded_and_columns_may_clash(spark):
    from tidemill.llm.toxicity import drop_toxic, sample, toxicity

    rows = [(k % 50, f"text {k}", 0.5, "x", 1) for k in range(500)] + [(None, "no id", 0.5, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string, toxic int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    texts, toxic = sample(docs, labels)
    learned = [k for k in range(50) if __import__("zlib").crc32(str(k).encode()) % 5]
    assert len(texts) == len(learned) and sum(toxic) == sum(k % 2 or k == 4 for k in learned)
    assert toxicity(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"] and drop_toxic(docs, labels).columns == docs.columns


def test_language_scores_against_a_plain_pass(spark):
    from tidemill.llm.base import WHITE, joined_bytes
    from tidemill.llm.language_id import BUCKETS_LOG2, identify, train

    texts = [f"the cat and {k} dogs walk" for k in range(30)] + [f"der hund und {k} katzen gehen" for k in range(30)]
    model = train(texts, ["en"] * 30 + ["de"] * 30)

    def plain(text):
        d = b"\n" + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + b"\n"
        d = bytes(32 if WHITE[c] else c for c in d) + b"    "
        total, n = np.zeros(2), 0
        for i in range(len(d) - 5):
            three = int.from_bytes(d[i : i + 3], "little")
            four = int.from_bytes(d[i : i + 4], "little")
            if d[i + 1] != 32:
                total += model.table[(((three + 0x51ED270B) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BUCKETS_LOG2)]
                n += 1
                if d[i + 2] != 32:
                    total += model.table[((four ^ (four >> 15)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - BUCKETS_LOG2)]
                    n += 1
        return total / max(n, 1) + model.bias

    some = ["The DOG", "katzen  gehen é", "x", "", "a" * 50]
    assert np.allclose(model.logits(*joined_bytes(pa.array(some))), [plain(t) for t in some], atol=1e-3)
    rows = [(k, t, ["en", "de"][k >= 30], "clash", 0.1) for k, t in enumerate(texts)] + [(99, "the dog " * 40_000, None, "clash", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert got[99] == "en" and len(got) == 61


def test_shards_equal_their_sql(spark, tmp_path):
    import duckdb

    from tidemill.llm.catalog import op8_sql
    from tidemill.llm.sharding import shard

    rng = random.Random(4)
    rows = [(None if k == 5 else k // 2, rng.choice([None, "", "é" * 40, "same", "w " * rng.randint(1, 2000)]), rng.choice([None, "en", "de", "fr"]), rng.choice([None, "s", "t", "u", "v"]), "clash", 3) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, law string, size int")
    docs.write.parquet(f"{tmp_path}/documents")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = db.execute(op8_sql())
    names = [c[0] for c in want.description]
    got = [tuple(r) for r in shard(docs).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall())) and len(got) == 300


def test_personal_data_with_clashing_columns_and_long_texts(spark):
    from tidemill.llm.pii import personal_data, sanitise

    rows = [(1, "mail a@x.org " * 30_000, "c", 1), (None, "b@y.org", "c", 1), (2, None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, copy int")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert got[1].n_email == 30_000 and got[None].n_email == 1 and got[2].spans == ""
    assert sanitise(docs.where("doc_id = 2")).columns == docs.columns
