"""Small cases for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, rank long"
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(60, 1)
    other = words(60, 2).split()
    near = [" ".join([*other[:k], f"new{k}", *other[k + 1 :]]) for k in (0, 1, 59)]
    texts = [None, "", " \t\n", "Äb", "äb", "one two", "ONE two", "one two", base, base, base.upper(), " ".join(other), *near, words(20000, 3), words(4, 4), "a b c d e", "a b c d e f"]
    found = [(k, t, [None, "en", "de"][k % 3], [None, "s", "t"][k % 3], 1, "x", 2, 3) for k, t in enumerate(texts)]
    return [*found, found[8], (None, "null id", "en", "s", 0, "x", 2, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    from tidemill.llm.exact_dedup import drop_copies, exact_dedup

    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(TABLE), []).append(r[0])
    got = exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    left = drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    from collections import Counter

    from tidemill.llm.exact_dedup import misra_gries

    rng, held, true = random.Random(1), Counter(), Counter()
    for _ in range(50):
        batch = Counter(rng.choice(["hot", *map(str, range(1000))][: 1 if rng.random() < 0.3 else 1001]) for _ in range(100))
        true += batch
        held = misra_gries(held, batch, 10)
        assert len(held) <= 10
    n = sum(true.values())
    assert all(held[k] >= c - n / 11 and held[k] <= c for k, c in true.items() if c > n / 11) and held["hot"]


def test_mixing(docs, rows, empty):
    from tidemill.llm.mixing import mix_copies, mix_sources, mixed

    size = lambda t: len(WORD.findall(t or ""))
    got = mix_copies(docs).collect()
    total = sum(size(r[1]) for r in rows)
    of = {}
    for r in rows:
        of[r[3]] = of.get(r[3], 0) + size(r[1])
    cap, goal = {s: 2 * n for s, n in of.items()}, {}
    weight = dict(zip(sorted(of, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=False))
    left, open_ = 1.5 * total, set(of)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            goal |= share
            break
        goal |= {s: cap[s] for s in over}
        left, open_ = left - sum(cap[s] for s in over), open_ - over
    longest = max(size(r[1]) for r in rows)
    taken = {}
    for r in got:
        assert r.source_size == of[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    assert all(abs(taken[s] - goal[s]) <= longest for s in goal)
    assert sorted(map(str, mix_sources(docs).collect())) == sorted(map(str, mix_sources(docs.repartition(3)).collect()))
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mix_sources(empty).count() == 0 and mixed(empty).count() == 0


def test_hilbert_curve_and_shards(spark, docs, rows, empty):
    from tidemill.llm.sharding import curve_index, shard

    grid = spark.range(512).selectExpr("cast(id % 8 as int) x", "cast(id / 8 as int) % 8 y", "cast(id / 64 as int) z")
    cells = {r.h: (r.x, r.y, r.z) for r in grid.withColumn("h", curve_index(["x", "y", "z"], 3)).collect()}
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(cells[k], cells[k + 1], strict=True)) == 1 for k in range(511))
    got = shard(docs, shards=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    assert [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))] == sorted(r.curve for r in got)
    assert shard(empty).count() == 0


def test_jaccard_join_against_brute_force(docs, rows, empty):
    from tidemill.llm.jaccard_join import jaccard_components, jaccard_links, one_of_each

    def shingles(t):
        w = WORD.findall((t or "").translate(TABLE))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                if x != y:
                    links.add((x, y))
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == {(i, len(s), top(i)) for i, s in sets}
    assert jaccard_links(docs).count() == len({frozenset(p) for p in links})
    assert one_of_each(docs).columns == docs.columns
    assert jaccard_components(empty).count() == 0


def test_tree_bounds_lose_nothing():
    from tidemill.llm.jaccard_join import Forest, Sets, points

    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64)) for _ in range(12)]
    sets = []
    for _ in range(300):
        s = base[rng.integers(12)].copy()
        s[rng.integers(0, len(s), rng.integers(0, 6))] = rng.integers(0, 1 << 62, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    count = np.array([len(s) for s in sets])
    values, cell = np.concatenate(sets), np.sort(rng.integers(0, 3, 300))
    part, label = rng.integers(0, 2, 300), rng.integers(0, 200, 300)
    for two in (False, True):
        t = Forest(points(values, count), count, count, cell, part, label, 80)
        found = {frozenset(p) for x, y in t.pairs(two) for p in zip(x.tolist(), y.tolist(), strict=True)}
        own = Sets(values, count, np.arange(300), 80)
        for a in range(300):
            for b in range(a):
                k = len(np.intersect1d(sets[a], sets[b]))
                link = 100 * k >= 80 * (count[a] + count[b] - k)
                assert own.linked(np.array([a]), np.array([b]))[0] == link
                if cell[a] == cell[b] and label[a] != label[b] and (not two or part[a] != part[b]):
                    assert not link or frozenset((a, b)) in found
                else:
                    assert frozenset((a, b)) not in found


def test_jaccard_join_of_a_hot_passage(spark, monkeypatch):
    from tidemill.llm import jaccard_join
    from tidemill.llm.jaccard_join import jaccard_components, jaccard_links, one_of_each

    monkeypatch.setattr(jaccard_join, "CELL", 16)
    rng = random.Random(8)
    hot = words(40, 99).split()
    texts = [" ".join([*hot, *words(rng.randint(2, 30), 1000 + k).split()]) for k in range(220)]
    texts += [" ".join(hot[:k] + ["x"] + hot[k + 1 :]) for k in range(40)] + [None, ""]
    rows = [(None if k % 50 == 7 else k // 2 if k % 9 == 0 else k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    top, links = list(range(len(sets))), 0
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links += 1
                p, q = top[a], top[b]
                top = [min(p, q) if t in (p, q) else t for t in top]
    name = {t: min((rows[k][0] for k in range(len(top)) if top[k] == t and rows[k][0] is not None), default=None) for t in set(top)}
    want = sorted(((rows[k][0], len(sets[k]), name[top[k]]) for k in range(len(sets))), key=str)
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str) == want
    assert links > 300 and jaccard_links(docs).count() == links
    assert one_of_each(docs).count() == len(set(top))


def test_sentencepiece_equals_the_library(docs, rows, empty):
    import sentencepiece

    from tidemill.llm.pieces import MARK, MODEL, Vocabulary, decoded, encode_column, encoded

    rng = random.Random(3)
    texts = [*[r[1] for r in rows], "  a  b ", "日本語 😀", " " * 37, "x" + " " * 40 + "y", "\n\tq", "ab" * 900, *["".join(rng.choice("aet io\ná") for _ in range(200)) for _ in range(30)]]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode_column(pa.array(texts, pa.string()), Vocabulary.load())[0].to_pylist()
    assert got == [library.encode(t or "") for t in texts]
    out = encoded(docs)
    assert all(r.whole for r in out.collect())
    back = {(r.doc_id, r.text) for r in decoded(out).collect()}
    assert back == {(r[0], (r[1] or "").replace(MARK, " ")) for r in rows}
    assert encoded(empty).count() == 0


def test_toxicity_and_language_learn(spark, empty):
    from tidemill.llm.language_id import identify
    from tidemill.llm.toxicity import drop_toxic, toxicity

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        en = rng.random() < 0.5
        w = [rng.choice(["the", "and", "ther", "tion", "of"] if en else ["der", "und", "schaft", "nicht", "ein"]) for _ in range(rng.randint(20, 90))]
        bad = rng.random() < 0.3
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "vequ" + rng.choice(["a", "ir", "onto"])])
        rows.append((i, " ".join(w), "en" if en else "de"))
        labels.append((i, int(bad)))
    extra = [(9001, None, None), (9002, "", "en"), (9003, "12 34", "de")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(600)) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert all(got[i].predicted == 0 for i in (9001, 9002, 9003))
    assert drop_toxic(docs, marks).columns == docs.columns
    assert toxicity(docs, marks.limit(0)).where("score > 0").count() == 0
    assert toxicity(empty, marks).count() == 0
    lang = {r.doc_id: r for r in identify(docs).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(lang[i].held_out == (i in held) for i in range(600))
    assert np.mean([lang[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (9001, 9002, 9003))
    assert identify(empty).count() == 0


def test_toxic_passages_at_every_offset():
    from tidemill.llm.base import joined_bytes
    from tidemill.llm.toxicity import WINDOW, train, windows

    first, size, n = windows(np.array([300]))
    half = WINDOW // 2 + 1
    assert len(first) == n[0] and all(((first <= at) & (first + size >= at + half)).any() for at in range(300 - half + 1))
    rng = random.Random(5)
    clean = ["the", "and", "ther", "tion", "of", "house", "river", "walk"]
    passage = lambda: [rng.choice(["idiot", "scum", "vequair"]) if k % 8 == 0 else rng.choice(clean) for k in range(half)]
    texts, toxic = [], []
    for i in range(400):
        w = rng.choices(clean, k=rng.randint(20, 90))
        toxic.append(int(i % 3 == 0))
        at = rng.randrange(len(w))
        texts.append(" ".join([*w[:at], *(passage() if toxic[-1] else []), *w[at:]]))
    net = train(texts, toxic)
    around, own = rng.choices(clean, k=300), passage()
    long = [" ".join(around), *[" ".join([*around[:at], *own, *around[at:]]) for at in range(301)]]
    score = net.scores(*joined_bytes(pa.array(long)))
    assert score[0] < 0.5 and (score[1:] >= 0.5).mean() == 1


def test_personal_data(spark, empty):
    from tidemill.llm.pii import base_spans, digest, personal_data, sanitise

    text = "é a.b@x.co 1.2.3.4 999.1.1.1, 4111 1111 1111 1111 +1 (555) 123-4567 x@y 1.2.3.4.5.6.7.8"
    kinds = [(text[a:b], k) for a, b, k, _ in base_spans(text)]
    assert kinds == [("a.b@x.co", 0), ("1.2.3.4", 1), ("4111 1111 1111 1111", 2), ("+1 (555) 123-4567", 3), ("1.2.3.4", 1), ("5.6.7.8", 1)]
    told = [(k, f"{w} zanzibarist writes from kate@mail.org about {w}") for k, w in enumerate(["apples", "pears", "plums", "figs"])]
    plain = [(100 + k, f"people write about {w} and more") for k, w in enumerate(["tea", "cake", "rain", "snow"] * 5)]
    docs = spark.createDataFrame([*told, *plain, (200, None), (201, ""), (202, text), (202, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert got[202].base_sha256 == digest(base_spans(text)) and (got[202].n_email, got[202].n_ip, got[202].n_card, got[202].n_phone) == (1, 3, 1, 1)
    assert all(got[k].n_term >= 1 and "email:" in got[k].spans for k in range(4)) and all(got[100 + k].n_term == 0 for k in range(20))
    assert got[200].base_sha256 == hashlib.sha256(b"").hexdigest() and got[200].spans == ""
    clean = {r.doc_id: r.text for r in sanitise(docs.where("doc_id < 100")).collect()}
    assert "kate" not in clean[0] and "zanzibarist" not in clean[0] and "apples" in clean[0]
    assert personal_data(empty).count() == 0


def test_personal_data_in_one_and_two_texts(spark):
    from tidemill.llm.pii import personal_data

    rows = [(0, "mail ann@x.org or Xanthippe, the reader, at bob@x.org"), (1, "quagmire of kate@mail.org, the writer"), (2, "the quagmire: kate@mail.org, a reader")]
    docs = spark.createDataFrame([*rows, *[(10 + k, f"the reader and the writer mail note {k} {'abcdefghij'[k % 10] * 4}{'klmnopqrst'[k // 10] * 4}") for k in range(60)]], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    told = {k: [t[int(a) : int(b)] for x in got[k].spans.split(",") for kind, a, b in [x.split(":")] if kind == "term"] for k, t in rows}
    assert told == {0: ["Xanthippe"], 1: ["quagmire"], 2: ["quagmire"]}
    assert [got[k].n_term for k in (0, 1, 2)] == [1, 1, 1] and all(got[10 + k].spans == "" for k in range(60))


def test_personal_data_with_copies_against_brute_force(spark):
    from tidemill.llm.pii import DISCLOSURE, PRIOR, base_spans, personal_data, terms

    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = [None, "", "İstanbul for zed@x.org"]
    for k in range(150):
        w = rng.sample(pool, 6) + ["THE"] * (k % 2)
        if k % 3 == 0:
            n = int(rng.paretovariate(0.5)) % 9
            w += [f"user{n}@x.org", f"Name{'abcdefghi'[n] * 3}"] + ["10.0.0.7", "gateway"] * (k % 4 == 0)
        texts.append(" ".join(rng.sample(w, len(w))))
    rows = texts + [texts[3]] * 700 + [texts[4]] * 300 + texts[6:20] * 3 + [None, ""]
    distinct = {t or "" for t in rows}
    of, holds = {}, {}
    for t in distinct:
        own = base_spans(t)
        for e in {(k, v) for _, _, k, v in own}:
            of.setdefault(e, set()).add(t)
        for w in re.findall(r"[^\W\d_]{3,}", t):
            holds.setdefault(w.lower(), set()).add(t)

    def want(t):
        own, found = base_spans(t), []
        for w, a, b in terms(t, own):
            for e in {(k, v) for _, _, k, v in own}:
                both = sum(w in {x for x, *_ in terms(u, base_spans(u))} for u in of[e])
                if both / (len(holds[w]) + PRIOR) >= min((len(of[e]) / len(distinct)) ** (1 - DISCLOSURE), len(of[e]) / (len(of[e]) + PRIOR)):
                    found.append(f"term:{a}:{b}")
                    break
        return found

    expected = {t: want(t) for t in distinct}
    assert expected[texts[3]] and sum(map(bool, expected.values())) > 20
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(7)
    got = personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [x for x in r.spans.split(",") if x.startswith("term")] == expected[rows[r.doc_id] or ""]


def test_html(spark):
    from tidemill.llm.html_extract import extract

    def page(k):
        return f"<html><head><title>t</title></head><body><div id=menu><ul><li>Home<li>News</ul></div><main><h1>T&eacute; {k}</h1><p class=x>Read this site daily.</p><p>Body  {k}<br>\nmore &amp; <b>bold</b><p>End {k}<!-- no --><script>var a='</p>';</script></main><section class='comments'>bad</section><footer>&copy; x</footer>"

    rows = [(k, "http://a.example/x", page(k)) for k in range(8)] + [(50, None, None), (51, "b", "plain <i>te</i>xt"), (52, "http://c/", "<nav>n</nav><form>f</form>")]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Té 3\n\nBody 3 more & bold\n\nEnd 3" and got[3].n_chars == len(got[3].text)
    assert (got[50].text, got[51].text, got[52].text) == ("", "plain text", "")
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_with_odd_pages(spark):
    from tidemill.llm.html_extract import extract

    def page(k, *around):
        return "".join(f"<div>{x}</div>" for x in (*around[:1], f"Story {k} tells of {words(12, k)}", *around[1:]))

    rows = [("odd", page(k, "Welcome to our site", "All rights kept")) for k in range(12)]
    rows += [("odd", None), ("odd", ""), ("odd", "<table><tr><td>quite another layout</table>")]
    rows += [("two", page(20 + k, "Read more here", "Buy now")) for k in range(2)]
    rows += [("three", page(30 + k, "First layout")) for k in range(6)] + [("three", f"<section>{page(40 + k, 'Second layout')}</section>") for k in range(6)]
    text = [f"<p>{words(15, 60 + k)}</p>" for k in range(4)]
    rows += [("near", "".join(text)), ("near", "".join([*text[:3], "<p>changed end</p>"])), ("near", page(50))]
    rows += [("copies", page(70, "Only once"))] * 4
    docs = spark.createDataFrame([(k, f"http://{h}/", x) for k, (h, x) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(docs).collect()}
    story = lambda k: f"Story {k} tells of {words(12, k)}"
    assert [got[k] for k in range(15)] == [*map(story, range(12)), "", "", "quite another layout"]
    assert [got[k] for k in (15, 16)] == [story(20), story(21)]
    assert [got[k] for k in range(17, 29)] == [*map(story, range(30, 36)), *map(story, range(40, 46))]
    assert got[29].count("\n\n") == got[30].count("\n\n") == 3 and got[31] == story(50)
    assert all(got[k] == f"Only once\n\n{story(70)}" for k in range(32, 36))


def test_nearest_neighbours_recall_and_odd_vectors(spark):
    from tidemill.llm.ann import neighbours

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    vectors[700:760] = vectors[3]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0])]
    got = {}
    for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        assert [x[0] for x in sorted(found)] == list(range(1, 21)) and q not in {x[1] for x in found}
        score = vectors.astype(float) @ vectors[q].astype(float)
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        hit += len(set(best.tolist()) & {x[1] for x in found})
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
    assert hit / (20 * len(got)) >= 0.9
    # Doubles stay doubles, and each row of a repeated id is ranked by itself, the other one being a candidate.
    exact = rng.normal(size=(300, 8))
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(exact)] + [(0, exact[7].tolist(), "x", 1), (None, exact[3].tolist(), "x", 1)]
    found = {}
    for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int"), 100, 20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: len(x) for q, x in found.items()} == {0: 40, 100: 20, 200: 20}
    every = np.concatenate([exact, exact[7:8]])
    ids = np.concatenate([np.arange(300), [0]])
    for own, q in ((0, 0), (300, 0), (100, 100)):
        score = every @ every[own]
        score[own] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        want = [(k + 1, int(ids[b]), score[b]) for k, b in enumerate(best)]
        assert sum(any(a[:2] == w[:2] and abs(a[2] - w[2]) < 1e-14 for a in found[q]) for w in want) >= 18
    assert neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_sample_is_bounded(spark, empty):
    from tidemill.llm.language_id import sample

    found = [(k, f"text {k}", "en", "s", 1, "x", 2, 3) for k in range(400)]
    docs = spark.createDataFrame([*found, *found[:1] * 900], SCHEMA)
    learned = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 != 1]
    few, langs = sample(docs, 20)
    every, _ = sample(docs, 1000)
    assert len(few) == len(langs) == 20 and few == every[:20]
    assert sorted(every) == sorted(f"text {k}" for k in learned) and sample(empty) == ([], [])


def test_rare_and_long_languages_are_learned(spark):
    from tidemill.llm.language_id import identify, sample

    rng = random.Random(6)
    of = {"en": ["the", "and", "ther", "tion"], "fi": ["hyvää", "yö", "kissa", "talo"], "pl": ["wszy", "jest", "czło", "dzię"]}
    text = lambda x, n: " ".join(rng.choices(of[x], k=n))
    rows = [(k, text("en", 30), "en") for k in range(900)] + [(1000 + k, text("fi", 30), "fi") for k in range(12)] + [(2000 + k, text("pl", 6000), "pl") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = sample(docs, 10)
    assert langs.count("en") == 10 and 3 <= langs.count("fi") <= 10 and 3 <= langs.count("pl") <= 10
    assert set(langs[: len(langs) * 4 // 5]) == {"en", "fi", "pl"} and max(len(t.encode()) for t in texts) <= 20_000
    got = [(r.doc_id, r.lang_pred) for r in identify(docs).collect()]
    want = {r[0]: r[2] for r in rows}
    assert np.mean([want[i] == x for i, x in got if i >= 1000]) > 0.9


def test_mix_with_repeated_and_null_ids(spark):
    from tidemill.llm.mixing import mix_copies, mixed

    found = [(k // 3 if k % 5 else None, words(3 + k, k), None, ["s", "t", None][k % 3], 1, "x", 2, 3) for k in range(60)]
    docs = spark.createDataFrame(found, SCHEMA)
    want = {}
    for r in mix_copies(docs).collect():
        want[r.doc_id, r.source, r["size"]] = r.copies
    got = {}
    for r in mixed(docs).collect():
        key = r.doc_id, r.source, len(WORD.findall(r.text))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
