"""Language-model scoring and HTML extraction against brute force."""

import html as entities
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF01
from tests.llm.fixtures import documents, write
from tidewright.llm import html, pst
from tidewright.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), ""]


def out_of(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


@pytest.fixture(scope="module", params=["sf", "awkward", "empty"])
def sf(request, tmp_path_factory):
    if request.param == "sf":
        return SF01
    folder = tmp_path_factory.mktemp(request.param)
    return write(folder) if request.param == "awkward" else write(folder, [], [])


def test_base_scores(spark, sf):
    docs = documents(sf)
    c = Counter(w for d, t in docs if not out_of(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    expect = Counter((d, out_of(d), len(w := toks(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for d, t in docs)
    got = [tuple(r) for r in pst.op9_lm_scoring(spark, sf).collect()]
    assert Counter((*r[:5], round(r[5], 5)) for r in got) == expect
    if sf == SF01:
        assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def brute_model(texts, p_head, depth, least=3):
    """Probability of a word after the words before it, from dictionaries alone."""
    docs = [toks(t) for t in texts]
    c = Counter(w for d in docs for w in d)
    n, v = sum(c.values()), len(c)
    q = lambda w: (c[w] + 1) / (n + v + 1)
    head = max(p_head * n, least)
    alphabet = {w for w in c if c[w] >= p_head * n} | {""}
    after = [None, *(Counter() for _ in range(depth))]  # (context, next word) by the context's length
    for d in docs:
        line = ["", *d]
        for i in range(1, len(line)):
            for k in range(1, depth + 1):
                if i - k >= 0:
                    after[k][tuple(line[i - k : i]), line[i]] += 1
    sums = [None, *(Counter() for _ in range(depth))]
    for k in range(1, depth + 1):
        for (x, _), m in after[k].items():
            sums[k][x] += m
    kept: dict = {}

    def p(x, w):
        for k in range(min(len(x), depth), 0, -1):
            if x[-k:] in kept:
                own, rest = kept[x[-k:]]
                return own[w] if w in own else rest * p(x[-k + 1 :] if k > 1 else (), w)
        return q(w)

    price = 0.5 * math.log(max(n, 2))
    grown = {(w,) for w in c}
    for k in range(1, depth + 1):
        listed: dict = {}
        for (x, w), m in after[k].items():
            if x in grown and m >= (least if k == 1 else head) and (k == 1 or (w in alphabet and set(x) <= alphabet)):
                listed.setdefault(x, {})[w] = m
        new = {}
        for x, own in listed.items():
            s = sums[k][x]
            low = {w: p(x[1:], w) for w in own}
            r, rq = 1 - sum(own.values()) / s, max(1 - sum(low.values()), 1e-12)
            kl = sum(m / s * math.log(m / s / low[w]) for w, m in own.items()) + (r * math.log(r / rq) if r > 1e-15 else 0)
            if s * kl >= price * (len(own) + 1):
                new[x] = ({w: (m - 0.5) / s for w, m in own.items()}, max(1 - sum((m - 0.5) / s for m in own.values()), 1e-12) / rq)
        kept |= new
        often = {(*x, w) for (x, w), m in after[k].items() if x in grown and m >= head and set((*x, w)) <= alphabet and w != ""}
        grown = {x for x in often if x[1:] in (grown if k > 1 else {(w,) for w in alphabet})}
    return p, kept, c


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(300):
        w, state = [], "a"
        for _ in range(40):
            likely = {"a": "b", "b": "c" if w[-2:-1] == ["a"] else "a", "c": "a"}[state]
            state = likely if rng.random() < 0.8 else rng.choice(list("abc"))
            w.append(str(state) if rng.random() > 0.1 else f"r{rng.integers(60)} s{rng.integers(3)}")
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("p_head, depth", [(0.01, 3), (0.001, 3), (0.003, 2), (0.5, 1)])
def test_scores_are_those_of_the_brute_model(spark, walks, p_head, depth):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(walks)], "doc_id long, text string")
    new = [*walks[:5], "a b unknown c r1 s1 a", "", "r5 s0 r5 s0 a b c a b c", None]
    more = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    got = {r["_id"]: r for r in pst.score(more, pst.learn(docs, p_head=p_head, depth=depth, min_count=3)).collect()}
    p, kept, c = brute_model(walks, p_head, depth)
    assert any(len(x) == 1 and x[0].startswith("r") for x in kept) or p_head == 0.5
    assert depth == 1 or any(len(x) == 2 for x in kept)
    for i, t in enumerate(new):
        line = ["", *toks(t)]
        expect = sum(math.log10(p(tuple(line[max(0, k - depth) : k]), line[k])) for k in range(1, len(line)))
        assert abs(got[i].score - expect) < 1e-6 and got[i].n_known == sum(c[w] > 0 for w in line[1:])
    for x in [("a",), ("r1",), ("a", "b"), ("s0", "c"), ("",), ("zz",)]:
        assert abs(sum(p(x, w) for w in c) + p(x, "unseen") - 1) < 1e-9


def test_keys_are_those_of_the_expression(spark):
    x = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 200)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x[::2], x[1::2])], "a long, s long")
    got = df.selectExpr("xxhash64(a, s)", "xxhash64(a)").collect()
    assert [r[0] for r in got] == pst._pairs(x[::2].copy(), x[1::2].copy()).tolist() and [r[1] for r in got] == pst._mix(x[::2].copy()).view(np.int64).tolist()
    assert (pst._unpacked(pst._packed(x)) == x).all()


def test_contexts_grow_with_the_input(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    some, whole = (pst.learn(d, p_head=1e-3, min_count=3).fixes.where("known = 0").count() for d in (docs.where("doc_id % 4 = 0"), docs))
    assert whole > 2 * some > 0


def shuffled(spark, body):
    """Bytes of shuffle that body's stages write."""
    sc = spark.sparkContext
    none = (sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, *none)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    body()
    return sum(n for k, n in stages().items() if k not in before)


def test_keys_and_pairs_travel_packed(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").repartition(4, "doc_id")
    run = lambda df: shuffled(spark, lambda: df.write.format("noop").mode("overwrite").save())
    key = "spark.sql.autoBroadcastJoinThreshold"  # tables that grow are not broadcast
    spark.conf.set(key, "-1")
    try:
        model = pst.learn(docs, p_head=1e-3, min_count=3)
        tree = model.tree
        encoded = materialize(pst.encode(docs, model.words, "doc_id", "text"), "pst-encoded")
        every = np.full(1 << 13, 255, np.uint8)  # a filter that lets every rare word pass
        pairs = run(pst._count_pairs(encoded, spark.sparkContext.broadcast(tree), every, tree.total, 3))
        scores = run(pst.score(docs, model))
    finally:
        spark.conf.unset(key)
    # Bytes a token: 11.2 and 18.2 when pairs had both words as names and each key was a row; 8.4 and 10.2 now.
    assert pairs < 10 * tree.total and scores < 14 * tree.total, (pairs / tree.total, scores / tree.total)


@pytest.mark.parametrize("held_keys, held_texts", [(50, 1000), (1 << 30, 7)])
def test_chunks_and_buckets_change_no_score(spark, walks, monkeypatch, held_keys, held_texts):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(walks)], "doc_id string, text string")
    more = docs.union(spark.createDataFrame([(None, "a b unknown c r1 s1 a"), ("", None), ("d0", "r5 s0 r5 s0 r5")], docs.schema)).repartition(2)
    scores = lambda: sorted((r["_id"] or "", r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in pst.score(more, pst.learn(docs, p_head=0.01, min_count=3)).collect())
    expect = scores()
    monkeypatch.setattr(pst, "HELD_KEYS", held_keys)
    monkeypatch.setattr(pst, "HELD_TEXTS", held_texts)
    monkeypatch.setattr(pst, "BUCKET_TOKENS", 200)
    assert scores() == expect and len(expect) == 303


def test_packed_longs_come_back():
    rng = np.random.default_rng(6)
    x = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 500))
    assert (np.cumsum(pst._loose(pst._tight(pst._steps(x)), len(x))) == x).all()
    a, s = rng.integers(-5, 5, 400), rng.integers(-5, 5, 400)
    keys = pst._keys(a, s, 5)
    assert all(k == x * 5 + y if x >= 0 and y >= 0 else k == h for k, x, y, h in zip(keys, a, s, pst._pairs(a, s)))
    order, parts = pst._dealt(keys, 8)
    slots = pst._slots(keys).view(np.uint64) >> np.uint64(24)
    assert sorted(order) == list(range(400)) and [b for b, _, _ in parts] == sorted({int(v) % 8 for v in slots})
    for b, i, j in parts:
        assert {int(v) % 8 for v in slots[order[i:j]]} == {b} and (np.diff(keys[order[i:j]]) >= 0).all()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">one</a><li><a href=/b>two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site for all sorts of purposes and you agree</div>
<article><header>By line</header><h1>Title &amp; more</h1><p>First&nbsp;<b>bold
text<p>Second <a href="x">link</a> text &lt;here&gt; a < b.</p><ul><li>Item one</li><li>Item two</li></ul>
<script>bad()</script><form>Subscribe <input></form><p>Be.</p>
<section class="comments"><p>A reader says that this is a really long comment with many words in it</p></section></article>
<aside><p>Side text</p></aside><!-- <p>hidden</p> --><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_page():
    tree = html.grow(html.LABELLED[:, :-1], html.LABELLED[:, -1])
    assert html.main_text(PAGE, tree) == "Title & more\n\nFirst bold text\n\nSecond link text <here> a < b.\n\nItem one\n\nItem two\n\nBe."
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<nav>x", tree) == ""
    plain = "<body><div class=menu><a href=x>a</a></div><div>" + "word " * 80 + "<p>" + "more " * 50 + "</div><div id='footer'>c</div>"
    assert html.main_text(plain, tree) == ("word " * 80).strip() + "\n\n" + ("more " * 50).strip()
    assert html.blocks("<div>" * 5000 + "x" + "<p>" * 5000)[0].text == "x"
    assert html.main_text("<article><p>" + "long " * 200_000 + "</article>", tree) == ("long " * 200_000).strip()


def test_tree_learns_its_table():
    tree = html.grow(html.LABELLED[:, :-1], html.LABELLED[:, -1])
    assert all(html.decide(tree, r[:-1].tolist()) == bool(r[-1]) for r in html.LABELLED)


def test_place_decides_inside_an_article():
    tree = html.grow(html.LABELLED[:, :-1], html.LABELLED[:, -1])
    rng = np.random.default_rng(2)
    for _ in range(3000):
        rest = [float(rng.choice([0, 1, 2, 5, 9, 20, 60, 300])) if i % 2 == 0 else float(rng.choice([0, 0.1, 0.5, 1])) for i in range(6)]
        heading = float(rng.integers(2))
        assert html.decide(tree, [1, 0, heading, *rest]) and not html.decide(tree, [1, 1, heading, *rest]) and not html.decide(tree, [0, 1, heading, *rest])


LONG = "word " * 60


@pytest.mark.parametrize(
    "page, expect",
    [
        (f"<article><p>{LONG}{LONG}</p><p>closing paragraph</p></article>", (LONG * 2).strip() + "\n\nclosing paragraph"),
        (f'<div class="wrapper with-sidebar"><main><p>{LONG}</p></main></div>', LONG.strip()),
        (f'<article><p>{LONG}</p><p class="share-price">It rose by ten</p></article>', LONG.strip() + "\n\nIt rose by ten"),
        (f'<article id="article-comments-policy"><p>{LONG}</p></article>', LONG.strip()),
        (f'<div class="layout-sidebar-right has-sidebar"><p>{LONG}</p></div>', LONG.strip()),
        (f'<div class="sidebar"><article><p>{LONG}</p></article></div>', LONG.strip()),
        (f'<article><p>{LONG}</p></article><div id="comments"><article class="comment"><p>{LONG} not this</p></article></div>', LONG.strip()),
        (f'<main><p>{LONG}</p><article class="comment"><p>not this</p></article></main>', LONG.strip()),
        (f"<aside><article><p>{LONG}</p></article></aside>", ""),
    ],
)
def test_names_of_elements(page, expect):
    assert html.main_text(page, html.grow(html.LABELLED[:, :-1], html.LABELLED[:, -1])) == expect


def test_no_pages(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string()), "__text": pa.array([], pa.string())}), tmp_path / "pages.parquet")
    assert html.op10_html(spark, str(tmp_path)).collect() == []


def test_pages(spark):
    got = {r.page_id: r for r in html.op10_html(spark, SF01).collect()}
    pages = pq.read_table(f"{SF01}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [entities.unescape(re.sub("<[^>]*>", " ", x)) for x in re.split("</?(?:p|h1)>", body)]
        text = "\n\n".join(x for x in (" ".join(x.split()) for x in parts) if x)
        r = got[p["page_id"]]
        assert (r.url, r.text, r.n_chars) == (p["url"], text, len(text))


def test_pages_with_nulls(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array([1, None, 3, 3], pa.int64()), "url": pa.array([None, "u", "v", "v"]), "html": pa.array([None, "", "<article><p>x", "<article><p>x"]), "text": [1, 2, 3, 4]}), tmp_path / "pages.parquet")
    got = Counter(tuple(r) for r in html.op10_html(spark, str(tmp_path)).collect())
    assert got == Counter({(1, None, "", 0): 1, (None, "u", "", 0): 1, (3, "v", "x", 1): 2})
