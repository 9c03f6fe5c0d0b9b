"""Pure-Python parts of the training-data operators against brute force."""
import random
import re

import numpy as np
import pyarrow as pa

from riskfold.llm import decontam, html_text, parity_join, quality, toxicity
from riskfold.llm.common import dual_coordinate_descent, platt


def _hits(text, items, window=13):
    words, hit, ids = decontam.words_of(text), set(), set()
    for i, t in items:
        iw = decontam.words_of((t or "").encode())
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == iw[k:k + n]:
                    hit.update(range(p, p + n))
                    ids.add(i)
    return len(words), hit, ids


def test_fm_index_equals_brute_force():
    rnd = random.Random(3)
    voc = ["a", "b", "C", "d", "é"]
    for _ in range(40):
        items = [(k, " ".join(rnd.choice(voc) for _ in range(rnd.choice([0, 1, 3, 5, 13, 20]))))
                 for k in range(rnd.randint(0, 6))]
        docs = [b""]
        for _ in range(8):
            t = [rnd.choice(voc + ["zz"]) for _ in range(rnd.randint(0, 60))]
            if items and rnd.random() < .7:
                t[3:3] = rnd.choice(items)[1].split()
            docs.append(" ".join(t).encode())
        docs.append(docs[-1])
        win = decontam.windows_of(items)
        for d, (n, spans, ids) in zip(docs, decontam.scan_texts(docs, win, shard=rnd.choice([5, 40, 10 ** 6]))):
            got = set()
            for a, b in decontam.merge_spans(spans):
                got.update(range(a, b))
            assert (n, got, ids) == _hits(d, items)


def test_fm_rank_and_locate():
    text = np.array([2, 3, 2, 3, 2, 1, 3, 2, 0])
    fm = decontam.FMIndex(text, 3, sample=4)
    lo, hi = fm.search(np.array([[2, 3], [3, 2], [3, 3]]))
    assert (hi - lo).tolist() == [2, 3, 0]
    assert sorted(fm.locate(np.arange(lo[1], hi[1])).tolist()) == [1, 3, 6]


def _set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_shingle_sets_and_classes(monkeypatch):
    rnd = random.Random(1)
    docs = [" ".join(rnd.choice("a b C c é".split()) for _ in range(rnd.randint(0, 30))).encode() for _ in range(200)]
    docs += [b" ", b"\n a\t", b"x" * 5000, b""]
    data, off = b"".join(docs), np.cumsum([0] + [len(d) for d in docs])
    seen = None
    for size in (1 << 20, 64, 7):           # pieces of any size give the same hashes
        monkeypatch.setattr(parity_join, "CHUNK_BYTES", size)
        h, ends = parity_join.shingle_sets(data, off)
        assert np.diff(ends).tolist() == [len(_set(d)) for d in docs]
        cls = parity_join.class_hash(h, ends).tolist()
        by = {}
        for d, c in zip(docs, cls):
            by.setdefault(_set(d), set()).add(c)
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(cls))
        assert seen in (None, cls)
        seen = cls


def test_linked_sets_share_a_block_key():
    rng = np.random.default_rng(5)
    for n in (4, 5, 8, 20, 63, 64, 65, 200, 990, 2100):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            room = n // 9                   # what may be missing and what may be new
            b = np.unique(np.concatenate((a[room:], rng.integers(0, 1 << 63, room, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            h, ends = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
            doc, key, slack = parity_join.block_keys(h, ends)
            shared = set(key[doc == 0]) & set(key[doc == 1])
            own = slack[doc == 0].max(initial=-1)
            assert own < 0 or len(shared) > 0
            x, y = parity_join.bit_sketches(h, ends)
            apart = int(parity_join._distances([x], [y])[0, 0])
            assert apart <= len(a) + len(b) - 2 * both


def _path(*keys):
    h = 0
    for k in keys:
        h = html_text._step(h, k)
    return h


def test_page_text():
    text = lambda h, p=None: html_text.Page(h).text(p)[0]
    assert text("") == "" and text("plain &amp; text") == "plain & text"
    page = ('<html><head><title>T</title></head><body><nav><a href="/">menu</a></nav><div class="cookie-notice">x</div>'
            '<article class="post-12"><h1>Head</h1><p>a&nbsp; b<br>c<p><b>d</b> e<script>"</p>"</script></article>'
            '<div id="comments"><p>first!</p></div><footer>f</footer></body></html>')
    assert html_text.Page(page).text() == ("Head\n\na b c\n\nd e", ">body>article.post-0")
    v = html_text.Page(page).votes()
    assert max(v, key=v.get) == _path("body", "article.post-0")
    # a page whose side text is longer follows its host's path
    thin = '<body><div class="x">long side text of this page</div><article class="post-7"><p>hi</p></article></body>'
    assert text(thin, _path("body", "article.post-0")) == "hi"


def test_names_are_evidence_and_not_a_cut():
    paragraphs = [f"Sentence number {i} of this article says something." for i in range(6)]
    page = (f'<body><article><h1>Head</h1><div class="article-body social"><p>{paragraphs[0]}</p></div>'
            f'<section class="related work"><p>{paragraphs[1]}</p></section><p class="notice">{paragraphs[2]}</p>'
            '<div class="share"><a href="/x">tell others</a> <a href="/y">mail</a></div>'
            '<div class="ad">buy this</div><section class="comments"><p>' + "first " * 90 + '</p></section></article>'
            '<div class="notice">we use things</div></body>')
    assert html_text.Page(page).text()[0] == "\n\n".join(["Head", *paragraphs[:3]])
    # the text of a host may stand in an element with an unlucky name
    menu = '<body><div class="menu">' + "".join(f"<p>{p}</p>" for p in paragraphs) + '</div><div class="ad">x</div></body>'
    assert html_text.Page(menu).text()[0] == "\n\n".join(paragraphs)
    links = '<body><div class="menu">' + '<a href="/">a menu entry</a> ' * 40 + f'</div><p>{paragraphs[0]}</p></body>'
    assert html_text.Page(links).text()[0] == paragraphs[0]


def _made_page(rnd):
    """A page from known parts: (html, text of its article)."""
    words = lambda n: " ".join(rnd.choice(["alpha", "b&eacute;ta", "x &lt; y", "g\u00e4mma", "delta"]) for _ in range(n))
    plain = lambda t: " ".join(t.replace("&eacute;", "\u00e9").replace("&lt;", "<").split())
    junk = ['<nav><ul><li><a href="/a">one</a></li><li>two</li></ul></nav>', '<div class="ad">' + words(8) + "</div>",
            '<aside><p>' + words(20) + "</p></aside>", "<!-- <p>gone</p> -->", '<form><p>name</p><input></form>',
            '<div class="cookie-notice"><p>' + words(9) + "</p></div>", "<script>var t='</p>';</script>",
            '<section id="comments"><p>' + words(60) + "</p></section>", '<div class="sidebar"><a href="/">' + words(4) + "</a></div>"]
    blocks, inner = [], []
    for _ in range(rnd.randint(2, 9)):
        t = words(rnd.randint(1, 40))
        kind = rnd.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>",
                           "<p><b>{}</b></p>", "<h2>{}</h2>", "<p>\n {}\t<br> </p>", "<div><div><div>{}</div></div></div>"])
        inner.append(kind.format(t))
        blocks.append(plain(t))
        if rnd.random() < 0.3:
            inner.append(rnd.choice(junk))
    around = [rnd.choice(junk) for _ in range(4)]
    html = ("<!DOCTYPE html><html><head><title>t</title></head><body>" + around[0] + around[1] + "<article>" + "".join(inner)
            + "</article>" + around[2] + "<footer>f</footer>" + around[3] + "</body></html>")
    return html, "\n\n".join(blocks)


def test_made_pages_give_their_article_back():
    rnd = random.Random(6)
    path = _path("body", "article")
    for _ in range(300):
        html, want = _made_page(rnd)
        assert html_text.Page(html).text(path)[0] == want


def test_hostile_pages_take_linear_time():
    import time
    for page in ("<div>x" * 100_000, "<b>x" * 100_000 + "</i>" * 50_000, "<p><b>" * 50_000 + "end",
                 "<div><b>" + "<p>y</i></b>" * 60_000, "<ul><li>" * 50_000, '<div class="ad">z' * 50_000,
                 "<article><span>" * 30_000 + "</span></article>" * 30_000 + "tail", "<a>q</p>" * 60_000):
        t = time.process_time()
        html_text.Page(page).text()
        assert time.process_time() - t < 4


def test_subsequence_kernel_by_hand():
    code = lambda w, pad: toxicity._codes([w], 4, pad)
    lam = 0.5                               # "ab" in "ab": lam^2 * lam^2; "ab" in "axb": lam^2 * lam^3
    k = lambda s, t: toxicity.subsequence_kernel(code(s, "\1"), code(t, "\2"), 2, lam)[0]
    assert np.isclose(k("ab", "ab"), lam ** 4)
    assert np.isclose(k("ab", "axb"), lam ** 5)
    assert k("ab", "cd") == 0


def test_toxicity_tolerates_gaps_and_insertions():
    marks = toxicity.Landmarks(["^idiot"])
    near = {toxicity.normalise([w])[0]: w for w in ("idiot", "id-iot", "1diot", "idxiot")}
    for w in near:
        assert len(marks.values([w])[0]), w
    assert not len(marks.values(["table", "thought", ""])[0])
    assert toxicity.spaced_words("you i d i o t !") == ["idiot"]
    bags = [[{0: 1.0}]] * 5 + [[]] * 5 + [[{0: 0.2}]] * 2
    m = toxicity.train(bags, np.array([1] * 5 + [0] * 7), ["^idiot"])
    got = toxicity.scorer(m)(pa.array(["what an idiot.", None, "", "What an I.D.I.O.T!", "a table"]))
    assert (got[[0, 3]] >= 0.5).all() and (got[[1, 2, 4]] < 0.3).all()


def test_quality_learns_shapes_and_is_stable_over_pieces(monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    good = [" ".join(word() for _ in range(60)).capitalize() + "." for _ in range(60)]
    bad = [" ".join(word() + "!!!" for _ in range(60)).upper() for _ in range(30)] + [
        " ".join([word()] * 60) for _ in range(30)]
    f = [quality.features(t.encode()) for t in good + bad]
    y = np.array([1] * 60 + [-1] * 60)
    model = quality.train(f, y)
    s = quality.score_texts(pa.array(good + bad + ["", None]), model)
    assert ((s[:120] >= 0.5) == (y > 0)).mean() > 0.97 and np.isfinite(s).all()
    monkeypatch.setattr(quality, "_PIECE", 16)
    assert all((quality.features(t.encode()) == x).all() for t, x in zip(good[:5] + bad[:5], f[:5] + f[60:65]))
    assert quality.train([], np.zeros(0))["b"] == 0.0


def test_descent_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.where(x[:, 0] - x[:, 1] > 0, 1, -1)
    w = dual_coordinate_descent([(np.arange(3), v) for v in x], y, 3)
    m = x @ w[:3] + w[3]
    assert ((m > 0) == (y > 0)).mean() > 0.95
    a, b = platt(m, y)
    assert a > 0 and abs(b) < 5


def test_letter_bound_of_landmarks_is_proven():
    rnd = random.Random(11)
    letters = "abcdei"
    marks = toxicity.Landmarks(["^" + "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7))) for _ in range(12)])
    words = ["".join(rnd.choice(letters + "xyz") for _ in range(rnd.randint(1, 12))) for _ in range(400)]
    pieces, _ = toxicity._pieces(words)
    got = {(i, j): v for i, j, v in zip(*marks.compare(pieces))}
    own = toxicity.Landmarks._self(pieces)
    for i, w in enumerate(pieces):
        if len(w) < toxicity.P:
            continue
        for j, m in enumerate(marks.words):
            k = toxicity.subsequence_kernel(toxicity._codes([w], len(w), "\1"), toxicity._codes([m], len(m), "\2"))[0]
            k /= np.sqrt(own[i] * marks.self_k[j])
            if abs(k - toxicity.FLOOR) > 1e-4:
                assert ((i, j) in got) == (k > toxicity.FLOOR)
                assert (i, j) not in got or abs(got[i, j] - k * k) < 1e-4
    assert np.linalg.eigvalsh(marks.gram()).min() > -1e-6


def test_pair_distances_equal_the_matrix():
    rnd = np.random.default_rng(5)
    sizes = [3, 40, 900, 1500, 2600]
    sets = [np.unique(rnd.integers(0, 1 << 60, n).astype(np.uint64)) for n in sizes for _ in range(3)]
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    sk = parity_join.bit_sketches(np.concatenate(sets), ends)
    a, b = sk, sk[4:] + sk[:4]
    want = parity_join._distances(a, b)
    assert parity_join._pair_distances(a, b).tolist() == [int(want[i, i]) for i in range(len(a))]
