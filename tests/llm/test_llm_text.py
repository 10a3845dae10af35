"""The text operators: plain versions, round trips, held-out accuracy and odd inputs."""

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import boilerplate, ctph, forest, langid, licenses, packing, queries, shingles, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words_of(n, seed=0, prefix="w"):
    rng = np.random.default_rng(seed)
    return [f"{prefix}{x}" for x in rng.integers(0, 1 << 40, n)]


# --- near duplicates


def plain_components(rows, k=5, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, n, seed):
    rng, out = np.random.default_rng(seed), list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{seed}x{at}"
    return " ".join(out)


def test_near_duplicates_equal_all_pairs(spark):
    base, other = words_of(120, 1), words_of(300, 2)
    rows = [(1000 + i, edited(base, 1 + i % 3, i)) for i in range(60)] + [(2000 + i, edited(other, i % 12, i)) for i in range(40)]
    rows += [(i, " ".join(words_of(50 + i, 10 + i))) for i in range(30)] + [(500, "A b c"), (501, "a  B\nc"), (502, "a b"), (503, ""), (504, None), (505, " \t")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in forest.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    assert forest.near_duplicates(docs(spark, [])).count() == 0
    long = " ".join(words_of(300000, 5))
    odd = docs(spark, [(1, long), (2, long + " end"), (3, "x y z"), (3, "x y z"), (None, "x y z"), (4, None)]).withColumn("signature", F.lit(1))
    rows = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in forest.near_duplicates(odd).collect())
    assert rows == [(0, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True)]
    kept = forest.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4]


def test_components_of_a_chain_and_a_star(spark):
    from lumenfold.llm.components import connected_components

    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(7, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (3, 7, *range(200, 260))} == {3}


def test_word_hashes_follow_words():
    a = shingles.word_hashes("Ab c\tab\x0bé é x")
    assert a[0] == a[2] and len(set(a.tolist())) == 5 - 1 and a[3] == a[4]
    text = " ".join(words_of(200000, 3))
    assert len(np.unique(shingles.word_hashes(text))) == len(set(text.split()))


# --- top k


def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    rows += [(50, [0.1] * 6), (3000, None), (3050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3100, [float("nan")] * 6), (None, [1.0] * 6), (3150, [1.0, 2.0]), (3200, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    valid = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(int)) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    expected = []
    for i, q in valid:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in valid if j != i and len(v) == len(q))[:5]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(table).collect())) == sorted(expected)
    assert topk.top_k(table.limit(0)).count() == 0


def test_top_k_skips_candidates():
    """The bound leaves most of a clustered block unevaluated, and never one of the best."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 400
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    norms = (rows.astype(float) ** 2).sum(axis=1)
    pivots = rows[::170].astype(float)
    block = {"ids": np.arange(len(rows)), "rows": rows, "table": topk._distances(rows.astype(float), pivots, norms.max() - norms), "most": norms.max()}
    reach = topk._distances(rows[:1].astype(float), pivots, np.zeros(1))[0]
    ids, scores = topk._best(0, rows[0], reach, block, 5)
    order = sorted((-int(rows[0] @ v), i) for i, v in enumerate(rows) if i != 0)[:5]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == order


def test_top_k_eliminates_in_many_dimensions(spark, monkeypatch):
    """Clustered vectors of 64 dimensions: a third of the block pairs never meet, and of the rest part of the rows is evaluated."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 128)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    unit = centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 64)) * 0.01
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(unit / np.linalg.norm(unit, axis=1, keepdims=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    met = []
    worth = topk._worth_meeting
    monkeypatch.setattr(topk, "_worth_meeting", lambda c, q: met.append((worth(c, q).count(), c.count() * q.count())) or worth(c, q))
    got = sorted(map(tuple, topk.top_k(table).collect()))
    whole = np.floor(np.array([v for _, v in rows], dtype=np.float32).astype(float) * 256).astype(np.int64)
    expected = []
    for q in range(0, 4000, 50):
        best = sorted((-int(s), j) for j, s in enumerate(whole @ whole[q]) if j != q)[:5]
        expected += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert met[0][0] < 0.7 * met[0][1]
    norms = (whole.astype(float) ** 2).sum(axis=1)
    pivots = whole[:24].astype(float)
    block = {"ids": np.arange(4000), "rows": whole, "table": topk._distances(whole.astype(float), pivots, norms.max() - norms), "most": norms.max()}
    seen = []
    exact = topk._exact_scores
    monkeypatch.setattr(topk, "_exact_scores", lambda r, q: seen.append(len(r)) or exact(r, q))
    monkeypatch.setattr(topk, "_STEP", 64)
    topk._best(0, whole[0], topk._distances(whole[:1].astype(float), pivots, np.zeros(1))[0], block, 5)
    assert sum(seen) < 2000


# --- fingerprints


def test_fingerprints_of_edited_texts(spark):
    rows = [(i, " ".join(words_of(80 + 7 * i, i))) for i in range(40)] + [(7, "same id"), (None, "last"), (100, None), (101, ""), (102, "é" * 999)]
    got = {}
    for r in ctph.edited_fingerprints(docs(spark, rows).withColumn("part", F.lit("clash"))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert sum(map(len, got.values())) == len(order)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row = next(r for r in got[i] if r["fingerprint"] == ctph.fingerprint(text))
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert row["edited_fingerprint"] == ctph.fingerprint(new) and 0 <= row["near_edited"] <= 1
    plain = [r["near_edited"] for i in range(20, 40) for r in got[i]]
    assert min(plain) > 0.4 and np.mean([r["near_next"] for i in range(20, 39) for r in got[i]]) < 0.1
    one = ctph.edited_fingerprints(docs(spark, [(1, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert ctph.edited_fingerprints(docs(spark, [])).count() == 0


def test_fingerprints_of_a_row_repeated_very_often(spark):
    rows = [(i, " ".join(words_of(60 + i, i))) for i in range(60)] + [(30, "the same row again")] * 400 + [(31, f"other text {i}") for i in range(100)]
    table = docs(spark, rows).repartition(5)
    order = sorted(rows, key=lambda x: (x[0], x[1]))
    expected = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        expected.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), ctph.fingerprint(text), ctph.fingerprint(new), ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(after))))
    got = ctph.edited_fingerprints(table)
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in got.collect()) == sorted(expected)


def test_fingerprint_in_pieces_and_edit_distance(monkeypatch):
    text = " ".join(words_of(3000, 9))
    whole = ctph.fingerprint(text)
    monkeypatch.setattr(ctph, "_PIECE", 1000)
    assert ctph.fingerprint(text) == whole
    assert ctph.likeness(whole, ctph.fingerprint(text[:20000] + "changed" + text[20000:])) > 0.9
    assert len(ctph.fingerprint("a" * 10**6)) < 2000

    @lru_cache(None)
    def lcs(a, b):
        return 0 if not a or not b else 1 + lcs(a[1:], b[1:]) if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        assert ctph.longest_common_subsequence(a, b) == lcs(a, b)


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) document.write("<p>no</p>")</script></head><body class="has-sidebar-menu">
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class="cookie-notice">We use cookies to make this site better for you.</div>
<article><h1>Title &eacute;</h1><p><b>First&nbsp; paragraph<br>with a break<p>Second &amp; last <a href=x>link</a> of it.</article>
<aside>More to read in this column of the page</aside><section id="comments"><p>A long comment of a reader who liked the article very much and says so.</p></section>
<form><label>Your name</label><input name=a><button>Send</button></form><footer>&copy; Somebody, all rights reserved.</footer></body></html>"""


def test_main_text():
    assert boilerplate.main_text(PAGE) == "Title é\n\nFirst paragraph with a break\n\nSecond & last link of it."
    assert all(boilerplate.is_main(r[:-1]) == bool(r[-1]) for r in boilerplate.labelled())
    body = " ".join(["word"] * 60)
    assert boilerplate.main_text(f"<div><a>x</a> <a>y</a></div><p>{body}</p><p>{body}</p><div><a>z</a></div>") == f"{body}\n\n{body}"
    for odd in (None, "", "<", "<<p", "<!-- open", '<a href="x', "</div></p>", "<p>" * 20000):
        assert boilerplate.main_text(odd) == ""


LONG = "A sentence of the article that goes on for quite a while so that nobody takes it for a menu entry. " * 2


@pytest.mark.parametrize(
    "page, text",
    [
        # the article's own links: a list, a paragraph that is one link
        (f"<nav><a href=/>Home</a></nav><article><p>{LONG}<ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul></article>", [LONG.strip(), "One", "Two", "Three"]),
        (f"<article><p>{LONG}</p><p><a href=/x>All of this is one link</a></p><p>End.</p></article>", [LONG.strip(), "All of this is one link", "End."]),
        # its lede in a header of its own, a title before it
        (f'<div class="site-header">Site</div><article><div class="post-header">The lede</div><p>{LONG}</p><footer>Filed under x</footer></article>', ["The lede", LONG.strip()]),
        (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", ["Title", LONG.strip()]),
        # short pages
        ("<p>short article.</p>", ["short article."]),
        ('<ul class="menu"><li><a href=/>Home</a></ul><p>short article.</p><div>&copy; 2024 Somebody</div>', ["short article."]),
        ("<article><p>Brief.</p></article>", ["Brief."]),
        ("<div><a href=/>Home</a> <a href=/b>About</a></div>", []),
        # comments of readers in plain containers
        (f"<article><p>{LONG}</p></article><div>I liked this a lot. It was a good read. Thanks for writing it down for all of us here.</div>", [LONG.strip()]),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div><h3>2 Comments</h3><div>{LONG}</div><p>Me too.</p></div><p>{LONG}</p>", [LONG.strip()] * 3),
        (f"<article><p>{LONG}</p><h2>Comments</h2><div>{LONG}</div></article>", [LONG.strip()]),
        (f"<article><p>{LONG}</p><article><p>{LONG}</p></article></article>", [LONG.strip()]),
        # class names that only sound like something else, and camel case
        (f'<div class="page with-sidebar no-ads"><p>{LONG}</p><div class="sideBar"><p>{LONG}</p></div><div id="cookieNotice">{LONG}</div></div>', [LONG.strip()]),
        (f'<div class="post-body"><p>{LONG}</p><p><a href=/x>A link</a></p></div><div class="post-list"><a href=/y>{LONG}</a></div>', [LONG.strip(), "A link"]),
        (f"<p>{LONG}</p><a href=/card><div>{LONG}</div></a>", [LONG.strip()]),
        ("<p>Fish &amp; chips &#8364;5 &lt;b&gt;\n\t of   the\xa0day</p>", ["Fish & chips €5 <b> of the day"]),
    ],
)
def test_main_text_of_page(page, text):
    assert boilerplate.main_text(page) == "\n\n".join(text)


def held_out_f1():
    """Of main blocks, where each labelled page is judged by a tree grown from the others."""
    pages, hits, marks = boilerplate.LABELLED_PAGES, 0, 0
    for i, page in enumerate(pages):
        tree = boilerplate.grow(boilerplate.labelled(pages[:i] + pages[i + 1 :]))
        for *features, label in boilerplate.labelled([page]):
            kept = boilerplate.is_main(features, tree)
            hits, marks = hits + (kept and label), marks + kept + label
    return 2 * hits / marks


def test_tree_on_pages_held_out():
    f1 = held_out_f1()
    print(f"block F1 on held-out pages {f1:.3f}")
    assert f1 > 0.85


def test_tree_looks_at_neighbours():
    def used(node):
        return {boilerplate.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert used(boilerplate._tree()) >= {"words", "links", "notice"} and {f for f in used(boilerplate._tree()) if f.endswith(("_before", "_after")) or f == "titled"}


def of(n, seed=0, put=""):
    return " ".join(words_of(n // 2, 500 + seed) + ([put] if put else []) + words_of(n - n // 2, 700 + seed)) + "."


ADVERTS = ["Advertisement", '<a href="/x" rel="sponsored">Sponsored: buy now</a>', "Subscribe to our newsletter", '<a href="/s">Share on Twitter</a> <a href="/s">Share on Facebook</a>', "We use cookies. Accept all cookies", "Copyright 2024 Example. All rights reserved."]


@pytest.mark.parametrize("advert", ADVERTS)
@pytest.mark.parametrize("at", [1, 2, 3])
def test_notices_in_articles_go(advert, at):
    text = [f"<p>{of(n, n)}</p>" for n in (60, 130, 25)]
    page = f"<body><article><h1>Some title here</h1>{''.join(text[:at])}<p>{advert}</p>{''.join(text[at:])}</article></body>"
    assert boilerplate.main_text(page) == "\n\n".join(["Some title here", *(of(n, n) for n in (60, 130, 25))])


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<body>{}</body>"])
def test_paragraphs_about_notices_stay(wrap):
    parts = [of(200, 1, "copyright law"), of(150, 2, "a newsletter"), of(90, 3, "sign in")]
    inner = f"<h1>A title of it</h1><p>{parts[0]}</p><p>{parts[1]}</p><h2>Login history</h2><p>{parts[2]}</p>"
    assert boilerplate.main_text(wrap.format(inner)) == "\n\n".join(["A title of it", *parts[:2], "Login history", parts[2]])


@pytest.mark.parametrize("name", ['class="side-effects"', 'id="menu-of-the-day"', 'class="alertFatigue"'])
def test_names_alone_remove_nothing(name):
    a, b, c = of(70, 4), of(90, 5), of(90, 6)
    page = f"<body><h1>A title of it</h1><p>{a}</p><div {name}><p>{b}</p><p>{c}</p></div></body>"
    assert boilerplate.main_text(page) == "\n\n".join(["A title of it", a, b, c])
    links = f"<body><h1>A title of it</h1><p>{a}</p><p>{b}</p><div {name}><p><a href='/'>more of</a></p><p><a href='/'>such things</a></p></div></body>"
    assert boilerplate.main_text(links) == "\n\n".join(["A title of it", a, b])


def test_responses():
    a, b, c = of(100, 7), of(100, 8), of(100, 9)
    page = f"<body><h1>A title of it</h1><p>{a}</p><h2>Responses</h2><p>{b}</p><p>{c}</p></body>"
    assert boilerplate.main_text(page) == "\n\n".join(["A title of it", a, "Responses", b, c])
    comments = f"<body><h1>A title of it</h1><p>{a}</p><h2>Responses</h2><p>Ann, May 3</p><p>{of(40, 1)}</p><p>Bob, May 4</p><p>{of(60, 2)}</p></body>"
    assert boilerplate.main_text(comments) == f"A title of it\n\n{a}"
    sure = f"<body><h1>A title of it</h1><p>{a}</p><h2>3 Comments</h2><p>{b}</p><p>{c}</p></body>"
    assert boilerplate.main_text(sure) == f"A title of it\n\n{a}"


def test_long_and_deep_pages():
    import time

    start = time.time()
    assert boilerplate.main_text("<div>" * 20000 + f"<p>{LONG}" + "</p>" * 20000 + "</span></section>" * 20000) == LONG.strip()
    assert boilerplate.main_text("<ul><li>" * 10000 + "x" + "</li></ul></b>" * 10000) == "x"
    assert boilerplate.main_text(f"<article>{'<p>' + LONG + '</p>' * 3}</article>" * 2000).count(LONG.strip()) == 2000
    assert time.time() - start < 20


def test_pages_on_spark(spark, sf):
    rows = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [tuple(r) for r in boilerplate.extract_main_text(rows).collect()]
    assert got[0] == got[1] and got[0][3] == len(got[0][2]) and got[2] == (None, None, "", 0) and got[3] == (2, "v", "", 0)
    assert boilerplate.extract_main_text(rows.limit(0)).count() == 0
    assert queries.QUERIES["op7_extract_main_text"](spark, sf).where("n_chars = 0").count() == 0


# --- languages


def test_forward_sums_equal_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab"]
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    table = langid.PieceTable(pieces)

    def total(word, j):
        return 1.0 if not word else sum(p[pieces.index(word[:k]), j] * total(word[k:], j) for k in range(1, len(word) + 1) if word[:k] in pieces)

    words = ["ab", "bab", "abab", "b"]
    got = langid.log_probabilities(table, p, words)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([np.log(total("▁" + w, j)) for j in range(2)])
    counts = langid.expected_counts(table, p[:, 0], ["ab"], np.array([2.0]))
    assert counts @ [len(x) for x in pieces] == pytest.approx(2 * len("▁ab"))


def test_long_words_are_summed_whole(monkeypatch):
    """Words of any length: the same sums as for short ones, over the limits of lookups too."""
    rng = np.random.default_rng(0)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "bab", "abba"]
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    table = langid.PieceTable(pieces)
    words = ["".join(rng.choice(list("abc"), n, p=[0.5, 0.45, 0.05])) for n in (1, 7, 49, 150)]
    for places in (langid._PLACES, 10):
        monkeypatch.setattr(langid, "_PLACES", places)
        for word in words:
            assert langid.long_log_probability(table, p, word) == pytest.approx(langid.log_probabilities(table, p, [word])[0])
    model = langid.LanguageModel(["x", "y"], pieces, p)
    logs, lettered = model.score([" ".join(words), "12", words[3]])
    assert logs[0] == pytest.approx(langid.log_probabilities(table, p, words).sum(axis=0)) and lettered.tolist() == [True, False, True]
    assert np.isfinite(langid.long_log_probability(table, p, "ab" * 100000)).all()


def test_languages_held_out(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.QUERIES["op8_identify_language"](spark, sf).join(table, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_languages_of_odd_rows(spark):
    model = langid.LanguageModel(["x", "y"], ["▁", "a", "b"], np.array([[0.2, 0.2], [0.7, 0.1], [0.1, 0.7]]))
    odd = docs(spark, [(1, None), (1, None), (2, ""), (3, "12 !?"), (4, "a" * 200000), (5, "B b"), (6, "漢字")]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "x" and got[5][0] == "y" and 0 < got[6][1] <= 1
    nothing = langid.fit_language_model(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


# --- packing


def test_tokens_equal_the_library(sf):
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:100] + ["", "a<|endoftext|>b", "İx ﬁ 中文 ½ ² x\x1cy", "it's we'll O'D", "“q”—don’t…", "Σ ΑΣ", "a b"]
    reference = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for ids, text in zip(packing.WordTokenizer().ids_of_all(texts), texts, strict=True):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_minimum_bin_slack_fills_bins():
    rng = np.random.default_rng(0)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 4097, 300), rng.integers(1, 50, 300), strict=True)}
    bins = packing.minimum_bin_slack(histogram)
    used = {}
    for content, times in bins:
        assert sum(n * c for n, c in content.items()) <= 4096
        for n, c in content.items():
            used[n] = used.get(n, 0) + c * times
    assert used == histogram
    least = max(sum(n * c for n, c in histogram.items()) / 4096, sum(c for n, c in histogram.items() if n > 2048))
    assert sum(t for _, t in bins) <= 1.01 * least + 1
    assert packing.minimum_bin_slack({}) == []
    # 33 tokens need four bins of ten.
    assert sum(t for _, t in packing.minimum_bin_slack({6: 2, 4: 2, 3: 2, 7: 1}, 10)) == 4


def test_packing_round_trip(spark):
    texts = [(i, " ".join(words_of(40 * i + 1, i))) for i in range(40)] + [(100, None), (101, ""), (102, ""), (102, ""), (None, "x")]
    rows = packing.pack_documents(docs(spark, texts).withColumn("length", F.lit("clash")), with_ids=True).collect()
    tokenizer, pieces = packing.WordTokenizer(), {}
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 4096 and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in texts[:40]:
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == [*tokenizer.ids(text).tolist(), 1]
        assert all(r["start"] == 4096 * r["piece"] for r in own)
    assert len(pieces[102]) == 2 and len(pieces[None]) == 1
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_packing_many_rows_of_one_key(spark):
    rows = packing.pack_documents(spark.range(20000).selectExpr("7L AS doc_id", "if(id % 3 = 0, 'a b c', 'd') AS text").repartition(6)).collect()
    assert len(rows) == 20000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 20000
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == -(-total // 4096)


def test_vocabulary_is_whole():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(langid.VOCABULARY))
    public = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    letters = {p for p in public if p == "▁" or p.removeprefix("▁").isalpha()}
    pieces = langid.load_vocabulary()
    assert letters <= set(pieces) and max(map(len, pieces)) > 8
    table = langid.PieceTable(pieces)
    longest = max(pieces, key=len)
    found = list(langid._piece_numbers(table, langid.as_matrix([longest], len(longest))))
    assert any(start == 0 and size == len(longest) and pieces[numbers[0]] == longest for start, size, _, numbers in found)


def test_last_links_of_small_groups(spark):
    own = {i: np.arange(100 + (i == 3), dtype=np.uint64).tobytes() for i in (1, 2, 3)} | {4: np.arange(500, 600, dtype=np.uint64).tobytes()}
    loose = spark.createDataFrame([(i, 1) for i in own], "node long, component long")
    strict = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    sets = spark.createDataFrame([(i, bytearray(s)) for i, s in own.items()], "id long, shingles binary")
    assert {(3, min(r)) for r in forest._last_links(loose, strict, sets, 85).collect()} <= {(3, 1), (3, 2)}
    assert forest._last_links(loose, strict, sets, 85).count() > 0
    assert forest._last_links(loose.where("node < 3"), strict, sets, 85).count() == 0


def linked_sets(own, percent=85):
    """Components by plain comparison of all sets."""
    names, up = sorted(own), {i: i for i in own}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    shared = np.zeros((len(names), len(names)), dtype=np.int64)
    where = {}
    for at, i in enumerate(names):
        for x in own[i].tolist():
            where.setdefault(x, []).append(at)
    for at in where.values():
        if len(at) > 1:
            shared[np.ix_(at, at)] += 1
    sizes = np.array([len(own[i]) for i in names])
    for x, y in zip(*np.nonzero(100 * shared >= percent * (sizes[:, None] + sizes[None] - shared)), strict=True):
        a, b = sorted((top(names[x]), top(names[y])))
        up[b] = a
    return {i: top(i) for i in names}


@pytest.mark.parametrize("core, rest", [(65, 35), (88, 12), (92, 8)])
def test_last_links_equal_all_pairs(spark, monkeypatch, core, rest):
    """A large group of loosely alike rows: true pairs in between, with rare and with frequent rarest shingles."""
    monkeypatch.setattr(forest, "RARE_ROWS", 6)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 64)
    rng, own = np.random.default_rng(core), {}
    base = rng.integers(0, 1 << 40, core).astype(np.uint64)
    for i in range(0, 600, 2):
        tail = rng.integers(0, 1 << 40, rest).astype(np.uint64)
        own[i] = np.unique(np.concatenate([base[rng.random(core) > 0.02], tail]))
        own[i + 1] = np.unique(np.concatenate([base[rng.random(core) > 0.02], tail[: rng.integers(1, rest + 1)]]))
    loose = spark.createDataFrame([(i, 0) for i in own], "node long, component long")
    strict = spark.createDataFrame([(1, 0), (0, 0)], "node long, component long") if linked_sets({i: own[i] for i in (0, 1)})[1] == 0 else spark.createDataFrame([], "node long, component long")
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in own.items()], "id long, shingles binary")
    more = [tuple(r) for r in forest._last_links(loose, strict, sets, 85).collect()]
    from lumenfold.llm.components import spanning_links

    a, b = (np.array(x, dtype=np.int64) for x in zip(*(more + [tuple(r) for r in strict.collect()]), strict=True))
    got = {i: i for i in own} | dict(zip(*(x.tolist() for x in spanning_links(a, b)), strict=True))
    assert got == linked_sets(own)


def test_many_loosely_alike_rows(spark):
    """Eight thousand rows that share two thirds of their words: every pair among them is found, and nothing else."""
    rng = np.random.default_rng(4)
    base, rows = words_of(60, 40), []
    for i in range(0, 8000, 2):
        own = base + words_of(24, 1000 + i)
        rows.append((i, " ".join(own)))
        rows.append((i + 1, " ".join(own[:-1] + ["other"])) if rng.random() < 0.5 else (i + 1, " ".join(base + words_of(24, 90000 + i))))
    sets = {i: shingles.shingle_set(t) for i, t in rows}
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    expected = {i: i - 1 if i % 2 and linked(sets[i], sets[i - 1]) else i for i in sets}
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs(spark, rows)).collect()}
    assert got == expected


def counted(monkeypatch):
    """Rows of each table that the operator writes."""
    rows, staged = {}, forest.staged

    def count(df, name, *args):
        out = staged(df, name, *args)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(forest, "staged", count)
    return rows


def test_one_key_with_many_texts(spark, monkeypatch):
    """Every set is confirmed once, whatever key it has, and what any text of a key is linked with is in the key's component."""
    sizes, base = [], words_of(200, 60)
    for n in (60, 120):
        rows = [(7, edited(base, 1, i)) for i in range(n)] + [(100 + i, edited(base, 1, 5000 + i)) for i in range(n)]
        rows += [(7, "one two three four five six"), (3, "one two three four five six"), (5, "one two three four five seven eight")]
        tables = counted(monkeypatch)
        got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs(spark, rows)).collect()}
        monkeypatch.undo()
        assert got == {7: 3, 3: 3, 5: 5} | {100 + i: 3 for i in range(n)}
        sizes.append((tables["forest-pairs"], tables["forest-links"], tables["forest-sets"]))
    for pairs, links, sets in sizes:
        assert links <= pairs and sets <= 2 * 120 + 2


def test_recall_in_deep_regions(spark, monkeypatch):
    """Regions of a few rows, so that nearly all are cut at 7, 10 and 14 values: what the candidates find, and that the last
    comparison finds the rest."""
    monkeypatch.setattr(forest, "SMALL_REGION", 4)
    monkeypatch.setattr(forest, "REGION_ROWS", 24)
    base, rows = words_of(60, 70), []
    for i in range(0, 3000, 2):
        own = base + words_of(24, 200000 + i)
        rows += [(i, " ".join(own)), (i + 1, " ".join(own[:-1 - i % 8] + words_of(1 + i % 8, 300000 + i)))]
    sets = {i: shingles.shingle_set(t) for i, t in rows}
    linked = {i for i in range(0, 3000, 2) if 100 * len(np.intersect1d(sets[i], sets[i + 1])) >= 85 * len(np.union1d(sets[i], sets[i + 1]))}
    last = {}
    monkeypatch.setattr(forest, "_last_links", lambda *args, found=forest._last_links: last.setdefault("rows", forest.staged(found(*args), "kept")))
    got = {r["doc_id"]: r["component_id"] for r in forest.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: i - 1 if i % 2 and i - 1 in linked else i for i in sets}
    missed = last["rows"].distinct().count()
    print(f"candidates found {1 - missed / len(linked):.4f} of {len(linked)} links in deep regions")
    assert 0 <= missed <= 0.2 * len(linked) and len(linked) > 500


# --- licenses


def test_license_notices(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1]
    text = "Intro é. " + gpl.replace("you can redistribute it", "you may redistribute it") + " middle words " + mit.upper().replace(",", " ###") + " Licensed under CC BY-NC 4.0. the license of the version"
    odd = docs(spark, [(1, text), (1, text), (2, None), (3, ""), (4, "free software license version " * 50), (None, "Released*** under%%% the$$$ MIT### License.")]).withColumn("coverage", F.lit("clash"))
    rows = licenses.scan_licenses(odd).collect()
    first = [r for r in rows if r["doc_id"] == 1]
    assert [r["license"] for r in first] == ["GPL-3.0", "MIT", "CC-BY-NC-4.0"] * 2
    assert all(text[r["first_char"] : r["end_char"]] == r["matched_text"] for r in first)
    assert first[0]["coverage"] > 0.95 and first[0]["matched_text"].startswith("This program") and first[1]["coverage"] == 1.0
    assert [(r["doc_id"], r["license"]) for r in rows if r["doc_id"] != 1] == [(None, "MIT")]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize("line", ["Released under the MIT License.", "foo - Licensed under the MIT License.", "Licensed under CC BY 4.0.", "Released under the MIT license, as bar is."])
def test_repeated_license_lines(line):
    index, n = licenses.TemplateIndex(licenses.TEMPLATES), 100
    text = "é\n" + "\n".join([line] * n)
    found = licenses.scan_text(text, index)
    assert len(found) == n and {r[:3] for r in found} == {found[0][:3]} and found[0][2] == 1.0
    assert [r[3] // (len(line) + 1) for r in found] == list(range(n))
    assert all(text[r[3] : r[4]] == text[found[0][3] : found[0][4]] for r in found)
    # A damaged notice in each line as well.
    damaged = licenses.TEMPLATES["MPL-2.0"][0].replace("Source Code Form", "Source File")
    assert len(licenses.scan_text("\n".join([damaged] * 20), index)) == 20


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_its_license(name):
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for template in licenses.TEMPLATES[name]:
        assert {r[0] for r in licenses.scan_text("Some words before. " + template + " And some words after.", index)} == {name}


def test_license_scan_equals_a_scan_of_every_place(spark, sf):
    """The query against a search without the index: every template at every word of every text."""
    index = licenses.TemplateIndex(licenses.TEMPLATES)

    class Everywhere:
        templates = index.templates

        def hits(self, words):
            at = np.arange(len(words))
            return np.concatenate([np.column_stack([np.full(len(at), t), at, at]) for t in range(len(self.templates))])

    table, expected = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), []
    for doc, text in table:
        if text:
            expected += [(doc, *row) for row in licenses.scan_text(text, Everywhere())]
    columns = ["doc_id", "license", "template", "coverage", "first_char", "end_char", "matched_words"]
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES["op3_scan_licenses"](spark, sf).collect()]
    assert len(got) > 0 and sorted(got) == sorted(expected)


def test_near_licenses_are_told_apart():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    names = lambda text: [r[0] for r in licenses.scan_text(text, index)]
    agpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )
    assert names(agpl) == ["AGPL-3.0"] and names(agpl.replace("Affero", "Lesser").replace("program", "library")) == ["LGPL-3.0"] and names(agpl.replace("Affero ", "")) == ["GPL-3.0"]
    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    two = head + (
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    )
    assert names(two) == ["BSD-2-Clause"]
    assert names(two + " 3. " + licenses.TEMPLATES["BSD-3-Clause"][1]) == ["BSD-3-Clause"]


def test_alignment_equals_full_table():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t, w = rng.integers(1, 6, 12).astype(np.uint64), rng.integers(1, 6, 12).astype(np.uint64)
        h = np.zeros((13, 13))
        for i in range(1, 13):
            for j in range(1, 13):
                h[i, j] = max(0, h[i - 1, j - 1] + (licenses.MATCH if t[i - 1] == w[j - 1] else licenses.MISMATCH), h[i - 1, j] + licenses.GAP, h[i, j - 1] + licenses.GAP)
        padded = np.concatenate([np.zeros(12, dtype=np.uint64), w, np.zeros(12, dtype=np.uint64)])
        assert licenses.align(t, padded, 12)[0] == h.max()


# --- the pipeline


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    start = spark.read.parquet(f"{sf}/documents.parquet").unionByName(docs(spark, [(10**6, None), (10**6 + 1, "123 !!")]))
    before, counts = start, {}
    for name, stage in pipeline.STAGES:
        after = pipeline.staged(stage(spark, before, sf), name)
        counts[name] = after.count()
        if name != "pack":
            assert after.columns == before.columns
            ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "language":
            assert not ids & {10**6, 10**6 + 1} and len(ids) >= 0.95 * (start.count() - 2)
        if name == "near_dedup":
            expected = plain_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert ids == {i for i, (_, c) in expected.items() if i == c}
        if name == "personal_data":
            assert after.where(F.col("text").rlike(r"\b\d{16}\b")).count() == before.where(F.col("text").rlike(r"\b\d{16}\b")).count()
            assert after.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").where(F.col("old").rlike("@mail") & (F.col("old") == F.col("text"))).count() == 0
        last, before = before, after
    assert {r["doc_id"] for r in before.select("doc_id").collect()} == {r["doc_id"] for r in last.select("doc_id").collect()}


def test_pipeline_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and letterless texts, a clashing extra column, and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    english = "the house near the river was sold to a young family that wants to grow old there"
    german = "das haus am fluss wurde an eine junge familie verkauft die dort alt werden will"
    rows = [
        (1, english, "en", "a", 7), (1, english, "en", "a", 7), (2, german, "de", "a", 8), (3, german + " und mehr", None, None, None),
        (4, None, None, None, None), (5, "", "en", "b", 1), (6, "123 !!", "de", "b", 1), (None, english + " today", "en", "b", 1), (None, None, None, None, None),
    ] + [(10 + i, (german if i % 2 else english) + f" {'x' * (i + 1)} seite {i}", "de" if i % 2 else "en", "c", i) for i in range(12)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    for start in (odd, odd.limit(0)):
        before = start
        for name, stage in pipeline.STAGES:
            before = pipeline.staged(stage(spark, before, ""), f"odd-{name}")
            if name != "pack":
                assert before.columns == start.columns
            if name == "language":
                kept = [r["doc_id"] for r in before.collect()]
                assert not {4, 5, 6} & set(kept)
            if name == "near_dedup":
                after = [r["doc_id"] for r in before.collect()]
                assert set(after) <= set(kept) and after.count(1) <= 1 and after.count(None) == kept.count(None)
        assert start is odd or before.count() == 0
        assert before.select("sequence_id", "offset").distinct().count() == before.count()
