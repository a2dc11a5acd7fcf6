"""Operators on pages: WARC archives, main text, URL rules."""

import hashlib
import random
import time
from itertools import combinations, product

import numpy as np
import pytest

from tidemill.llm import html_text, url_rules, warc

# WARC

SCHEMA = "page_id long, url string, html string, first long, key string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "same payload é " * 20
    rows = [(i, f"http://www.h{i % 5}.example.com/p/{i}?q=1#top", f"<p>page {i} " + "x" * i * 7, 0, "k") for i in range(60)]
    rows += [(100 + i, "http://hot.example.com/", long, 0, "k") for i in range(30)]
    rows += [(200, "HTTP://Other.Example.com/ü a", long, 0, "k"), (201, None, None, 0, "k"), (202, "no scheme", "", 0, "k"), (203, "http://x/", "short", 0, "k"), (204, "http://x/", "short", 0, "k"), (None, "http://x/", long, 0, "k"), (3, "http://again/", long + "!", 0, "k"), (2**60 + 1, "http://far/", long, 0, "k"), (2**60 + 3, "http://far/", "z" * 200, 0, "k"), (2**60 + 4, "http://far/", "z" * 200, 0, "k"), (205, "http://big/", "y" * 3_000_000, 0, "k")]
    return spark.createDataFrame(rows + rows[5:6], SCHEMA)


def test_archive_round_trip(spark, pages, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}/a"
    warc.archive(pages, folder)
    captures = warc.lookup(pages.select(warc.url_key(pages.url).alias("key")), folder)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_records(captures, folder).collect()), key=str)
    rows = pages.collect()
    payload = lambda r: (r.html or "").encode()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[payload(r)] = min(first.get(payload(r), r.page_id), r.page_id)
    expected, headed = [], set()
    for r in rows:
        p, head = payload(r), first.get(payload(r))
        revisit = len(p) >= 100 and head is not None and (r.page_id is None or r.page_id > head or p in headed)
        headed |= {p} if r.page_id == head else set()
        expected.append((r.page_id, "revisit" if revisit else "response", head if revisit else None, len(p), hashlib.sha256(p).hexdigest()))
    assert got == sorted(expected, key=str)


def test_lookup_finds_keys_that_span_blocks(spark, pages, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}/b"
    captures = warc.write_archive(pages, folder)
    directory = warc.write_index(captures, folder, block_lines=4)
    assert directory.count() > 20
    keys = spark.createDataFrame([("com,example,hot)/",), ("com,example,h1,www)/p/6?q=1",), ("absent",), ("",)], "key string")
    found = [(r.key, r.page_id) for r in warc.lookup(keys, folder).collect()]
    assert sorted(p for k, p in found if k == "com,example,hot)/") == list(range(100, 130))
    assert [p for k, p in found if k.endswith("p/6?q=1")] == [6]
    assert [p for k, p in found if k == ""] == [201]


def test_urls_with_any_character_are_found_again(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}/d"
    urls = [f"http://x.example/{c}a 1 b" for c in "\u0085\u2028\u2029\x1c\u3000é😀"] + ["http://example.com\n", "dirty\nurl with\r\nlines", "http://a b/\u2028 5 f 6 7", "http://x/"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.archive(pages, folder)
    captures = warc.lookup(pages.select(warc.url_key(pages.url).alias("key")), folder)
    assert sorted(r.page_id for r in warc.read_records(captures, folder).collect()) == list(range(len(urls)))


ODD = ["\u0085", "\u2028", "\x0b", "\n", "\r\n", " ", "\t", "%", "é", "\x00"]


def test_odd_characters_in_host_and_tail_lose_no_page(spark, tmp_path):
    urls = [f"http://{h}a.example{h}/x{t}y" for h in ["", *ODD] for t in ["", *ODD]] + [None, "", "://"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}" + "z" * 200) for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in warc.query(spark, str(tmp_path)).collect()) == list(range(len(urls)))
    keys = [r[0] for r in pages.select(warc.url_key(pages.url)).collect()]
    assert all("\x20" < c < "\x7f" for k in keys for c in k)


def test_one_row_of_a_repeated_head_is_the_response(spark, tmp_path):
    rows = [(4, "http://x/", "b" * 300)] * 40 + [(9, "http://y/", "b" * 300), (None, "http://z/", "b" * 300), (None, "u", "c" * 300), (None, "v", "c" * 300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(4, "response", None, 300)] + [(4, "revisit", 4, 300)] * 39 + [(9, "revisit", 4, 300), (None, "revisit", 4, 300)] + [(None, "response", None, 300)] * 2, key=str)


def test_folders_are_resolved_as_spark_resolves_them(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    pages = spark.createDataFrame([(1, "http://x/", "p")], "page_id long, url string, html string")
    warc.archive(pages, f"{tmp_path}/plain")
    assert warc.lookup(pages.select(warc.url_key(pages.url).alias("key")), f"{tmp_path}/plain").count() == 1
    with pytest.raises(ValueError):
        warc._open("/no/scheme")


def test_tasks_follow_the_archive_bytes(spark):
    assert warc._tasks(spark, 0) == 1 and warc._tasks(spark, 100 * warc.READ_BYTES) == 100


def test_damage_is_noticed():
    raw = warc.record(1, "http://x/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(raw)[5] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"PAYLOAD"))


def test_empty_archive(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}/c"
    none = spark.createDataFrame([], SCHEMA)
    warc.archive(none, folder)
    assert warc.read_records(warc.lookup(none.select("key"), folder), folder).count() == 0


# main text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id=top-menu><a href=x>Home</a> <a href=y>About us</a></div>
<header><div class="logo">My Site</div></header><div class="cookie-notice">We use cookies. Accept them all to go on, please.</div>
<div class=content><h1>A&nbsp;title &eacute;</h1><p>First   paragraph with <a href=a>a link</a> in it,<br>and some more text here.<p>Short one.
<div class="advert">Buy now! Best offers, cheap things for everyone.</div><ul><li>One item of the list<li>A second item</ul>
<p>The last paragraph of the article, which is long enough to count as text.</p><script>var x="<p>no</p>";</script></div>
<div class=sidebar><h3>Related</h3><ul><li><a href=1>Other story</a></ul></div><form><label>Name</label><button>Send</button></form>
<div id="comments"><p>Great article, I liked it very much. Thanks for sharing it with us all!</p></div><footer>&copy; 2020 Me</footer>"""
TEXT = "A title é\n\nFirst paragraph with a link in it, and some more text here.\n\nShort one.\n\nOne item of the list\n\nA second item\n\nThe last paragraph of the article, which is long enough to count as text."


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>Home</nav>") == ""
    assert html_text.main_text("<article><p>5 &lt; 6 &amp 7. Cut off &am") == "5 < 6 & 7. Cut off &am"
    assert html_text.main_text("<article>" + "<p>Some words of text here, all of them plain.</p>" * 3000 + "</article>").count("\n\n") == 2999


LONG = "Many plain words of a paragraph, which make a sentence or two. They go on for a while, as text does."
LAYOUTS = {
    "semantic": (
        f"""<a class="skip-link" href="#m">Skip to content</a><div id="cookie-banner" role="dialog"><p>We use cookies to improve things. Read our policy for more.</p></div><header><a href="/">Site</a></header>
        <main><nav class="breadcrumb"><a href=x>Home</a></nav><article><header><h1>Title here</h1><p class="byline">By Someone</p></header><p>{LONG}</p><aside class="related"><p>{LONG}</p></aside><h2>Part two</h2><p>{LONG}</p>
        <div class="newsletter"><form><p>Subscribe to our letter now, it is free.</p></form></div><blockquote>Short quote.</blockquote><div class="share-buttons"><a href=f>Share</a></div><footer><p>Filed under things.</p></footer></article>
        <section id="comments"><h3>2 comments</h3><div class="comment"><p>{LONG}</p></div></section></main><footer><p>&copy; All rights reserved by us, the people of it.</p></footer>""",
        ["Title here", LONG, "Part two", LONG, "Short quote."],
    ),
    "table": (f'<table><tr><td class="nav"><a href=1>Home</a><br><a href=2>About</a></td><td class="content"><h1>Title here</h1><p>{LONG}</p><p>End.</p></td></tr></table><div class="foot">Copyright 2020</div>', ["Title here", LONG, "End."]),
    "bare": (f"<div><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul></div><div><h1>Title here</h1><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div>Copyright 2020 Us</div>", ["Title here", LONG, "Ok.", LONG]),
    "classes": (
        f'<div class="page has-sidebar"><div class="top-bar"><span>Call us now</span></div><div class="article-header"><h1>Title here</h1></div><div class="article-body">{LONG}<p>Tiny</p></div><div class="commentsArea"><ol><li><p>{LONG}</p></li></ol></div></div><div class="notice">{LONG}</div>',
        ["Title here", LONG, "Tiny"],
    ),
    "hidden": (f'<h1>Title here</h1><p>{LONG}</p><p>Hm</p><div hidden><p>{LONG}</p></div><div style="display: none">{LONG}</div>', ["Title here", LONG, "Hm"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, text = LAYOUTS[name]
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n\n") == text


RAW_LEFT_OPEN = ["<datalist><option value=a><option value=b></datalist>", "<select><option>One<option>Two</select>", *(f"<div><{t}></div>" for t in ("button", "svg", "canvas", "map", "object"))]


@pytest.mark.parametrize("control", RAW_LEFT_OPEN)
def test_controls_without_an_end_hide_no_article(control):
    assert html_text.main_text(f"<body><form>{control}</form><article><h1>Title here</h1><p>{LONG}</p></article></body>") == f"Title here\n\n{LONG}"
    assert html_text.main_text(f"<body>{control}<article><h1>Title here</h1><p>{LONG}</p></article></body>") == f"Title here\n\n{LONG}"


def test_formulas_stay():
    assert html_text.main_text(f"<article><p>{LONG} So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == f"{LONG} So a=2 holds."


HOSTILE = {
    "unbalanced quotes": '<p class="x>abc</p>' * 50_000,
    "quotes of two kinds": "<p a='> <p b=\"> " * 60_000,
    "deep tree, unmatched ends": "<div>" * 150_000 + "</p></span>" * 30_000,
    "items in a deep tree": "<li><ul>" + "<div>" * 80_000 + "<li></li>" * 60_000,
    "angle brackets": "<" * 1_000_000,
    "open tags": "<a " * 300_000,
    "comments": "<!--" * 250_000,
    "ampersands": "&" * 1_000_000,
    "equals": "<p " + '="' * 499_990,
    "control left open": "<button>" + "<div>" * 90_000 + "</p>" * 90_000,
    "titles left open": "<title>" * 120_000,
    "alternating blocks": "<article>" + "<p>o</p><div><p>Some longer text, and more.</p></div>" * 20_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_no_longer(name):
    began = time.process_time()
    html_text.main_text(HOSTILE[name])
    assert time.process_time() - began < 2


def test_broken_tags_leave_no_markup():
    assert html_text.main_text(f'<article><p title="a>{LONG}</p><p class="x">{LONG}</p></article>') == f"{LONG}\n\n{LONG}"
    assert html_text.main_text(f'<article><p title="a>{LONG}</p><p>{LONG}</p></article>') == f"{LONG}\n\n{LONG}"
    assert html_text.main_text(f'<article><p title="a>b" class=x data-x="<b>q</b>">{LONG}</p></ article><p class=') == LONG
    assert html_text.main_text("<article><p>Very large: &#" + "9" * 6000 + "; and then some.</p></article>") == "Very large: \ufffd and then some."


@pytest.mark.parametrize("name", ["discussion", "alert", "meta-analysis", "social-history", "cookie-recipes", "tags"])
def test_ordinary_words_in_an_article_drop_nothing(name):
    assert html_text.main_text(f'<article><p>{LONG}</p><section class="{name}"><p>{LONG}</p></section><p id="{name}">{LONG}</p></article>') == "\n\n".join([LONG] * 3)
    assert html_text.main_text(f'<article><p>{LONG}</p><svg><title>no</title><text>Label</text></svg><noscript>Plain words, as text.</noscript></article>') == f"{LONG}\n\nLabel\n\nPlain words, as text."


def test_the_cut_changes_labels():
    page = f'<div><p>{LONG}</p><p>{LONG}</p><p class="alert">See below, or not.</p><p>{LONG}</p><p>{LONG}</p></div>'
    found = html_text.blocks(f"<article>{page}</article>")
    alone = [float(np.dot(html_text.features(b), html_text.PRIOR)) > 0 for b in found]
    assert alone == [True, True, True, True, True]
    weights = html_text.PRIOR.copy()
    weights[html_text.FEATURES.index("weak_word")] = -6.0
    alone = [float(np.dot(html_text.features(b), weights)) > 0 for b in found]
    assert alone == [True, True, False, True, True] and all(html_text.label(found, weights))
    short = html_text.blocks(f"<div><h1>Title here</h1><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div>")
    assert float(np.dot(html_text.features(short[2]), html_text.PRIOR)) < 0 and html_text.label(short, html_text.PRIOR)[2]


def test_labels_come_from_other_pages(spark):
    word = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    rows = [(i, "u", f"<p>Same on all pages of the site</p><div class=ad><p>{word(i, 12)}</p></div><p>{word(1000 + i, 40)}</p><p>short {i}</p>") for i in range(12)]
    rows += [(50 + i, "u", rows[0][2]) for i in range(5)]  # copies of a page
    found = html_text.labelled_blocks(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.no, r.label) for r in found} == {(0, 0.0), (1, 1.0), (2, 1.0)} and len(found) == 3 * len(rows)


def brute_cut(source, sink, edges):
    def cost(side):
        return sum(source[i] if not s else sink[i] for i, s in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])

    return min(cost(side) for side in product([True, False], repeat=len(source))), cost


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 9)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(2 * n)]
        edges = [e for e in edges if e[0] != e[1]]
        least, cost = brute_cut(source, sink, edges)
        assert cost(html_text.min_cut(source, sink, edges)) == pytest.approx(least)
        assert cost(html_text.reduced_cut(source, sink, edges)) == pytest.approx(least)
        far = [5 * x for x in source]  # some nodes are settled by their terminals alone
        assert brute_cut(far, sink, edges)[1](html_text.reduced_cut(far, sink, edges)) == pytest.approx(brute_cut(far, sink, edges)[0])


def test_extract_and_training(spark):
    rows = [(i, f"http://x/{i}", PAGE.replace("content", "post").replace("<div class=post>", "<article>")) for i in range(20)] + [(30, None, None), (None, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    weights = html_text.train(pages)
    assert weights.shape == html_text.PRIOR.shape and not np.allclose(weights, html_text.PRIOR)
    got = html_text.extract(pages).collect()
    assert [r.n_chars for r in got] == [len(TEXT)] * 20 + [0, len(TEXT)] and got[0].text == got[-1].text == TEXT
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# URL rules


def brute_judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


URLS = [None, "", "example.org/es/", "http://example.org/es/x", "http://a.example.org/en/1?x#y", "https://badexample.org/es/", "http://Example.ORG", "http://x.com/fr/", "http://com/de/a", "http://x.com/de?", "ftp://y.net/en/1", "http://a.org?x=/es/", "http://example.org/es", "a://b://example.org/es/"]


def test_fixed_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in url_rules.judge(pages, labels).collect():
        host, path, rule, verdict = brute_judge(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules_block_what_goes_with_bad_labels(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        spam = rng.random() < 0.3
        rows.append((i, f"http://{'pills' if spam else 'news'}.shop.net/{rng.choice(['en', 'xx'])}/{i}.html", None))
        marks.append((i, 0 if spam else 1, 0))
    pages = spark.createDataFrame([*rows, (900, "http://pills.shop.net/zz/1", None), (901, "http://pills.other.net/en/900.html", None)], "page_id long, url string, _id long")
    labels = spark.createDataFrame(marks + marks[:3], "doc_id long, quality int, toxic int")
    rules = [r.tokens for r in url_rules.mine(url_rules.labelled(pages, labels)).collect()]
    assert ["host=pills"] in rules and all("host=pills" in t for t in rules) and len(rules) == 1
    verdict = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert all(verdict[i] == ("block" if "pills" in u else "allow") for i, u, _ in rows) and verdict[900] == "block"
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def brute_rules(rows, min_count, min_lift, deviations):
    """{tokens: (n, n_bad)} by listing every combination of items; rows are (tokens, bad)."""
    on = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            on.setdefault(t, set()).add(i)
    items = {}
    for t, at in on.items():
        items.setdefault(frozenset(at), []).append(t)
    bad = {i for i, r in enumerate(rows) if r[1]}
    share = len(bad) / len(rows)
    items = [(at, ts) for at, ts in items.items() if len(at & bad) >= min_count]
    found = {}
    for k in range(1, len(items) + 1):
        for chosen in combinations(range(len(items)), k):
            at = frozenset.intersection(*(items[i][0] for i in chosen))
            n, b = len(at), len(at & bad)
            if b >= min_count and b / n >= min_lift * share and b - n * share >= deviations * (n * share * (1 - share)) ** 0.5:
                found[chosen] = (n, b)
    kept = {c: v for c, v in found.items() if not any(set(o) < set(c) and w[1] / w[0] >= v[1] / v[0] for o, w in found.items())}
    return {tuple(sorted(t for i in c for t in items[i][1])): v for c, v in kept.items()}


def test_mining_and_matching_equal_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for i in range(900):
        tokens = {f"t{k}" for k in range(7) if rng.random() < 0.35} | {"always"}
        tokens |= {f"{t}x" for t in tokens if t in ("t1", "t2")} | {f"t3x{j}" for j in range(40) if "t3" in tokens}  # tokens that go together: 2 ** 40 combinations otherwise
        chance = 0.45 if "t1" in tokens else 0.5 if {"t4", "t5"} <= tokens else 0.15
        rows.append((i % 850, sorted(tokens), rng.random() < chance))
    df = spark.createDataFrame(rows, "page_id long, tokens array<string>, bad boolean")
    for count, lift, z in ((10, 1.5, 5.0), (5, 1.2, 2.0)):
        got = {tuple(r.tokens): (r.n, r.n_bad) for r in url_rules.mine(df, count, lift, z).collect()}
        assert got == brute_rules([(r[1], r[2]) for r in rows], count, lift, z) and got
    index = url_rules.mine(df)
    urls = [f"http://{rng.choice(['t1', 't2', 'q'])}.t1x.net/{rng.choice(['t4', 't5', 'z'])}/{rng.choice(['t4', 't5'])}?{i}" for i in range(60)]
    listed = spark.createDataFrame([(["host=net", "host=t1"], "host=t1"), (["path=t4", "path=t5"], "path=t5")], "tokens array<string>, anchor string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    hit = lambda u: "//t1." in u or "/t4/" in u and "/t5?" in u or "/t5/" in u and "/t4?" in u
    assert sorted(r.page_id for r in url_rules.matched(pages, listed).collect()) == [i for i, u in enumerate(urls) if hit(u)]
    assert index.columns == [c.split()[0] for c in url_rules.RULE.split(", ")]
    none = url_rules.mine(df.limit(0))
    assert none.schema == index.schema or [f.dataType for f in none.schema] == [f.dataType for f in index.schema]
