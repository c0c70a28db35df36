"""Wrapper induction: matching against a plain recursion, hosts whose articles are known, and pages that are broken."""

import random

import pytest

from loglattice.llm import dom, wrapper


def naive(a, b):
    """Simple tree matching as published: the largest order-keeping matching, by plain recursion."""
    if a.label != b.label:
        return 0
    x, y = (wrapper._kids(n) if isinstance(n, dom.Node) else [] for n in (a, b))
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + naive(x[i - 1], y[j - 1]))
    return 1 + m[-1][-1]


def some_tree(r, depth=0):
    tag = r.choice(["div", "p", "ul", "b"] if depth < 4 else ["p"])
    return f"<{tag}>" + "".join(some_tree(r, depth + 1) if depth < 4 and r.random() < 0.6 else r.choice(["one ", "two ", "&nbsp;"]) for _ in range(r.randrange(4))) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(30))
def test_matching_equals_the_plain_recursion(seed):
    r = random.Random(seed)
    a, b = (dom.parse("".join(some_tree(r) for _ in range(3))) for _ in range(2))
    m = wrapper.Matcher()
    m.know(a)
    m.know(b)
    pairs = list(m.align(a, b))
    assert m.score(a, b) == naive(a, b) == len(pairs)
    assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) and all(x.label == y.label for x, y in pairs)


def bare(k, r):
    """A page without an element or a name that would tell what its parts are, and its article."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    parts = [" ".join(word() for _ in range(r.randrange(5, 30))) for _ in range(r.randrange(1, 7))]
    title = f"Title {k}"
    promo = "<p>Get our <i>letter</i> every day</p>"
    at = r.randrange(len(parts) + 1)
    body = [f"<p>{p}</p>" for p in parts]
    body.insert(at, promo)
    links = "".join(f"<a href=/{word()}>{word()}</a> " for _ in range(5))
    page = f"<html><body><div><a href=/>Home</a> <a href=/x>Topics</a></div><div>The Daily {chr(233)}cho &mdash; since 1901</div><div><h2>{title}</h2>{''.join(body)}</div><div>{links}</div><div>All rights are ours</div></body></html>"
    return page, " ".join([title, *parts])


def test_a_host_without_any_names_gives_its_articles(spark):
    r = random.Random(2)
    made = {k: bare(k, r) for k in range(60)}
    rows = [(k, f"https://plain.example.org/{k}", p, "x") for k, (p, _) in made.items()]
    # Another host with the same frame but two pages is too small for a wrapper, and keeps all.
    small = bare(100, r)
    rows += [(100, "http://small.example.org/1", small[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = {x.page_id: x.text for x in wrapper.extract_pages(df).collect()}
    assert {k: got[k] for k in made} == {k: t for k, (_, t) in made.items()}
    assert "Get our letter every day" in got[100] and "All rights are ours" in got[100]


def test_joined_by_salt_or_broadcast_gives_the_same(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, f"https://host{k % 3}.example.org/{k}", bare(k, r)[0]) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    one = {tuple(x) for x in wrapper.extract_pages(df).collect()}
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(wrapper, "PART_PAGES", 10)
    assert {tuple(x) for x in wrapper.extract_pages(df).collect()} == one and len(one) == 90


def test_an_article_copied_over_a_host_is_not_its_template(spark):
    frame = "<body><div>Our paper</div><div><p>{}</p><p>{}</p></div></body>"
    said = "the same long story told on every page"
    rows = [(k, "http://c.example/", frame.format("Story", said)) for k in range(30)] + [(100 + k, "http://c.example/", frame.format(f"Other {k}", f"text {k} of its own")) for k in range(8)]
    got = {x.page_id: x.text for x in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story " + said and got[101] == "Other 1 text 1 of its own"


FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><a>m</a></nav><div class="cookie-notice">We use cookies <button>ok</button></div>
<main><div class="ad-slot">Buy</div><article class="post"><header><h1>Head &amp; tail</h1></header><p>One<b>two</b> three<br>four
 five&nbsp;&#233;<p>Six <a href='x>y'>seven</a><!-- no <p> --><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form><input><label>mail</label></form>
<aside>side</aside><div id="share-box">Share!</div></article><section id="comments"><article class="comment"><p>A reader's long comment that says more than the article ever does, on and on and on.</p></article></section></main>
<div class="sidebar"><p>More</p></div><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (FULL, "Head & tail Onetwo three four five é Six seven a b c d"),
        ("", ""), ("   ", ""), ("just text &lt; more", "just text < more"), ("<p>cut off <b>here</b> <a hre", "cut off here"),
        ("<div>a<script>x</div><p>never closed", "a"), ("<p>1</p>2<p>3", "1 2 3"), ("a < b and c > d", "a < b and c > d"), ("</div></p><p>x</p></article>", "x"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<article><p>x <b>y</article><p>out", "x y"), ("<body><form><div><h1>t</h1><p>in a form</p></div></form>", "t in a form"),
    ],
)
def test_pages_as_they_come(page, text):
    assert wrapper.page_text(dom.parse(page)) == text


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for piece in ("<!", "<a =\"", "<a '", "<", "<p>", "&", "<b>x", "<li>", "</", "<script", "<td><tr>"):
        wrapper.page_text(dom.parse(piece * 20_000))
        wrapper.page_text(dom.parse(piece * 20_000 + ">"))
    assert time.time() - began < 30


def test_nulls_repeated_rows_odd_urls_and_an_empty_table(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "::not a url::", "<p>b"), (2, "http://h.example", None), (3, "", ""), (4, "http://h.example", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame([(*x, "h", 1) for x in rows], "page_id long, url string, html string, host string, seeds int")
    got = sorted(map(tuple, wrapper.extract_pages(df).collect()), key=str)
    want = [(k, u, t, len(t)) for (k, u, _), t in zip(rows, ["a", "a", "b", "", "", ("long " * 200_000).strip()])]
    assert got == sorted(want, key=str)
    assert wrapper.extract_pages(df.limit(0)).count() == 0
