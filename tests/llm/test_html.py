import numpy as np
import pandas as pd

from parlance.llm import html_text
from parlance.llm.html_text import ARTICLE, blocks_of, extract_group, extract_text, repeated_tokens, suffix_order

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav><!-- <article> no --><div class="ad">Buy &lt;now&gt;</div>
<article><h1>The  &eacute;t&#233;&nbsp;title</h1><p>First <b>bold<i> text</b> 1 &lt; 2 &amp 3 &am<br>line</p><p class="notice">Notice</p><p>Second
para</p><aside>Side</aside><form><p>Your mail</p><input name=a></form><ul><li>one</li><li>two</li></ul></div><script>x()</script>
<table><tr><td>a</td><td>b</td></tr></table><div id="comments"><article class="comment"><p>Me too</p></article></div>tail</article>
<div class="sidebar widget">S</div><section class="cookie-notice">C</section><footer>&copy; F</footer></body></html>"""


def test_blocks_of_an_article():
    assert [t for role, t in blocks_of(PAGE) if role == ARTICLE] == [
        "The été title", "First bold text 1 < 2 & 3 &am line", "Second para", "one", "two", "a", "b", "tail"]


def test_broken_pages():
    for page, want in [
        ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<article><p>a", ["a"]), ("a <!-- b", ["a"]), ("<script>a", []),
        ("<p title='x>y'>a</p>", ["a"]), ("1 < 2 <", ["1 < 2 <"]), ("<form><article>a</article></form>", ["a"]), ("<p title=\"x>a</p>", []),
        ("<nav>m<article>a</article>", ["a"]), ("<aside><article>a</article></aside>", []),
    ]:
        got = [t for role, t in blocks_of(page) if role != -1]
        assert got == want or (page.startswith('<p title="') and len(got) <= 1), page


def test_names_that_only_resemble_roles_are_text():
    inside = ['<p class="social-science">A</p>', '<p class="share-price">A</p>', '<ul class="menu-items"><li>A</li></ul>', '<section class="ads-history">A</section>',
              '<div class="header-image"><p>A</p></div>', '<div class="header"><p>A</p></div>', '<p id="commentary">A</p>', '<p class="related-work">A</p>', '<p class="x ">A</p>']
    for piece in inside:
        assert [t for role, t in blocks_of(f"<article><p>x</p>{piece}<p>y</p></article>") if role == ARTICLE] == ["x", "A", "y"], piece
    for piece in ('<p class="notice">A</p>', '<div class="share-bar"><p>A</p></div>', '<div id="Comments_2"><p>A</p></div>', '<ul class="menu"><li>A</li></ul>', "<div class='big ad'>A</div>",
                  '<section class="cookie-notice">A</section>', '<div role="navigation">A</div>', '<aside>A</aside>', '<div class="site_footer">A</div>'):
        assert [t for role, t in blocks_of(f"<article><p>x</p>{piece}<p>y</p></article>") if role == ARTICLE] == ["x", "y"], piece


def test_inline_elements_that_are_no_text():
    for piece, want in [
        ("a <button>Share</button> b", ["a b"]), ("a <label>Your <b>name</b></label>b", ["a b"]), ('a<span class="share">Tweet<span>!</span></span>b', ["a b"]),
        ('a <span class="ad">buy', ["a"]), ("a <span class='ad'><div>buy</div></span> b", ["a b"]), ("a <button>x<p>c", ["a", "c"]), ("a <i>b</i> c", ["a b c"]),
        ('a<button class="x"/>b', ["ab"]), ('a <a class="nav" href="/">up</a> b', ["a b"]),
    ]:
        page = f"<article><p>x</p><p>{piece}</p><p>y</p></article>"
        assert [t for role, t in blocks_of(page) if role == ARTICLE] == ["x", *want, "y"], piece
    assert [t for role, t in blocks_of("<label>m<article>a</article>") if role == ARTICLE] == ["a"]


def test_suffix_order():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3, 5, 6, 8):
        tokens = rng.integers(0, 3, 80)
        order, rank = suffix_order(tokens, depth)
        keys = [tuple(tokens[i:i + depth]) for i in range(80)]
        assert [keys[i] for i in order] == sorted(keys)
        assert all((rank[a] == rank[b]) == (keys[a] == keys[b]) for a in range(80) for b in range(a))


def test_repeats_on_distinct_pages_only():
    rng = np.random.default_rng(2)
    streams = [[str(x) for x in rng.integers(0, 3, n)] for n in (30, 0, 25, 40, 4)]
    pages = ["a", "b", "a", "c", "d"]
    for flags, stream, page in zip(repeated_tokens(streams, pages, 4), streams, pages, strict=True):
        want = set()
        for i in range(len(stream) - 3):
            if any(page != q and stream[i:i + 4] == s[j:j + 4] for s, q in zip(streams, pages, strict=True) for j in range(len(s) - 3)):
                want.update(range(i, i + 4))
        assert np.flatnonzero(flags).tolist() == sorted(want)


def test_work_of_a_group(monkeypatch):
    """Three sorts order a group's suffixes and count its runs' pages; end tags are looked for only where one is asked for."""
    rng = np.random.default_rng(3)
    streams = [[f"w{x}" for x in rng.integers(0, 5000, 300)] + ["Home", "News", "Sport", "Weather", "About", "us"] for _ in range(20)]
    sorts, hashed, closed = [], [], []

    def noted(kept, f):
        return lambda x, *a, **b: (kept.append(len(x)), f(x, *a, **b))[1]

    for name in ("sort", "argsort", "unique"):
        monkeypatch.setattr(np, name, noted(sorts, getattr(np, name)))
    monkeypatch.setattr(html_text, "closed_tags", noted(closed, html_text.closed_tags))
    flags = repeated_tokens(streams, list(range(20)))
    assert all(f.tolist() == [False] * 300 + [True] * 6 for f in flags)
    assert sum(n >= 20 * 306 for n in sorts) <= 3
    monkeypatch.setattr(pd.util, "hash_array", noted(hashed, pd.util.hash_array))
    html_text.run_counts([" ".join(s) for s in streams], list(range(20)), least=3)
    assert hashed == [6]
    blocks_of("<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><p>a <b>b</b></p></article>")
    assert not closed
    assert [t for _, t in blocks_of("<p>a <button>Share</button> b</p>")] == ["Share", "a b"] and len(closed) == 1


def test_runs_looked_for_hold_for_their_texts_only():
    texts = ["a b c d", "", "x a b c", "a b c", "c"]
    abc, bcd = (html_text.run_counts([t], [0], 3)[0] for t in ("a b c", "b c d"))
    flags = html_text.tokens_in(texts, [(2, bcd), (1, abc), (2, np.append(abc, bcd))], 3)
    assert [f.tolist() for f in flags] == [[False, True, True, True], [], [False, True, True, True], [True] * 3, [False]]
    found = html_text.runs_on_pages(texts, ["p", "q", "r", "r", "s"], [(2, bcd), (1, abc), (2, abc[:0])], 3)
    assert found[["_run", "_page"]].values.tolist() == [[bcd[0], "p"], [abc[0], "r"]]


def test_pages_without_an_article_keep_unique_runs():
    stories = ["Rain fell all day", "Nobody won today", "A cat came back home"]
    menu = "Home News Sport Weather Contact About us"
    pages = [f"<div>{menu}</div><div>{i}</div><div>All rights reserved by the site owner</div>" for i in stories]
    out = extract_group(pages, ["u1", "u2", "u3"])
    assert [t for t, _, _ in out] == stories
    assert out[0][2] == 14
    # Rows of one url are one page: nothing repeats.
    assert extract_group(pages[:1] * 2, ["u", "u"])[1][2] == 0


def test_blocks_go_only_as_a_whole():
    menu, foot = "Home News Sport Weather Contact About us", "All rights reserved by the site owner"
    body = "The river rose above the old bridge in the night and nobody was hurt"
    quote = "to the best of our knowledge"

    def page(*texts):
        return "".join(f"<div>{t}</div>" for t in (menu, *texts, foot))

    # Two urls with one story, a phrase inside paragraphs of every page, one story at all urls.
    stories = [[body, "Seen today"], [body, "Print version"], [f"Ann said {quote} that it rained", "A"], [f"Bob wrote {quote} nothing", "B"], [f"Cy read {quote} all", "C"]]
    assert [t for t, _, _ in extract_group([page(*s) for s in stories], list("abcde"))] == ["\n".join(s) for s in stories]
    assert [t for t, _, _ in extract_group([page(body)] * 4, list("abcd"))] == [f"{menu}\n{body}\n{foot}"] * 4
    # On a host of 40 pages, three pages with one paragraph are not many.
    stories = [[body if i < 3 else f"Story {i} of its own", f"Number {i}"] for i in range(40)]
    assert [t for t, _, _ in extract_group([page(*s) for s in stories], list(range(40)))] == ["\n".join(s) for s in stories]


def test_rows(spark):
    long = "<article>" + "<p>word " * 30_000 + "</article>"
    rows = [(1, "http://a.b/1", PAGE), (2, None, PAGE), (3, None, None), (4, "x", ""), (4, "x", ""), (None, "http://a.b/2", PAGE), (5, "http://a.b/3", long)]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], "page_id int, url string, html string, text string, n_chars int, _host string")
    for size in (1 << 22, 100):
        out = {(r["page_id"], r["url"]): r for r in extract_text(df, "page_id", "url", "html", group_bytes=size).collect()}
        assert len(out) == 6
        assert out[1, "http://a.b/1"]["text"] == out[2, None]["text"] == out[None, "http://a.b/2"]["text"]
        assert out[3, None]["text"] == "" and out[4, "x"]["n_chars"] == 0 and out[5, "http://a.b/3"]["text"].count("\n") == 29_999
    assert extract_text(df.limit(0), "page_id", "url", "html").count() == 0


def test_repeated_rows_of_one_url_count_once(spark):
    menu = "Home News Sport Weather Contact About us"
    rows = [(i, "http://a.b/same", f"<div>{menu}</div><p>Story</p>") for i in range(50)] + [(50 + i, "", f"<div>{menu}</div><p>Story {i}</p>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for size in (1 << 20, 1):
        got = {r["page_id"]: r["text"] for r in extract_text(df, "page_id", "url", "html", group_bytes=size).collect()}
        assert len(got) == 55 and all(t.startswith(menu) for t in got.values())


def test_repeats_are_of_the_whole_host(spark):
    menu, foot = "Home News Sport Weather Contact About us", "All rights reserved by the site owner"
    rare = "This paragraph stands on two pages of the host alone"
    pages = [f"<div>{menu}</div><p>Story {i} by {'Ann' if i % 2 else 'Bob'}</p>" + (f"<p>{rare}</p>" if i in (4, 50) else "") + f"<div>{foot}</div>" for i in range(60)]
    pages[7] = f"<nav>{menu}</nav><article><p>{rare}</p></article><div>{foot}</div>"
    pages[8] = f"<div>{menu}</div><div>{foot}</div>"
    urls = [None if i == 9 else f"http://a.b/{i}" for i in range(60)] + ["http://a.b/3"]
    pages.append(pages[3])
    other = [(100 + i, f"http://c.d/{i}", f"<div>{menu}</div><p>Story {i}</p>") for i in range(2)]
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(zip(urls, pages, strict=True))] + other, "page_id int, url string, html string")
    keep = [i for i in range(61) if i != 9]
    want = dict(zip(keep, extract_group([pages[i] for i in keep], [urls[i] for i in keep]), strict=True))
    assert want[4][0] == f"Story 4 by Bob\n{rare}" and want[7][0] == rare and want[8][0] == f"{menu}\n{foot}" and want[60] == ("Story 3 by Ann", 18, 14)
    want |= {9: ("\n".join([menu, "Story 9 by Ann", foot]), 18, 0)} | {100 + i: (f"{menu}\nStory {i}", 9, 0) for i in range(2)}
    for size in (1 << 20, 2000, 1):
        got = extract_text(df, "page_id", "url", "html", group_bytes=size).collect()
        assert len(got) == 63 and {r["page_id"]: (r["text"], r["n_tokens"], r["n_repeated"]) for r in got} == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_pages_with_an_article_are_compared_too(spark, monkeypatch):
    menu, foot = "Home News Sport Weather Contact About us", "All rights reserved by the site owner"
    common, own = "This line stands in the article of every page", "Nobody else says what is said here"
    pages = [f"<nav>{menu}</nav><article><p>Story {i}</p><p>{common}</p></article><aside>{own} {i}</aside><div>{foot}</div>" for i in range(45)]
    urls = [f"http://a.b/{i % 44}" for i in range(45)]
    want = extract_group(pages, urls)
    assert want[3] == (f"Story 3\n{common}", 33, 14)
    rows = [(i, u, p) for i, (u, p) in enumerate(zip(urls, pages, strict=True))] + [(45, "http://c.d/1", pages[0]), (46, None, pages[0]), (None, None, pages[0]), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for size in (1 << 20, 1500, 1):
        got = extract_text(df, "page_id", "url", "html", group_bytes=size).collect()
        assert len(got) == 49
        assert [(r["text"], r["n_tokens"], r["n_repeated"]) for r in sorted((r for r in got if r["page_id"] is not None), key=lambda r: r["page_id"])] == want + [(*want[0][:2], 0)] * 2
