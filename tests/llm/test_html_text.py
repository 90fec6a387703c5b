import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from usemeter.llm import html_text, large_hosts
from usemeter.llm.html_text import extract_main_text, main_texts, parse, repeated_tokens

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x>y">Menu</a></ul></nav><!-- <p>no --><div class="cookie-notice">We use</div>
<main><article><h1>Title &amp; more</h1><p>One<b> bold</b>
 text<br>line<p class=ad>Buy<p>Two &lt;b&gt; &#233;<ul><li>item</li></ul><form><p>Name</p></form>
<section id="comments"><article><p>Great post</p></article></section><p>Last</article></main>
<aside>Side</aside><div class="sidebar"><div>x</div></div><footer>&copy; us</footer></body></html>"""


def test_markup_decides():
    assert main_texts([parse(PAGE)]) == ["Title & more One bold text line Two <b> é item Last"]


def test_repeats_go_where_markup_is_silent():
    same = "<div>home about contact login shop cart help faq terms privacy</div>"
    pages = [parse(f"<body>{same}<div>text{i} only{i} here{i} and{i}</div></body>") for i in range(3)]
    assert main_texts(pages) == [f"text{i} only{i} here{i} and{i}" for i in range(3)]
    assert "home" in main_texts(pages[:2])[0]  # on two pages only: no boilerplate
    copies = [parse(f"<article><p>{same}</p></article>") for _ in range(5)]
    assert all(t.startswith("home") for t in main_texts(copies))  # marked as the article


def test_repeated_tokens_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        pages = [rng.integers(1, 4, rng.integers(0, 25)).astype(np.uint64) for _ in range(6)]
        k, least = int(rng.integers(1, 6)), int(rng.integers(2, 4))
        on = Counter(g for p in pages for g in {tuple(p[i : i + k]) for i in range(len(p) - k + 1)})
        for p, got in zip(pages, repeated_tokens(pages, k, least)):
            want = np.zeros(len(p), bool)
            for i in range(len(p) - k + 1):
                if on[tuple(p[i : i + k])] >= least:
                    want[i : i + k] = True
            assert got.tolist() == want.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-=\"' abpdiv&;x\n", max_size=120))
def test_broken_markup_never_fails(html):
    for block in parse(html).blocks:
        assert block == " ".join(block.split()) != ""


def test_unclosed_quotes_take_linear_time():
    assert parse("<a href='" * 20_000 + "<div class=\"" * 20_000) is not None


def test_table(spark):
    rows = [(1, "http://A.example/x", PAGE), (2, None, None), (3, "not a url", ""), (4, "https://u@a.example:80/", "<p>plain</p>"), (4, "https://u@a.example:80/", "<p>plain</p>"), (None, "http://b.example", "<p>x<br>y</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as shard", "2 as n")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(df).collect())
    assert got == Counter([
        (1, "http://A.example/x", main_texts([parse(PAGE)])[0], len(main_texts([parse(PAGE)])[0])), (2, None, "", 0), (3, "not a url", "", 0),
        (4, "https://u@a.example:80/", "plain", 5), (4, "https://u@a.example:80/", "plain", 5), (None, "http://b.example", "x y", 3),
    ])
    assert extract_main_text(df.limit(0)).count() == 0


def test_names_are_matched_whole_and_never_take_the_body():
    body = "<h1>Title</h1><p>Body of the page in several words.</p>"
    text = "Title Body of the page in several words."
    for wrapper in ("<div class='content no-sidebar'>{}</div>", "<main class='has-sidebar'>{}</main>", "<article class='post no-comments'>{}</article>",
                    "<div data-id='share-1'>{}</div>", "<div title='x class=ad' class=post>{}</div>", "<div class='with-menu layout--sidebar'>{}</div>",
                    "<div class='widget'><article>{}</article></div>", "<div class='left-sidebar'><main class='social'>{}</main></div>",
                    "<div class='search'><div class='login'>{}</div></div>", "<article><div class='widget'>{}</div></article>", "<div class=ad><section>{}"):
        assert main_texts([parse(f"<nav>Menu</nav>{wrapper.format(body)}<footer>Us</footer>")]) == [text], wrapper
    for name in ("sidebar", "left-sidebar", "post__share-buttons", "ad_300", "cookie-notice", "x comments"):
        for dropped in (f"<div class='{name}'>Buy <div>now</div></div>", f"<p id={name.split()[-1]}>Buy now", f"<aside><div class='{name}'>Buy</div></aside>"):
            assert main_texts([parse(f"<div>{body}{dropped}<p>End</div>")]) == [text + " End"], (name, dropped)
    talk = "<p>Reply that is longer than the whole page.</p>" * 2
    assert main_texts([parse(f"<article>{body}<div class=comments><article>{talk}</article></div></article>")]) == [text]
    assert main_texts([parse(f"<article>{body}</article><div class=comments><article>{talk}</article></div>")]) == [text]
    assert main_texts([parse(f"One <span class=ad>buy <i>now</i></span>two <div class=ad>{'<nav>' * 3}</div><p>three")]) == ["One two three"]


def test_copies_are_one_content_and_blocks_go_whole():
    rnd = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rnd.integers(0, 10**9, n))
    menu, body, quote = text(12), text(300), text(9)
    page = lambda *blocks: parse("".join(f"<div>{b}</div>" for b in blocks))
    copies = [page(menu, body)] * 3 + [page(menu, body, f"printed on day {i}") for i in range(40)]
    others = [page(menu, f"{text(20)} {quote} {text(20)}") for _ in range(3)]
    got = main_texts(copies[:3] + copies[3:])
    assert all(t.startswith(f"{menu} {body}") for t in got)  # one content: nothing shows that the menu is one
    got = main_texts(copies + others)
    assert got[:3] == [body] * 3 and all(t.startswith(body) for t in got[3:43])
    assert got[43:] == [p.blocks[1] for p in others]  # the quoted words stay in mid-sentence


def test_repeats_go_inside_articles_and_teasers_are_no_main_part():
    rnd = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{i}" for i in rnd.integers(0, 10**9, n))
    advert, share, shared = text(15), text(8), text(10)
    bodies = [text(60) for _ in range(12)]
    html = [f"<article><p>{b}</p><div>{advert}</div>" + f"<p>{shared}</p>" * (i < 4) + f"<p>{share}</p></article>" for i, b in enumerate(bodies)]
    assert main_texts([parse(h) for h in html]) == [b + f" {shared}" * (i < 4) for i, b in enumerate(bodies)]
    assert main_texts([parse(html[0])]) == [f"{bodies[0]} {advert} {shared} {share}"]  # one page shows no repeats
    teaser = [f"<div>{advert}</div><div>{b}</div><article><p>{text(10)}</p></article>" for b in bodies]
    assert all(t.startswith(b) for t, b in zip(main_texts([parse(h) for h in teaser]), bodies))
    beside = [f"<article><p>{b}</p></article><div>{text(20)}</div><div>{advert * 9}</div>" for b in bodies]
    assert main_texts([parse(h) for h in beside]) == bodies


def random_words(seed):
    rnd = np.random.default_rng(seed)
    return lambda n, most=10**9: " ".join(f"w{i}" for i in rnd.integers(0, most, n))


def test_a_notice_goes_whatever_the_size_of_its_host(spark):
    """On four pages of a host of 6, and on four of one of 3,000."""
    text = random_words(7)
    notice, rows = text(12), []
    for host, pages in (("small", 6), ("large", 3000)):
        rows += [(len(rows) + i, f"http://{host}.example/{i}", f"<p>{notice * (i in {pages * k // 4 for k in range(4)})}</p><p>{text(20)}</p>") for i in range(pages)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(notice in h for _, _, h in rows) == 8
    assert all(got[i] == h.split("<p>")[2].removesuffix("</p>") for i, _, h in rows)


def test_a_host_in_shards_has_the_texts_of_a_host_in_one_task(spark, monkeypatch):
    text = random_words(8)
    rnd = np.random.default_rng(8)
    lines, bodies = [text(int(n)) for n in rnd.integers(1, 14, 12)], [text(int(n)) for n in rnd.integers(0, 120, 40)]
    rows = [(1, None, None), (2, "http://a.example", None), (None, "http://a.example", ""), (3, "http://a.example", "<p>x")]
    long = [text(300) for _ in range(3)]  # of near copies, with a line of their own and one or none of three pages more
    for i in range(400):
        blocks = [*rnd.choice(lines, int(rnd.integers(0, 4))), bodies[int(rnd.integers(40))], text(int(rnd.integers(0, 9)), 40)]
        if i % 10 == 1:
            blocks = [lines[i // 10 % 4], long[i // 10 % 3], f"day {i}"]
        html = "".join(f"<p>{b}</p>" for b in blocks)
        rows += [(i, f"http://{'ab'[i % 5 == 0]}.example/{i}", f"<article>{html}</article><p>{lines[0]}" if i % 3 else html)] * int(rnd.integers(1, 3))
    hosts = {}
    for page_id, url, html in rows:
        hosts.setdefault(url and url[7:16], []).append((page_id, url, parse(html or "")))
    want = Counter((p[0], p[1], t) for h, own in hosts.items() for p, t in zip(own, main_texts([p[2] for p in own], host=h or "")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = lambda: Counter((r.page_id, r.url, r.text) for r in extract_main_text(df).collect())
    assert texts() == want
    monkeypatch.setattr(html_text, "HOST_TOKENS", 100)
    for tokens, pages in ((1000, 10_000), (7000, 30), (10**6, 10)):
        monkeypatch.setattr(large_hosts, "SHARD_TOKENS", tokens)
        monkeypatch.setattr(large_hosts, "JUDGED_PAGES", pages)
        assert texts() == want, tokens
    near = [p[2] for p in hosts["a.example"]]
    back = main_texts(near[::-1], host="a.example")[::-1]
    assert back == main_texts(near, host="a.example")  # in any order


def test_pages_that_go_the_same_way_take_less_together(monkeypatch):
    text = random_words(9)
    menu = f"<div>{text(40)}</div>"
    pages = [parse(f"{menu}<p>{text(60, 2000)}</p><article>é <p>x&#30;y\x1e z</article>") for _ in range(400)] + [parse(""), parse("<p>\u2028")]
    rows = [(i if i % 7 else None, f"u\x1e\n{i}" if i % 5 else None) for i in range(len(pages))]
    alone = sum(len(zlib.compress("\n".join(p.blocks).encode(), 1)) for p in pages)
    for held, package in ((10**9, 100_000), (20_000, 10**9), (1, 1)):
        monkeypatch.setattr(html_text, "HELD_CHARS", held)
        monkeypatch.setattr(html_text, "PACKAGE_CHARS", package)
        keeper = html_text.Packages()
        out = [x for r, p in zip(rows, pages) for x in keeper.add((f"h{r[0] is None}", 1), r, p)] + list(keeper.rest())
        assert not list(keeper.rest()) and {x[1] for x in out} == {1}
        back = [(*r, p.blocks, p.main, host) for host, _, data in out for r, p in html_text.unpacked(data)]
        assert sorted(map(str, back)) == sorted(str((*r, p.blocks, p.main, f"h{r[0] is None}")) for r, p in zip(rows, pages))
        assert held == 1 or sum(len(x[2]) for x in out) < 0.8 * alone
