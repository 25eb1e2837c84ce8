import json
import random

from tidemark.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style>
<script>var a = "</p><article>no</article>";</script></head><body>
<nav><ul>{menu}</ul></nav><!-- <p>hidden</p> --><div class="ad">buy <b>now</b></div>
<article><h1>Head &amp; line</h1>{body}</article>
<aside>side</aside><div id="comments"><p>first!</p></div><footer>&copy; me</footer></body></html>"""


def page(n_menu, paragraphs, extra=""):
    menu = "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(n_menu))
    return PAGE.format(menu=menu, body="".join(f"<p>{p}</p>" for p in paragraphs) + extra)


def test_main_text():
    html = page(3, ["one  <b>two</b>\n three", "a &lt; b<br>next", "  "],
                "<div class='share-bar share'>share me</div><form>f</form><ul><li>x<li>y</ul>"
                "<section class=comment>no</section>")
    assert w.main_text(html, None) == "Head & line\none two three\na < b\nnext\nx\ny"
    assert w.main_text(None, None) == w.main_text("", None) == ""
    assert w.main_text("just text", None) == "just text"
    assert w.main_text("<p>open <p>tags<script>x", None) == "open\ntags"
    assert w.main_text("<div class=ad>x<article>real</article>", None) == "real"
    assert w.main_text("a < b &amp; c <", None) == "a < b & c <"


def test_marked_text_block_ends():
    def text(body):
        return w.main_text(f"<p>outside</p><article>{body}</article>", None)

    assert text("<p class=share>x</p><p>body</p><ul><li>y</ul>tail") == "body\ny\ntail"
    assert text("<p class=share>x<p>body") == "body"
    assert text("<h2 class=related>x</h2>body") == "body"
    assert text("<h2 class=related>x<p>body</p>") == "body"
    assert text("<ul><li class=share>x<ul><li>y</li></ul>z<li>body</ul>") == "body"
    assert text("<ul><li class=share>x<p>y</ul>body") == "body"
    assert text("<blockquote class=notice>x<blockquote><p>y</p></blockquote>z</blockquote>b") == "b"
    assert text("<table><tr><td class=ad>x<table><tr><td>y</table>z<td>b<tr class=ad><td>x"
                "<tr><td>c</table>") == "b\nc"
    assert text("<dl><dt class=ad>x<dd>body</dl>") == "body"
    assert text("<p class=share>x<hr>body") == "body"
    assert text("<li><p class=share>x</li>body") == "body"
    assert text("<p>a</p><div class=ad><p>x</p>y</div><p>b</p>") == "a\nb"


def test_raw_names_are_whole():
    def text(body):
        return w.main_text(f"<article>{body}</article>", None)

    assert text("<svg-icon></svg-icon><p>a</p><svg><text>x</text></svg><p>b") == "a\nb"
    assert text("<video-player>a</video-player><title-bar>b</title-bar><p>c<video>x</video>") == "a\nb\nc"
    assert text("<p>a</p><svg width='1'/><p>b</p><svg>x</svg><math/>c<svg />d") == "a\nb\ncd"


def test_wrapper_groups():
    one, two = (w.fold(w.stream(page(k, ["x"] * m))[0]) for k, m in ((2, 3), (5, 1)))
    wrapper = w.align(one, two)
    assert ("+", ("li", "#nav")) in wrapper and ("+", ("#article", "p")) in wrapper
    more = w.align(wrapper, w.fold(w.stream(page(0, ["x"], "<blockquote>q</blockquote>"))[0]))
    assert ("?", ("blockquote", "#article")) in more or any(
        x[0] == "?" and "blockquote" in x[1] for x in more if isinstance(x, tuple))


def test_wrapper_reads_all_it_was_made_of():
    r = random.Random(4)
    tags = ["p", "#", "div", "/div", "li", "h2", "article", "/article"]
    for _ in range(300):
        streams = []
        base = [r.choice(tags) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(1, 6)):
            s = []
            for t in base:
                for _ in range(r.choice([1, 1, 1, 0, 2, 3])):
                    s.append(t)
                if r.random() < 0.1:
                    s.append(r.choice(tags))
            s = [t for i, t in enumerate(s) if not (t == "#" and i and s[i - 1] == "#")]
            streams.append(tuple(s))
        parts = [w.fold(s) for s in streams]
        wrapper = ()
        for n, p in enumerate(parts):
            wrapper = p if not n else w.align(wrapper, p)
        wrapper = w._load(json.loads(json.dumps(wrapper)))
        for s in streams:
            got = w.Automaton(wrapper).read(s)
            assert got is not None and len(got) == sum(t[0] == "#" for t in s), (streams, wrapper, s)


def test_rows(spark):
    rows = [(i, f"http://{'hot' if i % 3 else 'h%d' % i}.example.com/{i}",
             page(i % 4, [f"text {i}"] * (1 + i % 5))) for i in range(40)]
    rows += [(50, None, page(1, ["no url"])), (51, "http://hot.example.com", None), (52, "x", ""),
             (None, "http://hot.example.com", page(1, ["no id"])), rows[0], rows[1],
             (53, "http://hot.example.com", "x " * 200_000)]
    df = spark.createDataFrame([(*r, "k", "h") for r in rows],
                               "page_id long, url string, html string, text string, host string")
    got = sorted((tuple(r) for r in w.extract(df.repartition(4)).collect()), key=str)
    want = []
    for i, u, h in rows:
        text = w.main_text(h, None)
        want.append((i, u, text))
        if h and "Head" in h:
            assert text.startswith("Head & line\n")
    assert got == sorted(want, key=str)
    assert w.extract(df.limit(0)).count() == 0


def test_unmarked_constants(spark):
    def plain(i, note):
        """A page without an article, and without a word that marks boilerplate."""
        return (f"<div><p>{'Read on' if i == 3 else f'intro {i}'}</p></div><section><p>text {i}</p>"
                + "".join(f"<p>more {i} {n}</p>" for n in range(i % 3))
                + f"</section><div><div><p>{note}</p></div></div>")

    rows = [(i, f"http://a.example.com/{i}", plain(i, "Read on")) for i in range(12)]
    # the same text at the same place, but on two pages only
    rows += [(100 + i, f"http://b.example.com/{i}", plain(i, "Read on")) for i in (0, 1)]
    # a note that most pages do not share
    rows += [(200 + i, f"http://c.example.com/{i}", plain(i, "Read on" if i < 5 else f"note {i}"))
             for i in range(4, 16) for _ in range(2)]
    # copies of one page share everything
    rows += [(300 + i, f"http://d.example.com/{i}", plain(1, "Read on")) for i in range(6)]
    # among the repeated paragraphs of an article; its title stays
    rows += [(400 + i, f"http://e.example.com/{i}", "<article><h1>News</h1>" + "".join(
        f"<p>text {i} {n}</p>" for n in range(1 + i % 4)) + "<p>Ask us for more</p></article>")
             for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted((r.page_id, r.text) for r in w.extract(df).collect())
    want = []
    for i, u, h in rows:
        text = w.main_text(h, None).split("\n")
        if "//a." in u:
            assert text[-1] == "Read on"
            text.pop()
        if "//e." in u:
            text.remove("Ask us for more")
            assert text[0] == "News"
        want.append((i, "\n".join(text)))
    assert got == sorted(want)


def test_misleading_class_words():
    """Names that only hold a mark among words of a subject mark nothing."""
    text = lambda html: w.main_text(html, None)
    for tag in ('<div class="article-body social-issues">', '<div class="post related-topic">', '<p id="search">',
                '<div role="main" class="comment-free">', '<div class="banner-less">', '<section id="share-prices">',
                '<h2 id="comments">', '<div class="shareholder news">', "<div data-class='ad'>"):
        end = f"</{tag[1:].split()[0]}>"
        assert text(f"<article>{tag}body text{end}</article>") == "body text", tag
        assert text(f"{tag}body text{end}<p>more</p>") == "body text\nmore", tag
    for tag in ('<div class="ad-box-top">', '<div class="shareBar">', '<div id="comments">', '<div class="x ad-2">',
                '<ul class="related-posts">', '<div role="search">', '<div class="cookie_banner">'):
        end = f"</{tag[1:].split()[0]}>"
        assert text(f"<article>{tag}other{end}<p>body</p></article>") == "body", tag
    assert text('<main class="comments">x</main><article class="comment-box">y</article><p>body</p>') == "body"
    assert text('<article class="sidebar">body</article>') == "body"
