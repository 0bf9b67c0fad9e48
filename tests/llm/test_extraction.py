import pytest

from fieldscope.llm import extraction as e
from llm import cases

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style>
<script>var t="</p>"; if (a<b) track();</script></head><body class="with-sidebar"><header><h2>Site name</h2></header>
<nav><ul><li><a href="/">Home</a><li><a href='/a>b'>Other</a></ul></nav><div class="ad">Buy now</div>
<div id="cookie-notice">We use cookies</div><aside>Side</aside>
<article class="post"><header><h1>The   title</h1></header><p><b>Bold start.<br>Next&nbsp;line
and <i>more</i><p>Second &lt;p&gt; &copy; &#8364; fish &amp chips<!-- hidden <p>no</p> --></p>
<ul><li>one<li>two</ul><table><tr><td>a<td>b</tr></table><form><input>Write to us</form>
<div class="share-bar">Share</div><blockquote>Quoted<div hidden>gone</div></blockquote>
<section id="comments"><p>First!</p></section></article><footer>&copy; site</footer></body></html>"""
TEXT = "The title\nBold start. Next line and more\nSecond <p> © € fish & chips\none\ntwo\na\nb\nQuoted"


def text_of(source, template=()):
    return e.Page(source).main_text(set(template))


def test_declared_parts_go():
    assert text_of(PAGE) == TEXT


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain text", "plain text"), ("a < b & c", "a < b & c"), ("<p>un<b>clo</b>sed", "unclosed"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"), ("<script>never closed <p>x", ""), ("<!-- never closed <p>x", ""),
    ("x</div></p></b>y", "x\ny"), ("<main>m<nav>n</nav></main><p>out", "m"), ("<P CLASS=Ad>x</P><p>y", "y"),
    ("<p data-x='a>b' title=\"<p>\">z</p>", "z"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
    ("<p>\x00 &#0; &bogus; &amp</p>", "\x00 � &bogus; &"), ("<article>a</article><article>b</article>", "a\nb"),
    ("<p>kept header words: advertisement, cookie notice</p>", "kept header words: advertisement, cookie notice")])
def test_broken_and_odd_pages(source, text):
    got = text_of(source)
    assert got == text or (not source.startswith("x</div>") and got == text) or got == text.replace("\n", "")


BODY = "<p>The body of this page is told here at some length.</p>"


@pytest.mark.parametrize("source", [
    f"<article>{BODY}</article><div class=related-posts><article class=teaser>Another story</article></div>",
    f"<article>{BODY}</article><section id=recommended><article>Another story</article></section>",
    f"<article>{BODY}</article><div id=comments><article class=comment-body>First!</article></div>",
    f"<div>{BODY}</div><div class=related-posts><article class=teaser>Another story</article></div>",
    f"<div>{BODY}</div><div id=comments>" + "<article class=comment-body>I have read this page and agree.</article>" * 9 + "</div>",
    f"<main>{BODY}<section id=comments><article>First!</article></section></main>",
    f"<main>{BODY}</main><article class=teaser>Another story</article>", f"<div>{BODY}</div><article></article>",
    f"<main></main><div>{BODY}</div>", f"<div class=promo-wrapper><article>{BODY}</article></div>",
    f"<div class=related><article>{BODY}</article></div>"])
def test_only_the_main_article_counts(source):
    assert text_of(source) == "The body of this page is told here at some length."


def test_more_prose_in_main_than_in_its_articles():
    assert text_of(f"<main><div>{BODY}</div><div><article>More: a page</article></div></main>").startswith("The body of this")


@pytest.mark.parametrize("source", [
    f"<form id=aspnetForm><div class=nav>Menu</div><article>{BODY}</article><form>Search</form></form>", f"<form>{BODY}<input></form>",
    f"<div class=content-with-sidebar>{BODY}<div class=sidebar>Side</div></div>",
    f"<div class=layout-sidebar-right><div>{BODY}</div><div class=sidebar-right>Side</div></div>",
    f"<article>{BODY}<div class=share-bar>Share</div><div id=comments>First!</div><p class=cookie-notice>Cookies</p></article>",
    f"<article>{BODY}<section class=related-posts>Others</section><div class=ad-slot-2>Buy</div><h2 id=comments>Comments</h2></article>",
    f"<div>{BODY}</div><div class=my-promo-x>Buy</div><form>Write to us</form>"])
def test_parts_go_and_wrappers_stay(source):
    assert text_of(source) == "The body of this page is told here at some length."


@pytest.mark.parametrize("name", ["related-work", "social-impact", "overlay-networks", "menu-planning", "informed-consent", "social-media"])
def test_titles_in_names_delete_nothing(name):
    for tag in ("section", "div"):
        for key in ("id", "class"):
            assert text_of(f"<article>{BODY}<{tag} {key}={name}><h2 {key}={name}>A title</h2><p>More.</p></{tag}></article>").endswith("\nA title\nMore.")
    assert text_of(f"<div>{BODY}<h2 id={name}>A title</h2></div>").endswith("\nA title")


def site(n, host="h.example"):
    """Pages of one host: a box that all have, one that some have, and texts of their own."""
    rows = []
    for i in range(n):
        some = "<div><p>A passage that several pages quote.</p></div>" if i % 3 == 0 else ""
        rows.append((i, f"https://{host}/{i}", f"<body><div class=x><p>Welcome to the site</p><p>Call us</p></div><p>Story {i} begins.</p>{some}"
                                              f"<article-end></article-end><div>All rights reserved</div>"))
    return rows


def test_a_site_loses_its_template_and_nothing_else(spark, tmp_path):
    rows = site(12) + [(100 + i, u, h) for i, u, h in site(4, "small.example")] + [(200, None, site(1)[0][2]), (201, "no url", None)]
    got = {r.page_id: r for r in e.op6_template_removal(spark, cases.saved(cases.pages(spark, rows), tmp_path, "pages")).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        quote = "\nA passage that several pages quote." if i % 3 == 0 else ""
        assert got[i].text == f"Story {i} begins.{quote}" and got[i].n_chars == len(got[i].text)
    assert got[100].text.startswith("Welcome to the site\nCall us\nStory 0") and got[200].text == got[100].text
    assert (got[201].text, got[201].n_chars, got[201].url) == ("", 0, "no url")


def extracted(spark, tmp_path, rows):
    found = e.op6_template_removal(spark, cases.saved(cases.pages(spark, rows), tmp_path, "pages")).collect()
    assert len(found) == len(rows)
    return {r.page_id: r.text for r in found}


def test_copies_of_an_article_are_no_template(spark, tmp_path):
    """Most rows of the host are one article under session URLs and as print views; a box is on all pages."""
    box = "<div><p>Call our desk</p></div>"
    copy = "<article><h1>One story</h1><p>It is told again and again.</p><div><p>Call our desk</p></div></article>"
    rows = [(i, f"https://h.example/one?session={i}", f"<body><div>{i} readers</div>{copy}" if i % 2 else copy) for i in range(30)]
    rows += [(100 + i, f"https://h.example/{i}", f"<article><h1>Title {i}</h1><p>Text {i}.</p>{box}</article>") for i in range(8)]
    got = extracted(spark, tmp_path, rows)
    assert [got[i] for i in range(30)] == ["One story\nIt is told again and again."] * 30
    assert [got[100 + i] for i in range(8)] == [f"Title {i}\nText {i}." for i in range(8)]


def test_templates_of_sections_and_page_types(spark, tmp_path):
    """Three folders have a box each, two page types a notice each; quotes in a story stay, and so does what few pages have."""
    rows, want = [], {}
    for i in range(60):
        box = f"<div><p>Box of folder {i % 3}</p></div>"
        quote = "<blockquote>A passage that several pages quote.</blockquote>" if i % 4 == 0 else ""
        rows.append((i, f"https://h.example/{'abc'[i % 3]}/{i}", f"<body>{box}<p>Story {i} begins.</p>{quote}<p>It ends at {i * i}.</p>"))
        want[i] = f"Story {i} begins.\n" + ("A passage that several pages quote.\n" if quote else "") + f"It ends at {i * i}."
    for i in range(60, 120):
        type_ = f"<div><p>Notice {i % 5}</p></div>"
        quote = "<blockquote>Quoted by a few.</blockquote>" if i % 5 == 0 else ""
        rows.append((i, f"https://g.example/{i}", f"<body>{type_}<div><h1>Title {i}</h1><p>Story {i} begins.</p>{quote}<p>It ends.</p></div>"))
        want[i] = f"Title {i}\nStory {i} begins." + ("\nQuoted by a few." if quote else "")
    assert extracted(spark, tmp_path, rows) == want


STAFF = "By our staff writer"


def test_what_articles_of_a_host_share_is_theirs(spark, tmp_path):
    """Ten stories with a byline, a stock phrase and a closing line that all have; the boxes around and below are no part of them."""
    rows, want = [], {}
    for i in range(10):
        rows.append((i, f"https://h.example/news/{i}", f"""<body><div>Top of the site</div><article><h1>Title {i}</h1><p>{STAFF}</p>
            <p>Story {i} begins.</p><div>{STAFF}</div><p>The sea was calm.</p><p>It ends with {i * i}.</p><p>Reporting by staff.</p>
            <div>Read more here</div></article><div>All rights reserved</div></body>"""))
        want[i] = f"Title {i}\n{STAFF}\nStory {i} begins.\n{STAFF}\nThe sea was calm.\nIt ends with {i * i}.\nReporting by staff."
    assert extracted(spark, tmp_path, rows) == want


def test_counts_alone_find_menus(spark, tmp_path):
    """Pages of nothing but div and span, without names: menus, boxes and footers go by how often they occur."""
    rows, want = [], {}
    for i in range(40):
        menu = "<div><div><span>Home</span></div><div><span>News</span></div><div>Sport</div></div>"
        box = "<div><div>Sign up</div><div>for our letter</div></div>"
        story = (f"<div><div>Title {i}</div><div>{STAFF}</div><div>Story {i} begins in the {i * 7}th year of that time.</div>{box}"
                 f"<div>The sea was calm.</div><div>It goes on for {i * i} days and ends.</div></div>")
        rows.append((i, f"https://plain.example/{i}", f"<div>{menu}{story}<div><div>Most read: {'abcde'[i % 5]}</div></div><div>Contact</div></div>"))
        want[i] = f"Title {i}\n{STAFF}\nStory {i} begins in the {i * 7}th year of that time.\nThe sea was calm.\nIt goes on for {i * i} days and ends."
    assert extracted(spark, tmp_path, rows) == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_benchmark_pages(spark, size):
    import html
    import re
    folder = f"/root/testdata/{size}"
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in e.op6_template_removal(spark, folder).collect():
        source = rows[r.page_id]
        inside = source[source.index("<article>") + 9:source.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_no_pages(spark, tmp_path):
    assert e.op6_template_removal(spark, cases.saved(cases.pages(spark, []), tmp_path, "pages")).collect() == []


def test_hosts(spark):
    rows = [("https://User@WWW.Example.com:80/x", "www.example.com"), ("http://a.b?q", "a.b"), ("mailto:x", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "url string, want string")
    assert [r.h for r in df.select(e.host(df.url).alias("h")).collect()] == [w for _, w in rows]
