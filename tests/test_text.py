import pytest
from pyspark.sql import functions as F

from fieldscope.functions import text
from fieldscope.functions.columns import collapse_space, is_blank, strip

def X():
    return F.col("x")


@pytest.mark.parametrize("raw, expected", [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>Tides  move <i>slowly</i>\n north.</p>", "Tides move slowly north."),
    ("&lt;p&gt;escaped&lt;/p&gt; markup", "escaped markup"),
    ("a &amp;lt; b", "a &lt; b"),                 # decoded once only
    ("AT&T &amp; co", "AT&T & co"),
    ("caf&eacute; &#233; &#xe9;", "café é é"),    # beyond the native entities
    ("fish &amp chips", "fish & chips"),          # unterminated
    ("a   b　\x1fc", "a b c"),      # unicode and control whitespace
    ("<style>p{margin:0}</style>kept", "p{margin:0} kept"),
    ("1 < 2 and 3", "1 < 2 and 3"),
    ("a\t", "a"),
])
def test_strip_html(one, raw, expected):
    assert one(text.strip_html(X()), "x string", raw) == expected


def test_strip_html_cuts_with_an_ellipsis(one):
    assert one(text.strip_html(X(), 5), "x string", "abcd efgh") == "abcd…"
    assert one(text.strip_html(X(), 4), "x string", "abcd") == "abcd"
    assert one(text.strip_html(X(), 1200), "x string", "é" * 1300) == "é" * 1200 + "…"
    assert one(text.strip_html(X()), "x string", "é" * 1300) == "é" * 1300


def test_strip_titled_html_drops_the_title_element(one):
    raw = "<JATS:title>Sum\nmary</jats:title><jats:p>Tides move <jats:italic>slowly</jats:italic> north.</jats:p>"
    assert one(text.strip_titled_html(X()), "x string", raw) == "Tides move slowly north."


def test_place_tokens_orders_repeated_tokens(one):
    index = {"the": [0, 3], "sea": [1, 4], "meets": [2]}
    assert one(text.place_tokens(X()), "x map<string,array<int>>", index) == "the sea meets the sea"
    assert one(text.place_tokens(X()), "x map<string,array<int>>", {"b": [1], "a": [1], "z": [0]}) == "z a b"
    assert one(text.place_tokens(X()), "x map<string,array<int>>", {}) == ""


@pytest.mark.parametrize("raw, expected", [
    ("  A \t Title Here ", "a title here"), ("", ""), (None, ""), ("ONE", "one")])
def test_title_key(one, raw, expected):
    assert one(text.title_key(X()), "x string", raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("a  b", "a b"), (" a", " a"), ("a \tb", "a b"), ("a\t b", "a b"), ("a\nb", "a b"), ("a b", "a b"),
    ("a b", "a b"), ("  ", " "), ("é è", "é è"), ("a   b", "a b")])
def test_collapse_space(one, raw, expected):
    assert one(collapse_space(X()), "x string", raw) == expected


def test_strip_and_blank(one):
    assert one(strip(X()), "x string", "\t  a b\x1c\n") == "a b"
    assert one(is_blank(X()), "x string", " 　\n") is True
    assert one(is_blank(X()), "x string", " a ") is False
    assert one(is_blank(X()), "x string", None) is True


def test_last_segment(one):
    assert one(text.last_segment(X()), "x string", "https://openalex.org/W12") == "W12"
    assert one(text.last_segment(X()), "x string", "W12") == "W12"
    assert one(text.last_segment(X()), "x string", None) == ""


def test_flatten_cut_has_no_mark(one):
    assert one(text.flatten_cut(X(), 5), "x string", "\n ab\ncdefg") == "ab cd"
    assert one(text.flatten_cut(X()), "x string", None) == ""


@pytest.mark.parametrize("when, expected", [
    ("2024-01-20 00:00:00", "today"), ("2024-01-19 12:00:00", "1 day ago"),
    ("2024-01-19 12:00:01", "today"), ("2024-01-10 00:00:00", "10 days ago"), ("2024-02-01 00:00:00", "today")])
def test_age_label(one, when, expected):
    assert one(text.age_label(X().cast("timestamp"), "2024-01-20 12:00:00"), "x string", when) == expected


@pytest.mark.parametrize("venue, source, flag, expected", [
    ("Marine Letters", "openalex:issn:1", 0, "Marine Letters"),
    ("  ", "feed", None, "feed"), (None, "feed", 1, "feed (preprint)"),
    ("arXiv", "arxiv", 1, "arXiv"), (" Zenodo ", "x", 1, "Zenodo (preprint)"), (None, None, None, "")])
def test_source_label(one, venue, source, flag, expected):
    column = text.source_label(F.col("v"), F.col("s"), F.col("p"))
    assert one(column, "v string, s string, p int", venue, source, flag) == expected


def test_digest_line(one):
    column = text.digest_line(F.col("s"), F.col("t"), F.col("o"), F.col("w"), F.col("u"))
    assert one(column, "s int, t string, o string, w string, u string", 9, "T", "src", None, "http://u") == (
        "[9] T — src\n    \n    http://u")
