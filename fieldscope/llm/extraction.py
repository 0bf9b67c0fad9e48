"""The main text of web pages, without what a site repeats around it.

Each element's subtree has a hash of its tags and texts.  Spark counts on how many
pages of a host a subtree occurs; those on many of them are the site's template
and are deleted, next to what markup itself declares to be no content: scripts,
navigation, forms, adverts, notices, comments.

* A NULL page is an empty one, and its text is empty.
* Without a host in its URL a page has no template, only declared parts go.
* Rows of one main text (copies, print views, session URLs) count as one page of
  their host; a template needs both LEAST_PAGES of these and LEAST_SHARE of those of its
  host, or of its host's pages below one first folder.  Outside the part of a page that
  holds most of what its host doesn't repeat, the square root of the host's pages is enough.
* What is repeated within an article is the article's: bylines, quotes, stock phrases stay.
  Only boxes before its first or after its last text of its own go.  Where no article is marked, the
  same holds for the part with most of the page's own text, of which also repeated boxes of several
  blocks go, and single ones at its ends.
* Pages are read to their end, however long; tags that are never closed close as in
  HTML, so a broken page loses nothing.
* No pages, no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.llm.common import kept, small_batches

LEAST_PAGES = 5
LEAST_SHARE = 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of HTML by what they do.
_RAW = frozenset("script style textarea title xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
# An element that opens one of these closes an open one of the others, unless the stop lies between.
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
             "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
             "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
_NEVER = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input map math menu nav noframes noscript object "
    "script search select style svg template textarea title video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_NAMES = re.compile(
    r"^(?:.*[-_])?(?:ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|"
    r"popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|masthead|footer|comments?|disqus\w*|"
    r"respond|repl(?:y|ies)|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|pagination|pager|"
    r"toolbar|teasers?)(?:[-_].*)?$")
_WRAPS = re.compile(r"(?:^|[-_])(?:has|with|without|no)[-_]")  # of a name that tells what else is there
_KEEP = frozenset("html body article main".split())
_CONTAINERS = frozenset("article body center div form html main section table tbody td tr".split())
_BOXES = frozenset("center details div dl fieldset menu ol section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words that make up the names of known parts, and those that may stand beside them.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsors sponsored promo promos promotion banner "
    "cookie cookies gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets masthead "
    "footer comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup "
    "login pagination pager toolbar teaser teasers".split())
_BESIDE = frozenset(
    "area article articles bar body bottom box btn button buttons consent container content entry form icon icons inline inner "
    "item items js left link links list main mid middle module notice outer page panel post posts right row section site slot "
    "sticky stories story thread top unit wp wrap wrapper zone".split())
# Of an id of a heading or an article's section, which often repeats its title, only these are known parts.
_PART_IDS = frozenset("ads comment comments disqus-thread reply replies respond teasers".split())
_OFTEN_IDS = frozenset("ad ads advert comment comments newsletter promo related recommended share sharing social sponsored".split())
# What is of others or of other pages, even where it has the most text.
_COMMENTS = frozenset("comment comments disqus respond reply replies related recommended".split())


class Page:
    """The elements of a page in their order, and its texts with the element and the block of each."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes, self.hashes = ["#root"], [0], [""], [0]
        self.texts: list[tuple[int, int, str]] = []
        self._gone: list[bool] | None = None
        parts: list[list[bytes]] = [[]]
        stack, block, place = [0], 0, 0

        def close(to: int) -> None:
            """Close the open elements down to a height of the stack."""
            nonlocal block
            while len(stack) > to:
                at = stack.pop()
                if self.tags[at] in _BLOCK:
                    block += 1
                if parts[at]:
                    digest = xxhash.xxh3_64(self.tags[at] + "\0" + b"".join(parts[at]).hex())
                    self.hashes[at] = digest.intdigest() - (1 << 63)
                    parts[self.parents[at]].append(digest.digest())
                parts[at] = []

        def open_height(names, stops=()) -> int:
            for height in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[height]]
                if tag in names:
                    return height
                if tag in stops:
                    break
            return 0

        def say(text: str) -> None:
            if text:
                self.texts.append((stack[-1], block, text))
                bare = text.strip()
                if bare:
                    parts[stack[-1]].append(xxhash.xxh3_64_digest(bare))

        while found := _TAG.search(source, place):
            say(source[place:found.start()])
            place = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                if height := open_height((name,)):
                    close(height)
                continue
            if name in _ENDS_P and (height := open_height(("p",), ("button", "table", "td", "th", "caption", "object"))):
                close(height)
            if name in _SIBLINGS and (height := open_height(*_SIBLINGS[name])):
                close(height)
            if name in _BLOCK:
                block += 1
            if name == "br":
                say(" ")
            if name in _VOID:
                continue
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.attributes.append(found[3])
            self.hashes.append(0)
            parts.append([])
            stack.append(len(self.tags) - 1)
            if name in _RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, place)
                stop = end.start() if end else len(source)
                say(source[place:stop])
                place = stop
        say(source[place:])
        close(1)

    def _weights(self, out: list[bool]) -> list[int]:
        """The characters of each element's texts that are in no element that is out."""
        found = [0] * len(self.tags)
        for at, _, text in self.texts:
            if not out[at]:
                found[at] += len(text.strip())
        for i in range(len(self.tags) - 1, 0, -1):
            found[self.parents[i]] += found[i]
        return found

    def declared(self) -> list[bool]:
        """For each element, whether it or one around it is no content by its markup.

        The article or main with the most text is kept, whatever the names of what holds it; others are named out by
        themselves or by what is around them.
        """
        if self._gone is not None:
            return self._gone
        n = len(self.tags)
        never, inside, article, named, part = [False] * n, [False] * n, [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            above, tag = self.parents[i], self.tags[i]
            inside[i] = inside[above] or tag in ("article", "main")
            article[i] = article[above] or tag == "article"
            never[i] = never[above] or tag in _NEVER or tag == "header" and not inside[above]
            if tag not in _KEEP or tag == "article":
                named[i] = self._named(i, tag == "article" or article[above] or tag in _HEADINGS or tag == "section" and inside[i],
                                       tag in _HEADINGS or inside[above] and tag != "article")
        weights = self._weights(never)
        for i in range(1, n):
            if named[i] == 1 and 2 * weights[i] > weights[0]:
                named[i] = 0
            part[i] = part[self.parents[i]] or (i if named[i] else 0)
        tops = {part[i] for i in range(1, n) if part[i] and not never[i]}
        rest = weights[0] - sum(weights[i] for i in tops)
        # One in a named part is the page's main one only where it has more text than all that is in none.
        marked = [i for i in range(1, n) if self.tags[i] in ("article", "main") and weights[i] and (
            not part[i] or _COMMENTS.isdisjoint(self._words(part[i])) and weights[i] > rest or not rest)]
        holds = [False] * n
        at = max(marked, key=weights.__getitem__, default=0)
        while at:
            holds[at], at = True, self.parents[at]
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parents[i]] or never[i] or not holds[i] and (
                named[i] > 0 or self.tags[i] == "form" and 2 * weights[i] <= weights[0])
        self._gone = gone
        return gone

    def _words(self, i: int) -> set[str]:
        """The words of an element's classes and id."""
        return {w for m in _NAMED.finditer(self.attributes[i]) if m[1].lower() in ("class", "id")
                for w in re.split(r"[-_\s]+", (m[2] or m[3] or m[4] or "").lower())}

    def _named(self, i: int, exact: bool, titled: bool) -> int:
        """Whether names or states say that an element is no content: 2 surely, 1 unless it has most of the page's text.

        ``exact``: only names of known parts count.  ``titled``: an id may come from a title.
        """
        attributes, most = self.attributes[i], 0
        if "=" not in attributes and "hidden" not in attributes.lower():
            return 0
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                for v in value.split():
                    if not _NAMES.match(v) or _WRAPS.search(v):
                        continue
                    words = [w for w in re.split("[-_]+", v) if w and not w.isdigit()]
                    known = not _PARTS.isdisjoint(words) and _PARTS.union(_BESIDE).issuperset(words)
                    if known and key == "id" and titled:
                        known = "-".join(words) in _PART_IDS or len(words) > 1 and not _OFTEN_IDS.isdisjoint(words)
                        most = max(most, 2 * known)
                    else:
                        most = max(most, 2 if known else 0 if exact or key == "id" and titled else 1)
            elif key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                if value != "form" or key != "role":
                    return 2
                most = max(most, 1)
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 2
        return most

    def subtrees(self) -> set[int]:
        """Hashes of the elements that a template may consist of: with text, and not declared out."""
        gone = self.declared()
        return {h for h, g, t in zip(self.hashes, gone, self.tags) if h and not g and t not in _KEEP}

    def _main_part(self, gone: list[bool]) -> tuple[bool, list[bool] | None]:
        """Whether the articles are the main part, and for each element whether it is in it (None: all of the page).

        The articles, unless there is more prose in main or, without one, on the page beside them; else main; else all.
        """
        left = self._weights(gone)
        links = [t == "a" or g for t, g in zip(self.tags, gone)]
        for i in range(1, len(links)):
            links[i] |= links[self.parents[i]]
        found = {}
        for name in ("article", "main"):
            chosen = [t == name and not g and w > 0 for t, g, w in zip(self.tags, gone, left)]
            tops = any(chosen)
            for i in range(1, len(self.tags)):
                chosen[i] |= chosen[self.parents[i]]
            if tops:
                found[name] = chosen
        articles, main = found.get("article"), found.get("main")
        if articles is None:
            return False, main
        within = total = 0
        for at, _, text in self.texts:
            if not links[at] and (main is None or main[at] or articles[at]):
                size = len(text.strip())
                total += size
                within += size if articles[at] else 0
        return (True, articles) if 2 * within >= total else (False, main)

    def _container(self, weights: list[int], blocks: list[int] | None = None) -> int:
        """The smallest container with most of the text that is weighed, and of several ``blocks`` where these are given."""
        at = 0
        for i in range(1, len(self.tags)):
            if self.parents[i] == at and self.tags[i] in _CONTAINERS and 2 * weights[i] > weights[0] and (blocks is None or blocks[i] > 1):
                at = i
        return at

    def _blocks(self, gone: list[bool]) -> list[int]:
        """The blocks of text of each element."""
        found, last = [0] * len(self.tags), None
        for at, block, text in self.texts:
            if not gone[at] and block != last and text.strip():
                found[at], last = found[at] + 1, block
        for i in range(len(self.tags) - 1, 0, -1):
            found[self.parents[i]] += found[i]
        return found

    def _spared(self, gone: list[bool], counted: list[bool], articles: list[bool] | None) -> None:
        """Take back what of the main part would go for its counts alone, but for boxes.

        ``counted``: elements that are repeated and not declared out.  ``articles``: the elements in the main articles, if
        these are the main part; else that is the container with most of the text that is left, not a single paragraph.
        """
        n, weights = len(self.tags), self._weights(gone)
        part, tops = [0] * n, [0] * n
        main = 0 if articles else self._container(weights, self._blocks(gone))
        for i in range(1, n):
            above = self.parents[i]
            part[i] = part[above] or (i if articles and articles[i] else 0)
            if not articles and (above == main or part[above]):
                part[i] = main + 1
            tops[i] = tops[above] or (i if counted[i] else 0)
        own: dict[int, list[int]] = {}  # of a part, the first and last text that is not repeated
        ends: dict[int, tuple[int, int]] = {}  # of a repeated subtree, its first and last text
        blocks: dict[int, set[int]] = {}
        for at, (i, block, text) in enumerate(self.texts):
            if not text.strip():
                continue
            top = tops[i]
            if top:
                ends[top] = (ends[top][0] if top in ends else at, at)
                blocks.setdefault(top, set()).add(block)
            elif not gone[i]:
                own.setdefault(part[i], [at, at])[1] = at
        spare = set()
        for top, (first, last) in ends.items():
            if part[top] in own and part[top]:
                edge = last < own[part[top]][0] or first > own[part[top]][1]
                box = self.tags[top] in _BOXES
                if not (edge and box) if articles else not edge and not (box and len(blocks[top]) > 1):
                    spare.add(top)
        declared = self.declared()
        for i in range(1, n):
            if tops[i] in spare:
                gone[i] = declared[i]

    def _outside(self, gone: list[bool], often: set[int]) -> list[bool]:
        """For each element, whether it lies outside the smallest container with most of the text that is not repeated.

        Articles, main and what has a fifth of that text are never outside.
        """
        n = len(self.tags)
        own = [g or h in often and t not in _KEEP for g, h, t in zip(gone, self.hashes, self.tags)]
        for i in range(1, n):
            own[i] |= own[self.parents[i]]
        weights = self._weights(own)
        at = self._container(weights)
        if not weights[0]:
            return [False] * n
        around = {at}
        while at:
            at = self.parents[at]
            around.add(at)
        inner, out, inside = max(around), [False] * n, [False] * n
        for i in range(1, n):
            above = self.parents[i]
            inside[i] = inside[above] or above == inner or self.tags[i] in ("article", "main")
            out[i] = not inside[i] and i not in around and (out[above] or above in around and 5 * weights[i] < weights[0])
        return out

    def main_text(self, template: set[int], often: set[int] = frozenset()) -> str:
        """Without what is repeated: ``template`` on much of the site, ``often`` on some pages and outside this page's main part."""
        declared = self.declared()
        gone = list(declared)
        out = self._outside(gone, often) if often else [False] * len(gone)
        counted = [False] * len(gone)
        for i in range(1, len(self.tags)):
            counted[i] = not declared[i] and self.tags[i] not in _KEEP and (
                self.hashes[i] in template or out[i] and self.hashes[i] in often)
            gone[i] = gone[i] or gone[self.parents[i]] or counted[i]
        marked, wanted = self._main_part(gone)
        if True in counted:
            self._spared(gone, counted, wanted if marked else None)
        blocks, last, pieces = [], None, []

        def end() -> None:
            words = " ".join("".join(pieces).split())
            if words:
                blocks.append(words)

        for at, block, text in self.texts:
            if gone[at] or wanted is not None and not wanted[at]:
                continue
            if block != last:
                end()
                pieces, last = [], block
            pieces.append(html.unescape(text) if "&" in text else text)
        end()
        return "\n".join(blocks)


def host(url: Column) -> Column:
    """The lower-case host of a URL; NULL without one."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def section(url: Column) -> Column:
    """The host of a URL and the first folder of its path, which is empty for pages in none; NULL without a host."""
    folder = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)/", 1)
    return F.concat(host(url), F.lit("/"), folder)


def templates(pages: DataFrame) -> DataFrame:
    """For each host, and for each ``host/folder``: ``site``, ``template`` and ``often``, hashes of repeated subtrees.

    A subtree counts once for each main text, however many rows have it.  As each hash of ``template`` is on a good part of
    the site's pages, it is no longer than a few pages' elements; ``often`` has those on at least LEAST_PAGES and the square
    root of a host's pages, so at most the square root times the elements of a page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, hashes, contents = [], [], []
            for name, folder, source in zip(*(batch.column(i) for i in range(3))):
                page = Page(source.as_py() or "")
                found = [None, *page.subtrees()]  # the NULL one counts the site's pages
                content = xxhash.xxh3_64_intdigest(page.main_text(set())) - (1 << 63)
                for site in (name.as_py(), folder.as_py()):
                    sites += [site] * len(found)
                    hashes += found
                    contents += [content] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sites, pa.string()), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())],
                ["site", "subtree", "content"])

    small_batches(pages.sparkSession)
    named = pages.select(host(F.col("url")).alias("host"), section(F.col("url")).alias("section"), "html").filter("host IS NOT NULL")
    counts = named.mapInArrow(run, "site string, subtree long, content long").groupBy("site", "subtree").agg(
        F.count_distinct("content").alias("_n"))
    counts = kept(counts.filter(F.col("_n") >= LEAST_PAGES), "counts")
    sizes = counts.filter("subtree IS NULL").select(F.col("site").alias("_site"), F.col("_n").alias("_pages"))
    most = F.col("_n") >= LEAST_SHARE * F.col("_pages")
    repeated = counts.filter("subtree IS NOT NULL").join(sizes, F.col("site") == F.col("_site")).filter(
        most | (F.col("_n") >= F.sqrt("_pages")) & ~F.contains("site", F.lit("/")))
    return kept(repeated.groupBy("site").agg(F.collect_set(F.when(most, F.col("subtree"))).alias("template"),
                                             F.collect_set(F.when(~most, F.col("subtree"))).alias("often")), "templates")


_TEXTS = "page_id long, url string, text string, n_chars long"


def main_texts(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(page.as_py() or "").main_text({*(a.as_py() or ()), *(b.as_py() or ())}, set(c.as_py() or ()))
                     for page, a, b, c in zip(*(batch.column(i) for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "_host", host(F.col("url"))).withColumn("_section", section(F.col("url")))
    found = templates(pages)
    hosts = found.filter(~F.contains("site", F.lit("/"))).select(F.col("site").alias("_a"), F.col("template").alias("_all"), "often")
    folders = found.filter(F.contains("site", F.lit("/"))).select(F.col("site").alias("_b"), F.col("template").alias("_some"))
    joined = rows.join(hosts, F.col("_host") == F.col("_a"), "left").join(folders, F.col("_section") == F.col("_b"), "left")
    return joined.select("page_id", "url", "html", "_all", "_some", "often").mapInArrow(run, _TEXTS)


def op6_template_removal(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
