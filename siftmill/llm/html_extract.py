"""Main text of web pages by site style trees.

Parsing. A tolerant scanner walks tags in page order with a stack of open elements (void elements,
implied ends of p, li and the like, raw text of scripts and styles), in linear time at any depth.
Elements whose tag says that they are no text (nav, footer, aside, buttons, menus) are skipped. Branches
that a class name or id calls reader comments, teasers or adverts go whatever their size and whatever they
hold, articles among it; an article element does where its own name begins with such a word. Roles,
other class names and ids of presentation, forms and hidden elements only mark a branch: it goes
if there is text in an article or main element beside it (in the page or a marked branch around it);
else if it holds no such text and is small, less than half of the page's text or mostly links. A name that
says that there is none, or only that there is some, marks nothing (``no-ads``, ``has-sidebar``, ``comments-open``).

Style tree (Yi, Liu and Li, Eliminating Noisy Information in Web Pages for Data Mining, 2003). The
trees of all pages of a host are merged by paths of tag and class; pages that show the same on the
same paths are copies and count once. For each path with pages m:
presentation is the entropy (base m) of the child sequences used, content one minus the mean entropy
of its blocks of text over the pages that show them. With l child sequences and g = ``DECAY``,
importance = (1 - g^l) presentation + g^l content. Branches under ``LEAST_IMPORTANCE`` are removed
from each page. What a single page has cannot be compared: its importance is 1. Branches are the
element of a block of text and ``HEIGHT`` levels above it, so a page's rows are in proportion to its
blocks; a higher branch is judged by its parts.
An article or main element, and within it headings, items and cells, and paragraphs and lists without a class name
of their own, are not removed: a paragraph that many articles share is still text. A page that nothing would
be left of stays whole.

If some text is within article (else main) elements and is not for the most part links, as a list of
cards is, only that is taken, else all that is left of the body. Counts per host, path and feature are partial aggregates, so a host with a third of all
pages is no hot group. Removed paths are joined as rows with the paths that pages' texts depend on,
and each page then gets its own, never all those of its host.

Defined cases. Null or empty html: empty text. Null url or one without host: the page is a site of
its own. Repeated rows: they count once, and each gets its text. Very long pages and very deep ones:
read whole, in linear time. An empty table: an empty result. Further columns are kept; of columns
named like a result column, the result's value stays.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.common import table, written

LEAST_IMPORTANCE = 0.2
DECAY = 0.9
HEIGHT = 16
#: Characters of a marked branch that goes even if it is most of a page without article.
SMALL = 200
RESULT = ("text", "n_chars")

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math object canvas audio video select head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr td th article main".split())
#: An open element that a start tag ends, up to the given element.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What presentation is called. A class name or id counts if it is made of these words,
#: and of words for parts of a layout, alone.
SKIPPED_TAGS = frozenset("nav footer aside button input menu dialog".split())
MARKED_TAGS = frozenset({"form"})
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
MARKED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation topnav breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended comments comment commentlist respond reply "
    "disqus footer widget masthead toolbar pagination pager copyright disclaimer login search".split()
)
LAYOUT_NAMES = frozenset(
    "site page global top bottom left right box area list wrapper wrap container bar section block links form "
    "button buttons item items post posts content inner outer thread slot unit row col column title".split()
)
#: Names of which one such word is enough, unless another one says that it is not what is in there.
STRONG_NAMES = frozenset("comment comments commentlist commentform disqus respond teaser teasers ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsors sponsored".split())
UNLESS_NAMES = frozenset("no not has with without is open closed enabled disabled allow allowed count off on free category tag cat type format meta".split())
#: Elements of an article that the style tree judges where they have a class name.
JUDGED = frozenset("p ul ol dl pre blockquote figure table".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|/?[a-zA-Z][^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_]+")
_MOST_TAGS = 20_000
_told: dict[tuple[str, str], tuple[str, int]] = {}


def marked_name(name: str, article: bool = False) -> int:
    """Whether a class name or id is one of presentation: 2 if its branch goes in any case, 1 if it marks
    it, else 0. Of an article element only names that begin so."""
    words = [w.lower() for w in _NAME.findall(name)]
    if not words or not UNLESS_NAMES.isdisjoint(words):
        return 0
    if words[0] in STRONG_NAMES or not (article or STRONG_NAMES.isdisjoint(words)):
        return 2
    return int(any(w in MARKED_NAMES for w in words) and all(w in MARKED_NAMES or w in LAYOUT_NAMES or w.isdigit() for w in words))


def _tell(tag: str, rest: str) -> tuple[str, int]:
    """Label of an element in paths, and whether it marks a branch as presentation, as of ``marked_name``."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
    names = found.get("class", "").split()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    named = max((marked_name(n, tag == "article") for n in [*names, found.get("id", "")]), default=0)
    marked = max(named, int(tag in MARKED_TAGS or found.get("role", "").lower() in MARKED_ROLES or hidden))
    if tag in ("html", "body", "main") or (tag == "article" and marked < 2):
        marked = 0
    return f"{tag}.{' '.join(names)}" if names else tag, marked


def _label(tag: str, rest: str) -> tuple[str, int]:
    if not rest or rest.isspace():
        return tag, int(tag in MARKED_TAGS)
    if (tag, rest) not in _told:
        if len(_told) > _MOST_TAGS:
            _told.clear()
        _told[tag, rest] = _tell(tag, rest)
    return _told[tag, rest]


class Element(NamedTuple):
    """An open element. ``base`` is the place on the stack of the last element that is not inline,
    itself included; ``paths`` are those of the branches it is in, ``removable`` those of them that
    may go, the nearest last; ``mark`` is the innermost marked branch, or -1."""

    tag: str
    path: int
    children: list[str]
    base: int
    paths: tuple[int, ...]
    removable: tuple[int, ...]
    skipped: bool
    article: bool
    main: bool
    link: bool
    mark: int


class Page:
    """What a page shows: ``blocks`` of (text, paths of the open elements, in article, in main, paths
    that may be removed, characters within links), and ``styles``, the child sequences by path."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, tuple[int, ...], bool, bool, tuple[int, ...], int]] = []
        self.styles: dict[int, set[int]] = {0: set()}
        marks: list[int] = []  # of each block, the innermost marked branch it is in, or -1
        around: list[int] = []  # of each marked branch, the next one around it
        strong: list[bool] = []  # of each marked branch, whether it goes in any case
        self._scan(html or "", marks, around, strong)
        if around:
            self._drop_marked(marks, around, strong)

    def _drop_marked(self, marks: list[int], around: list[int], strong: list[bool]) -> None:
        """Leave out marked branches, as the module's docstring says."""
        n = len(around)
        for m, outer in enumerate(around):  # inner branches come later
            strong[m] = strong[m] or (outer >= 0 and strong[outer])
        if any(strong) and any(m < 0 or not strong[m] for m in marks):
            left = [k for k, m in enumerate(marks) if m < 0 or not strong[m]]
            self.blocks, marks = [self.blocks[k] for k in left], [marks[k] for k in left]
        size, linked, holds, own = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        for block, mark in zip(self.blocks, marks):
            size[mark] += len(block[0])
            linked[mark] += block[5]
            own[mark] |= block[2] or block[3]
        holds[:] = own
        for m in range(n - 1, -1, -1):  # numbers of inner branches are higher; the last entry is the page's
            size[around[m]] += size[m]
            linked[around[m]] += linked[m]
            holds[around[m]] |= holds[m]
        gone, beside = [False] * (n + 1), [False] * (n + 1)
        for m, outer in enumerate(around):
            beside[m] = beside[outer] or own[outer]
            small = size[m] <= SMALL or 2 * size[m] < size[n] or 2 * linked[m] > size[m]
            gone[m] = gone[outer] or beside[m] or (small and not holds[m])
        self.blocks = [b for b, m in zip(self.blocks, marks) if not gone[m]]

    def _scan(self, html: str, marks: list[int], around: list[int], strong: list[bool]) -> None:
        stack = [Element("", 0, [], 0, (0,), (), False, False, False, False, -1)]
        places: dict[str, list[int]] = {}  # of each tag, where it is open on the stack
        text: list[str] = []
        linked, at, n = 0, 0, len(html)

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join("".join(text).split())
                text.clear()
                if whole:
                    top = stack[stack[-1].base]
                    self.blocks.append((whole, top.paths, top.article, top.main, top.removable, min(linked, len(whole))))
                    marks.append(stack[-1].mark)
            linked = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                if e.tag:
                    places[e.tag].pop()
                if e.base == len(stack) and not e.skipped:
                    self.styles.setdefault(e.path, set()).add(xxhash.xxh3_64_intdigest("|".join(e.children)) >> 1)

        def place(tags: Iterable[str]) -> int:
            """Where the last open element with one of the tags is, else 0."""
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while at < n:
            found = _TAG.search(html, at)
            end = found.start() if found else n
            if end > at and not stack[-1].skipped:
                piece = html[at:end]
                piece = entities.unescape(piece) if "&" in piece else piece
                text.append(piece)
                linked += len(piece) if stack[-1].link else 0
            if not found:
                break
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if found[1]:  # an end tag
                depth = place((tag,))
                if not inline:
                    flush()
                if depth and (not inline or depth > stack[-1].base):
                    close(depth)
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in RAW:
                if not inline:
                    flush()
                if tag == "head":
                    continue
                if not found[3].endswith("/"):
                    over = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = over.end() if over else n
                continue
            if not inline:
                flush()
                if tag in ENDS_P and (depth := place("p")) and depth == stack[-1].base:
                    close(depth)
                if tag in ENDS:
                    these, upto = ENDS[tag]
                    depth = place(these)
                    if depth > place(upto):
                        close(depth)
            if tag in VOID or tag in ("html", "body"):
                continue
            label, marked = _label(tag, found[3])
            top = stack[-1]
            skip = tag in SKIPPED_TAGS or (tag == "header" and not (top.article or top.main))
            mark = top.mark
            places.setdefault(tag, []).append(len(stack))
            if inline:  # a marked one loses its own text; blocks within are judged by themselves
                stack.append(top._replace(tag=tag, skipped=top.skipped or marked > 0, link=top.link or tag == "a"))
                continue
            if marked:
                around.append(mark)
                strong.append(marked == 2)
                mark = len(around) - 1
            if not top.children or top.children[-1] != label:
                top.children.append(label)
            path = xxhash.xxh3_64_intdigest(f"{top.path}/{label}") >> 1
            inside, within = top.article or tag == "article", top.main or tag == "main"
            removable = top.removable
            if tag in ("article", "main"):
                removable = ()
            elif not (tag in PLAIN and (inside or within) and (label == tag or tag not in JUDGED)):
                removable = (*removable[-HEIGHT:], path)
            stack.append(Element(tag, path, [], len(stack), (*top.paths[-HEIGHT:], path), removable, stack[top.base].skipped or skip, inside, within, top.link, mark))
        flush()
        close(0)

    def removable(self) -> set[int]:
        """The paths whose removal can change the text: where an article (else main) has a block that
        stays in any case, what is outside is not taken anyway."""
        paths: set[int] = set()
        for within in (2, 3):
            own = [b for b in self.blocks if b[within]]
            paths.update(path for b in own for path in b[4])
            if any(not b[4] for b in own) and not _mostly_links([b for b in own if not b[4]]):
                return paths
        return paths.union(*(b[4] for b in self.blocks))

    def text(self, removed: frozenset[int] = frozenset()) -> str:
        left = [b for b in self.blocks if removed.isdisjoint(b[4])] or self.blocks if removed else self.blocks
        inner = next((x for x in ([b for b in left if b[2]], [b for b in left if b[3]]) if x and not _mostly_links(x)), left)
        return "\n\n".join(b[0] for b in inner)


def _mostly_links(blocks: list) -> bool:
    return 2 * sum(b[5] for b in blocks) > sum(len(b[0]) for b in blocks)


def _features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each path of a page: a hash of its child sequences (kind 0), hashes of its blocks (1), with
    ``page`` a hash of all these; and the paths that its text depends on (2)."""
    for part in parts:
        found = []
        for host, digest, html in zip(part["host"], part["page"], part["html"]):
            page = Page(html)
            rows = {(path, 0, xxhash.xxh3_64_intdigest(str(sorted(s))) >> 1) for path, s in page.styles.items()}
            for text, down, *_ in page.blocks:
                block = xxhash.xxh3_64_intdigest(text) >> 1
                rows.update((path, 1, block) for path in down)
            shown = xxhash.xxh3_64_intdigest(str(sorted(rows))) >> 1
            found.extend((host, shown, *row) for row in rows)
            found.extend((host, digest, path, 2, 0) for path in page.removable())
        yield pd.DataFrame(found, columns=["host", "page", "path", "kind", "feature"]).astype({"page": "int64", "path": "int64", "kind": "int32", "feature": "int64"})


def page_features(pages: DataFrame) -> DataFrame:
    """From ``_w_host, _w_page, html``: rows of ``_features`` of the pages with a host."""
    own = pages.filter("_w_host <> ''").select(F.col("_w_host").alias("host"), F.col("_w_page").alias("page"), "html")
    return own.mapInPandas(_features, "host string, page long, path long, kind int, feature long")


def site_styles(features: DataFrame) -> DataFrame:
    """From ``page_features``: host, path, pages, importance of every path of every site."""
    once = features.filter("kind < 2").distinct()
    counted = once.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    n, style = F.col("n"), F.col("kind") == 0
    sums = counted.groupBy("host", "path").agg(
        F.sum(F.when(style, n)).alias("pages"),
        F.sum(F.when(style, n * F.ln(n))).alias("a"),
        F.count(F.when(style, 1)).alias("l"),
        F.count(F.when(~style, 1)).alias("blocks"),
        F.sum(F.when(~style, F.ln(n))).alias("b"),
    )
    log = F.ln("pages")
    shape = F.when(F.col("pages") > 1, (log - F.col("a") / F.col("pages")) / log).otherwise(1.0)
    content = F.when((F.col("pages") > 1) & (F.col("blocks") > 0), 1 - F.least(F.lit(1.0), F.col("b") / F.col("blocks") / log)).otherwise(F.when(F.col("blocks") > 0, 1.0).otherwise(0.0))
    weight = F.pow(F.lit(DECAY), F.col("l"))
    return sums.select("host", "path", "pages", "blocks", ((1 - weight) * shape + weight * content).alias("importance"))


def low_paths(styles: DataFrame) -> DataFrame:
    """``host, path`` of low importance, of those that show text."""
    return styles.filter((F.col("path") != 0) & (F.col("blocks") > 0) & (F.col("importance") < LEAST_IMPORTANCE)).select("host", "path")


def removed_paths(features: DataFrame, low: DataFrame) -> DataFrame:
    """Per page with any, ``_w_removed``: its paths of low importance. Equal pages are one row."""
    own = features.filter("kind = 2").select("host", "page", "path").distinct()
    return own.join(low, ["host", "path"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("path")).alias("_w_removed"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
def _extracted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for pages, removed in parts:
        texts = [Page(h).text(frozenset(r) if r is not None else frozenset()) for h, r in zip(pages, removed)]
        yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, ...) with text and n_chars."""
    pages = pages.drop(*[c for c in pages.columns if c in RESULT or c.startswith("_w_")])
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    known = pages.withColumns({"_w_host": host, "_w_page": F.xxhash64("html")})
    # Written, since they are read twice and pages are parsed for them.
    features = written(page_features(known), "page-features")
    low = written(low_paths(site_styles(features)), "low-paths")
    removed = written(removed_paths(features, low), "removed-paths").withColumnsRenamed({"host": "_w_site", "page": "_w_same"})
    found = known.join(removed, (F.col("_w_host") == F.col("_w_site")) & (F.col("_w_page") == F.col("_w_same")), "left").withColumn("_w_found", _extracted("html", "_w_removed"))
    return found.select(*pages.columns, "_w_found.text", "_w_found.n_chars")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", *RESULT)


QUERY = ("op4_html_extract", op4_html_extract)
SQL = None
