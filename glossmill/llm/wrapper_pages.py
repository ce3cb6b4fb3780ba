"""Main text of web pages by wrapper induction.

Pages of one host are parsed into trees of block elements and aligned one after another with the wrapper so far, by
simple tree matching. What stands the same in every aligned page is template; slots that vary hold content. Of the
content, what lies in menus, headers, footers, sidebars, notices, adverts, forms or reader comments is left out by
element and class. Where a page marks its one article, text outside counts only if enough pages show that its slot
varies; where too few agree, the article alone counts. Comments and teaser cards mark no article. A form around the
article or around most of the page is no form to fill in.

A host may have any share of the pages: each is dealt into groups of about ``group_pages``, and every group learns
its own wrapper. Pages of one title count once as evidence (they may be versions of one article), and ``least_pages``
of different titles have to agree, so a page alone is judged by its elements only. The first-level heading of a marked
article is always content.

Null html: empty text. Null or odd url: a host of its own name or none. Repeated rows get equal results. An empty
table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossmill.llm.common import stored, table

#: Elements that begin a block, have no end tag, or never hold text to read.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr"
    " ul caption title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set(
    "script style noscript template head title iframe object svg canvas math button select option textarea input"
    " nav footer aside menu dialog audio video map".split())
#: Which open element a start tag closes, and where the search for it ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "section", "div"}
#: Words in a class, id or role that mark what is not the article.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall menu"
    " nav navbar navigation navlinks breadcrumb breadcrumbs topbar toolbar sidebar aside rail widget widgets related"
    " recommended recommendations share sharing social footer masthead comment comments commentlist reply replies respond"
    " disqus discussion search searchbox pagination pager tags tagcloud copyright disclaimer skip complementary"
    " contentinfo".split())
#: Of these words, what makes an article element a comment or an advert; what makes it a card; the beginnings
#: of class names that list the subjects of an article; and elements whose id is a name for links.
NOT_ARTICLE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended"
    " recommendations comment comments commentlist reply replies respond disqus".split())
CARD_WORDS = set("card cards teaser teasers tile tiles".split())
SUBJECTS = re.compile(r"(?:tags?|category|cat|topic)[-_]", re.I)
NAMED = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MOST_PAIRS = 1 << 16  # of siblings that are matched all at once
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    """A block element: text and child blocks in page order."""

    __slots__ = ("tag", "label", "parts", "parent", "aside", "aside_inside", "article", "card", "heading", "slot", "inner")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Element | None) -> None:
        self.tag, self.parent, self.parts, self.slot = tag, parent, [], None
        self.label = (tag, " ".join(sorted((attrs.get("class") or "").split())))
        words = lambda *names: {w.lower() for n in names for w in WORDS.findall(attrs.get(n) or "")}
        self.aside = bool(words("class", "id", "role") & ASIDE_WORDS)
        self.aside_inside = bool(words("class", "role") & ASIDE_WORDS) if tag in NAMED else self.aside
        self.article = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        self.card = False
        if tag == "article":
            own = {w.lower() for c in (attrs.get("class") or "").split() if not SUBJECTS.match(c) for w in WORDS.findall(c)}
            self.aside = self.aside_inside = bool((own | words("id", "role")) & NOT_ARTICLE)
            self.card = bool(own & CARD_WORDS)
        self.heading = tag == "h1"


class Text:
    """Text between two block borders, how much of it is link text, and whether it is readable at all."""

    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int) -> None:
        self.text, self.linked = text, linked


class TreeBuilder(HTMLParser):
    """Block tree of a page, forgiving about missing and stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open: list[tuple[str, Element, bool]] = [("#root", self.root, False)]  # tag, its block, silent
        self.pieces: list[str] = []
        self.linked = 0
        self.links: list[int] = []  # places in ``open`` of the links that are open, one at most
        self.title: str | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.open[-1][1].parts.append(Text(text, self.linked))
        self.pieces, self.linked = [], 0

    def close_to(self, at: int) -> None:
        """Close the open elements from number ``at`` on."""
        if any(block.tag == tag for tag, block, _ in self.open[at:]):
            self.flush()
        del self.open[at:]
        self.links = [place for place in self.links if place < at]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.flush()
            return
        closes = CLOSED_BY.get(tag) or ({"p"} if tag in BLOCKS else None)
        for at in range(len(self.open) - 1, 0, -1) if closes else ():
            if self.open[at][0] in closes:
                self.close_to(at)
                break
            if self.open[at][0] in SCOPE:
                break
        attrs = dict(attrs)
        _, block, silent = self.open[-1]
        silent = silent or tag in SILENT or "hidden" in attrs or bool(HIDDEN.search(attrs.get("style") or ""))
        if tag in BLOCKS:
            self.flush()
            child = Element(tag, attrs, block)
            block.parts.append(child)
            block = child
        elif tag in ("td", "th"):
            self.pieces.append(" ")
        if tag == "a":  # a link ends the one before it; an anchor without a target is no link
            self.links = [len(self.open)] if attrs.get("href") is not None else []
        if tag not in VOID:
            self.open.append((tag, block, silent))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.close_to(at)
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "title" and self.title is None:
            self.title = " ".join(data.split())
        if not self.open[-1][2]:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())


def parsed(html: str | None) -> tuple[Element, str | None]:
    """Block tree and title (the page itself where it has none)."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    return builder.root, builder.title or html


class Slot:
    """A node of the wrapper: rows of equal siblings are one. Knows in how many pages each text stood here."""

    __slots__ = ("label", "children", "texts", "pages")

    def __init__(self, label: tuple) -> None:
        self.label, self.children, self.texts, self.pages = label, [], Counter(), 0


class Row:
    """Siblings of one label in a page, taken together."""

    __slots__ = ("label", "elements", "rows")

    def __init__(self, label: tuple, elements: list[Element]) -> None:
        self.label, self.elements, self.rows = label, elements, []


def row_tree(tree: Element) -> Row:
    """The page as rows. Pages nest as deep as they like, so nothing here recurses."""
    top = Row(("#root", ""), [tree])
    order = [top]
    for row in order:
        for child in (c for e in row.elements for c in e.parts if isinstance(c, Element)):
            if row.rows and row.rows[-1].label == child.label:
                row.rows[-1].elements.append(child)
            else:
                row.rows.append(Row(child.label, [child]))
        order += row.rows
    return top


Matched = tuple[int, list[tuple[Slot, Row, list]]]


def matching(slots: list[Slot], rows: list[Row]) -> Matched:
    """Simple tree matching of two ordered lists: most matched nodes, and the matched pairs with theirs below.

    The best matching is found for lists of any length; beyond ``MOST_PAIRS`` pairs in memory that grows with their
    lengths and not with the number of pairs.
    """
    stack, value = [_matching(slots, rows)], None
    while stack:  # each step is a matching that waits for one further down
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _matching(slots: list[Slot], rows: list[Row]) -> Generator[Generator, Matched, Matched]:
    if not slots or not rows:
        return 0, []
    if len(slots) == 1 or len(slots) * len(rows) <= MOST_PAIRS:
        return (yield _exact(slots, rows))
    # Divide and conquer: the best place to cut the rows is where the scores of both halves of the slots add up to most.
    half = len(slots) // 2
    before = yield _scores(slots[:half], rows)
    behind = yield _scores(slots[:half - 1 : -1], rows[::-1])
    cut = int(np.argmax(before + behind[::-1]))
    first = yield _matching(slots[:half], rows[:cut])
    second = yield _matching(slots[half:], rows[cut:])
    return first[0] + second[0], first[1] + second[1]


def _scores(slots: list[Slot], rows: list[Row]) -> Generator[Generator, Matched, np.ndarray]:
    """For each number of leading rows, the most nodes matched between them and all slots; one line of scores at a time."""
    number: dict[tuple, int] = {}
    labels = np.array([number.setdefault(r.label, len(number)) for r in rows])
    nested = np.array([bool(r.rows) for r in rows])
    best = np.zeros(len(rows) + 1, np.int64)
    for slot in slots:
        equal = labels == number.get(slot.label, -1)
        paired = best[:-1] + equal
        for j in np.flatnonzero(equal & nested).tolist() if slot.children else ():
            paired[j] += (yield _matching(slot.children, rows[j].rows))[0]
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(equal, paired, 0)))
    return best


def _exact(slots: list[Slot], rows: list[Row]) -> Generator[Generator, Matched, Matched]:
    inner = {}
    for i, s in enumerate(slots):
        for j, r in enumerate(rows):
            if s.label == r.label:
                inner[i, j] = (yield _matching(s.children, r.rows)) if s.children and r.rows else (0, [])
    best = [[0] * (len(rows) + 1) for _ in range(len(slots) + 1)]
    for i in range(len(slots)):
        for j in range(len(rows)):
            paired = best[i][j] + 1 + inner[i, j][0] if (i, j) in inner else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], paired)
    pairs, i, j = [], len(slots), len(rows)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((slots[i], rows[j], inner[i, j][1]))
    return best[-1][-1], pairs[::-1]


def absorb(wrapper: Slot, page: Row, count: bool) -> None:
    """Add a page's rows to the slots they match; what matches nothing becomes a slot of its own."""
    todo = [(wrapper, page, matching(wrapper.children, page.rows)[1])]
    while todo:
        slot, row, pairs = todo.pop()
        for element in row.elements:
            element.slot = slot
        if count:
            slot.pages += 1
            slot.texts.update({p.text for e in row.elements for p in e.parts if isinstance(p, Text)})
        found = {id(r): (s, below) for s, r, below in pairs}
        children, old = [], iter(slot.children)
        for child in row.rows:
            s, below = found.get(id(child), (None, []))
            if s is None:
                s = Slot(child.label)
            else:  # pairs are in order: the slots before this one stay before it
                children += itertools.takewhile(lambda x: x is not s, old)
            children.append(s)
            todo.append((s, child, below))
        slot.children = children + list(old)


def induced(pages: list[str | None]) -> list[Element]:
    """Block trees of the pages, each element tied to its slot of their common wrapper."""
    wrapper, seen, trees = Slot(("#root", "")), set(), []
    for html in pages:
        tree, title = parsed(html)
        absorb(wrapper, row_tree(tree), title not in seen)
        seen.add(title)
        trees.append(tree)
    return trees


class Inner:
    """What stands inside an element: characters of text, an article, a first-level heading, the page's one article."""

    __slots__ = ("chars", "article", "heading", "main")

    def __init__(self) -> None:
        self.chars, self.article, self.heading, self.main = 0, False, False, False


def measured(tree: Element) -> list[Element]:
    """All elements, each before those inside it, with what stands inside them."""
    order = [tree]
    for element in order:
        element.inner = Inner()
        order += [c for c in element.parts if isinstance(c, Element)]
    for element in reversed(order):
        inner = element.inner
        for c in element.parts:
            if isinstance(c, Text):
                inner.chars += len(c.text)
            else:
                inner.chars += c.inner.chars
                inner.article |= c.article or c.inner.article
                inner.heading |= c.heading or c.inner.heading
    return order


def main_article(order: list[Element]) -> Element | None:
    """The page's one outermost article: no comment, card or part of an aside, or else the one with most of the text."""
    total, inside = order[0].inner.chars, {id(order[0]): (False, False)}  # in an article, in an aside block
    found: dict[bool, list[Element]] = {False: [], True: []}
    for element in order:
        in_article, in_aside = inside[id(element)]
        own = element.aside and element.tag not in ("html", "body", "#root", "main")
        candidate = element.article and not element.card and (not own or element.tag == "article" and element.inner.heading)
        if candidate and not in_article and (not in_aside or 2 * element.inner.chars > total):
            found[in_aside].append(element)
        below = (in_article or candidate, in_aside or own and not candidate)
        inside.update((id(c), below) for c in element.parts if isinstance(c, Element))
    some = found[False] or found[True]
    return some[0] if len(some) == 1 else None


def left_out(element: Element, inside: bool, marked: bool, total: int) -> bool:
    """Whether a block is none of the content, by its element and class."""
    inner = element.inner
    most = 2 * inner.chars > total
    if element.tag == "header" and not inside and not inner.article:
        return True
    if element.tag == "form" and not (inner.main or inner.article or inner.heading or most):
        return True
    if (element.aside_inside if inside else element.aside) and element.tag not in ("html", "body", "#root", "main"):
        around = inner.main or not marked and inner.article and most
        return not (around or element.tag == "article" and inner.heading)
    return False


def content(tree: Element, least_pages: int) -> Iterator[str]:
    """Readable blocks in page order."""
    order = measured(tree)
    main, total = main_article(order), tree.inner.chars
    marked, up = main is not None, main.parent if main is not None else None
    while up is not None:
        up.inner.main, up = True, up.parent
    stack: list[tuple[Element | Text, Element, bool]] = [(tree, tree, False)]  # part, its element, inside an article
    while stack:
        part, element, inside = stack.pop()
        if isinstance(part, Element):
            if not left_out(part, inside, marked, total):
                inside = inside or (part is main if marked else part.article and not part.card)
                stack += [(p, part, inside) for p in reversed(part.parts)]
            continue
        slot = element.slot
        known, seen = slot.pages >= least_pages, slot.texts[part.text]
        if inside or not marked:
            template = known and seen >= slot.pages and not (inside and element.heading)
        else:
            template = not known or 2 * seen > slot.pages
        if not (template or not inside and part.linked * 2 > len(part.text)):
            yield part.text


def main_texts(pages: DataFrame, group_pages: int = 32, least_pages: int = 3) -> DataFrame:
    """page_id, url and text of each page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html", "page_id", "url").alias("page"))
    # Rows that repeat a page in full are read once, so that no group holds more of them than of other pages.
    known = stored(rows.select("page", "host"), "page-keys")
    again = stored(known.groupBy("page").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    alone = rows.join(again, "page", "left_anti")
    one = rows.join(again, "page", "left_semi").groupBy("page").agg(*(F.any_value(c).alias(c) for c in ("page_id", "url", "html", "host")))
    rows = alone.unionByName(one)
    # One small row for each host; written, so that its true size decides how it is joined.
    sizes = stored(known.distinct().groupBy("host").agg((F.floor(F.count("*") / group_pages) + 1).alias("groups")), "hosts")
    dealt = rows.join(sizes, "host").withColumn("dealt", F.pmod("page", "groups"))
    schema = pa.schema([("page", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def extract(group: pa.Table) -> pa.Table:
        trees = induced(group.column("html").to_pylist())
        texts = ["\n".join(content(tree, least_pages)) for tree in trees]
        return pa.Table.from_arrays([*(group.column(c) for c in ("page", "page_id", "url")), pa.array(texts, pa.string())], schema=schema)

    found = dealt.groupBy("host", "dealt").applyInArrow(extract, "page long, page_id long, url string, text string")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long"))))
    return found.join(again, "page", "left").withColumn("copy", times).select("page_id", "url", "text")


def op3_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
