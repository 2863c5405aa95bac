"""Main text of web pages by scores on the element tree (operator 11).

A page's markup becomes a tree of elements and, in page order, blocks of text between the edges of block elements. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by their elements, roles and
class names. Every block that is left passes points, for its length and its commas, less the share of its text that is
link text, to the container it is in, half of them to the next one out, and so on for LEVELS containers. The container
with the most points, again less its share of link text, is the article (or the article element around it); siblings
that hold a fair part of its points, and headings and sentences beside it, are kept too. All blocks kept are whole.

Defined cases: a null html is an empty page; a page without text outside of what goes has an empty text; where no block
has points, all of the article, main or body element is kept; unclosed and misnested elements close as browsers close
them, an unclosed comment, script or style takes the rest of the page, `<` that begins no tag is text; a header inside
an article is the article's own and stays; a form, or an element that goes by its class, stays if it holds the main
element or the page's first heading; br is white space; a table cell is a block; repeated rows are pages each; null
page_ids and urls stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import resident, small_batches, table

#: Containers that a block's points reach; each has half of what the one inside it has.
LEVELS = 5
#: Of siblings: least share of the best container's points, and most share of link text; a list of links beyond MENU goes.
SIBLING, LINKED, MENU = 0.2, 0.33, 0.8

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("#page html body main article section div td th center form fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | set(
    "address aside blockquote caption dd details dialog dir dl dt figcaption figure footer frameset header hgroup hr legend li menu nav ol optgroup option p pre search select summary table tbody tfoot thead tr ul".split())
#: Their text is not markup, up to their end tag.
RAW = set("script style title textarea iframe noembed noframes noscript xmp".split())
GONE = RAW | set("head nav footer aside form template select button svg canvas audio video object dialog menu search".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
#: Words of class names and ids. Those of OTHERS go whatever they hold; the rest stay where they hold the main element or first heading.
OTHERS = set("ad ads advert adverts advertisement sponsor sponsored promo comment comments reply replies respond disqus related recommended".split())
NOT_ARTICLE = OTHERS | set(
    "banner breadcrumb breadcrumbs consent cookie cookies gdpr header footer login masthead menu nav navbar navigation newsletter notice notices pager pagination popup search share sharing sidebar signup social subscribe toolbar topbar widget".split())
STEMS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor")
ENDS = ("navbar", "topnav", "menu", "sidebar", "footer")
NEGATED = {"has", "with", "no", "without", "hide"}
OWN_HEADER = {"article", "entry", "post", "story", "content", "section"}

#: Families of elements that a new one closes: members, and elements beyond which none is closed.
FAMILIES = {
    "p": ({"p"}, {"table", "td", "th", "caption", "button", "object"}), "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
_IN_FAMILY = {tag: [f for f, (members, edges) in FAMILIES.items() if tag in members | edges] for members_, edges_ in FAMILIES.values() for tag in members_ | edges_}
_CLOSES = {"li": ["li"], "dt": ["dd"], "dd": ["dd"], "td": ["td"], "th": ["td"], "tr": ["td", "tr"], "tbody": ["td", "tr", "tbody"], "thead": ["td", "tr", "tbody"], "tfoot": ["td", "tr", "tbody"], "option": ["option"]}

INSIDE_P = set("option optgroup legend caption tr td th tbody thead tfoot".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HREF = re.compile(r"(?i)(?<![\w-])href")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMAS = re.compile("[,،、，]")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kinds are `text`, `open` and `close`."""
    at, lower = 0, None
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            break
        if lt > at:
            yield "text", page[at:lt], ""
        tag = _TAG.match(page, lt)
        if tag:
            at, name = tag.end(), tag[2].lower()
            yield ("close" if tag[1] else "open"), name, tag[3]
            if not tag[1] and name in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(page) else -1
                if end < 0 and len(lower) != len(page):  # a letter whose lower case is longer
                    found = re.compile(f"(?i)</{name}").search(page, at)
                    end = found.start() if found else -1
                at = len(page) if end < 0 else end
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = len(page) if end < 0 else end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
        elif page[lt + 1 : lt + 2].isascii() and page[lt + 1 : lt + 2].isalpha():  # a tag that the page's end cuts
            return
        else:
            yield "text", "<", ""
            at = lt + 1
    if at < len(page):
        yield "text", page[at:], ""


def goes(tag: str, attributes: str, in_article: bool) -> int:
    """0: stays, 1: goes, 2: goes unless it holds the main element or the page's first heading."""
    if tag == "form":
        return 2
    if tag in GONE or tag == "header" and not in_article:
        return 1
    if not attributes or tag in ("html", "body", "main"):
        return 0
    kind = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            kind = kind or 2 * (value.strip().lower() in ROLES)
            continue
        for word in value.split():
            parts = {p.lower() for p in _PARTS.findall(word)}
            hits = {p for p in parts if p in NOT_ARTICLE or p.startswith(STEMS) or p.endswith(ENDS)}
            if not hits or parts & NEGATED or hits == {"header"} and (in_article or parts & OWN_HEADER):
                continue
            others = any(h in OTHERS or h.startswith(("advert", "comment", "sponsor")) for h in hits)
            if others or tag != "article":
                kind = 1 if others or kind == 1 else 2
    return kind


class Page:
    """Block elements of a page (tag, parent, what goes, links that begin in it) and its blocks of text in page order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.kind, self.links = ["#page"], [-1], [0], [0]
        self.block_children, self.blocks, self.title = [False], [], [False]
        self._parts: list[str] = []
        self._linked = 0
        self._build(page)

    def _flush(self, element: int) -> None:
        if self._parts:
            raw = "".join(self._parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                self.blocks.append((element, text, min(1.0, self._linked / len(raw))))
            self._parts, self._linked = [], 0

    def _build(self, page: str) -> None:
        stack, link = [0], -1  # open elements; the one in which the open link began
        n_open: dict[str, int] = {}
        scopes: dict[str, list[tuple[int, bool]]] = {f: [] for f in FAMILIES}  # depth, is a member

        def pop_to(depth: int) -> None:
            nonlocal link
            while len(stack) > depth:
                e = stack.pop()
                self._flush(e)
                n_open[self.tag[e]] -= 1
                for f in _IN_FAMILY.get(self.tag[e], ()):
                    scopes[f].pop()
                link = -1 if link == e else link

        for kind, name, attributes in tokens(page):
            element = name in BLOCKS or name in GONE
            if kind == "text":
                self._parts.append(name)
                self._linked += len(name) if link >= 0 else 0
            elif name == "a":
                link = stack[-1] if kind == "open" and _HREF.search(attributes) else -1
                self.links[stack[-1]] += link >= 0
            elif name == "br":
                self._parts.append(" ")
            elif not element:
                continue
            elif kind == "open":
                self._flush(stack[-1])
                if name in BLOCKS and name not in INSIDE_P:
                    pop_family(scopes["p"], pop_to)
                for family in _CLOSES.get(name, ()):
                    pop_family(scopes[family], pop_to)
                if name in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                    pop_to(len(stack) - 1)
                if name in VOID:
                    continue
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.kind.append(goes(name, attributes, n_open.get("article", 0) > 0))
                self.links.append(0)
                self.block_children.append(False)
                self.title.append(name in ("main", "h1"))
                self.block_children[stack[-1]] = True
                for f in _IN_FAMILY.get(name, ()):
                    scopes[f].append((len(stack), name in FAMILIES[f][0]))
                stack.append(len(self.tag) - 1)
                n_open[name] = n_open.get(name, 0) + 1
            else:
                self._flush(stack[-1])
                if n_open.get(name):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != name:
                        depth -= 1
                    pop_to(depth)
        self._flush(stack[-1])


def pop_family(scope: list[tuple[int, bool]], pop_to) -> None:
    """Closes the innermost open member of a family, unless an edge lies inside it."""
    if scope and scope[-1][1]:
        pop_to(scope[-1][0])


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by an empty line."""
    tree = Page(page or "")
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    title, gone = tree.title, [False] * n
    for e in range(n - 1, 0, -1):  # children come after their parents
        title[parent[e]] |= title[e]
    for e in range(1, n):
        gone[e] = gone[parent[e]] or tree.kind[e] == 1 or (tree.kind[e] == 2 and not title[e])
    blocks = [b for b in tree.blocks if not gone[b[0]]]

    length, linked, links = [0.0] * n, [0.0] * n, list(tree.links)
    for e, text, share in blocks:
        length[e] += len(text)
        linked[e] += len(text) * share
    for e in range(n - 1, 0, -1):
        for total in (length, linked, links):
            total[parent[e]] += total[e]

    def link_share(e: int) -> float:
        return linked[e] / length[e] if length[e] else 0.0

    menu = [False] * n
    for e in range(1, n):
        menu[e] = menu[parent[e]] or (links[e] > 2 and link_share(e) > MENU and tag[e] in ("ul", "ol", "dl", "table", "div", "section"))
    blocks = [b for b in blocks if not menu[b[0]]]

    outer = [0] * n  # the container around an element
    for e in range(1, n):
        outer[e] = parent[e] if tag[parent[e]] in CONTAINERS else outer[parent[e]]
    points, own = [0.0] * n, [0.0] * n
    for e, text, share in blocks:
        if tag[e] not in HEADINGS:
            worth = (len(_COMMAS.findall(text)) + len(text) / 100 + min(1.0, len(text) / 25)) * (1 - share)
            own[e] += worth
            at = e if tag[e] in CONTAINERS and tree.block_children[e] or not e else outer[e]
            for _ in range(LEVELS):
                points[at] += worth
                worth /= 2
                if not at:
                    break
                at = outer[at]
    score = [p * (1 - link_share(e)) for e, p in enumerate(points)]
    best = max(range(n), key=score.__getitem__)
    if not score[best]:
        rest = {tag[e]: e for e, *_ in reversed([(x, None) for x in range(n) if length[x] and tag[x] in ("article", "main", "body")])}
        best = rest.get("article", rest.get("main", rest.get("body", 0)))
    top = best
    while top and tag[top] != "article":
        top = parent[top]
    best = top or best

    def beside(e: int) -> bool:
        """Whether a sibling of the best container belongs to the article."""
        if tag[best] == "article" and tag[e] != "article" or link_share(e) > LINKED:
            return False
        return tag[e] in HEADINGS or max(score[e], own[e]) >= SIBLING * score[best] or (tag[e] == "p" and not linked[e] and (length[e] > 80 or ends.get(e, "")[-1:] in ".!?"))

    ends = {e: text for e, text, _ in blocks}
    inside = [False] * n
    for e in range(n):
        inside[e] = e == best or (e > 0 and inside[parent[e]]) or (best > 0 and e > 0 and parent[e] == parent[best] and bool(length[e]) and beside(e))
    direct = best > 0 and tag[best] != "article"  # sentences that lie beside the container itself
    kept = [(e, text) for e, text, share in blocks if inside[e] or (direct and e == parent[best] and not share and (len(text) > 80 or text[-1] in ".!?"))]
    if not any(tag[e] == "h1" for e, _ in kept):
        first = next((e for e, _ in kept), 0)
        above = [(e, text) for e, text, _ in blocks if tag[e] == "h1" and e < first]
        kept = above[-1:] + kept
    return "\n\n".join(text for _, text in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars): the main text of each page's html and its code points."""
    small_batches(pages.sparkSession)

    def run(batches):
        resident("html", dict)
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
