"""Main text of web pages by scoring the element tree.

A page is read once, tag by tag, into a tree; unclosed, stray and wrongly nested tags are taken as browsers take them, as
far as text needs it. Elements that never hold main text (scripts, menus, adverts …) are left out by tag, role or
name, forms, notices and discussions unless the title or the article stands in them; a name that may stand for main text as well (widget, related …) counts only if the element's own text is no prose, and
if nothing is left, names do not count. Every paragraph gives points for its length and commas, discounted by its link density, to its parent and half of
them to its grandparent. From the container with the most points the way leads up to the main around it, or without one as
far as the text is mostly prose, but at least to the outermost article. All that stands there is kept in page order, whatever
its tag or length, but for what stands beside that way and is mostly links (headings stay). A header is the site's only outside of
article and main.

Pages are handled row by row in Arrow batches: no shuffle, and no limit on the size of a page.

Defined cases: null and empty pages, and pages without text, give an empty text; a page without scored paragraphs gives
the text of its body that is not left out; repeated pages are read each for itself; extra columns are kept, but for an
old one named main_text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# a comment, a declaration, or the start of a tag; and the rest of a tag, with and without regard to quotes
_START = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_QUOTED = re.compile(r"""((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>""")
_UNQUOTED = re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([^\s=/"'>]+)""")
_BLANK = re.compile(r"\s+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# their content is not markup
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I) for tag in RAW}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = BLOCK - set("p h1 h2 h3 h4 h5 h6 hr pre dt dd li table tbody thead tfoot tr td th".split())
PARAGRAPH = set("p pre td blockquote li dd div section article main figcaption".split())
# an opening tag ends these open ones, up to the element named as a border
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SKIPPED = RAW | set(
    "head nav footer aside button select option input label object svg canvas template dialog menu audio video map"
    " fieldset datalist".split()
)
SKIPPED_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split()
)
# words of a class or id that name what is no main text, as the last or the first word …
SKIPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos"
    " sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar cookie cookies consent"
    " gdpr popup modal newsletter subscribe signup login comment comments commentlist disqus respond pagination pager toolbar"
    " skip outbrain taboola hidden ft".split()
)
# … also as the last word, unless the element holds the title or the article
TITLE_NAMES = set(
    "notice notices notification notifications alert alerts disclaimer copyright discussion discussions reply replies responses".split()
)
# … and what mostly is none, as the last word, unless the element holds prose
WEAK_NAMES = set(
    "widget widgets related recommended recommendations social share sharing tags banner banners overlay promotion"
    " subscription".split()
)
# … also with one of these behind them, but not behind one of those
TAILS = set(
    "wrapper wrap container box block blocks list section area inner bar panel links link button buttons message messages"
    " form thread posts post articles stories items item content text unit slot body holder group".split()
)
MODIFIERS = set("has with no is without not".split())
# "comments-open" is a state of the article
STATES = set("open opened closed off on enabled disabled none false free less".split())
# words of the article itself
KEPT_NAMES = set("article content main body post entry story text".split())
# a header of these is the article's, if it holds the title
TITLE_HEADERS = set("page title".split())
POSITIVE = 25
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# named for something else: left out in any case, without a title or article in it, without prose, if mostly links
SURE, UNTITLED, UNLESS_PROSE, LINKED = 4, 3, 2, 1
# characters outside links of a block of prose
PROSE = 150
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    __slots__ = ("tag", "parent", "children", "skipped", "bonus", "chars", "links", "commas")
    __slots__ += ("all_chars", "all_links", "longest", "titled", "named", "container")

    def __init__(self, tag: str, parent: Element | None, skipped: bool = False, bonus: int = 0, named: int = 0):
        self.tag, self.parent, self.skipped, self.bonus, self.named = tag, parent, skipped, bonus, named
        # the nearest container around it
        self.container = parent if parent is None or parent.tag in CONTAINER else parent.container
        self.children: list[Element | str] = []
        # characters, characters in links and commas of what stands in the element itself, not in blocks below it
        self.chars = self.links = self.commas = 0
        # of all that is not left out; the longest block's characters outside links; an article, main or h1 in it
        self.all_chars = self.all_links = self.longest = 0
        self.titled = False


def _described(tag: str, attributes: str, framed: bool = False) -> tuple[bool, int, int]:
    """(left out, points, named for something else) by tag and attributes. ``framed``: a header within an article or main."""
    if tag in SKIPPED:
        return True, 0, 0
    bonus = POSITIVE if tag in ("article", "main") else 0
    if not attributes or attributes.isspace():
        return tag == "header" and not framed, bonus, UNTITLED if tag == "form" else 0
    named: dict[str, str] = {}
    for key, value, bare in _ATTRIBUTE.findall(attributes):
        named.setdefault((key or bare).lower(), value.strip("\"'"))
    style = named.get("style", "").replace(" ", "").lower()
    if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style:
        return True, 0, 0
    if named.get("role", "").lower() in SKIPPED_ROLES:
        return True, 0, 0
    names = [
        [w.lower() for w in _PART.findall(name) if not w.isdigit()]
        for name in f"{named.get('class', '')} {named.get('id', '')}".split()
    ]
    if tag in ("article", "main", "body", "html"):
        return False, bonus, 0
    if tag == "form":
        return False, 0, UNTITLED
    if tag == "header" and not framed:
        return True, 0, 0
    other = max(map(_named_other, names), default=0)
    words = {w for name in names for w in name}
    if "header" in words and other < UNTITLED:
        if words & TITLE_HEADERS:
            return False, 0, UNTITLED
        return False, 0, SURE if not words & KEPT_NAMES and tag != "h1" and not framed else other
    return False, POSITIVE if words & KEPT_NAMES and other < UNTITLED else 0, other


def _named_other(words: list[str]) -> int:
    """How surely a class or id names something else than main text: "main-nav", "ad-box", but not "has-sidebar"."""
    while len(words) > 1 and words[-1] in TAILS:
        words = words[:-1]
    if not words or words[0] in MODIFIERS:
        return 0
    if words[-1] in SKIPPED_NAMES:
        return SURE
    if words[-1] in TITLE_NAMES or words[0] in SKIPPED_NAMES and words[-1] not in STATES:
        return UNTITLED
    if words[-1] in WEAK_NAMES:
        # "elementor-widget" is a part of any kind
        return LINKED if words[-1] in ("widget", "widgets") and len(words) > 1 else UNLESS_PROSE
    return 0


def _left_out(element: Element) -> bool:
    """Whether the element's own text confirms its name."""
    if element.named in (0, SURE):
        return element.named == SURE
    if element.named == UNTITLED:
        return not element.titled
    if element.named == LINKED:
        return 2 * element.all_links > element.all_chars
    return 4 * element.all_links > element.all_chars or element.longest < PROSE


class _Path:
    """The open elements from the root down, and where each tag stands among them: nothing is found by walking up."""

    def __init__(self, root: Element):
        self.open: list[Element] = [root]
        self.places: dict[str, list[int]] = {}
        self.borders: list[int] = []  # places of what an open paragraph does not reach across

    @property
    def last(self) -> Element:
        return self.open[-1]

    def nearest(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0, the root, if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def outermost(self, tags: Iterable[str], below: int) -> int:
        """Place of the outermost open element of these tags below a place; 0 if there is none."""
        found = [held[i] for t in tags if (held := self.places.get(t)) and (i := bisect_right(held, below)) < len(held)]
        return min(found, default=0)

    def enter(self, element: Element) -> None:
        place = len(self.open)
        self.open.append(element)
        self.places.setdefault(element.tag, []).append(place)
        if element.tag in CONTAINER or element.tag in ("li", "dd", "dt"):
            self.borders.append(place)

    def close(self, place: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()
        while self.borders and self.borders[-1] >= place:
            self.borders.pop()


def parse(page: str, by_name: bool = True) -> Element:
    """The page's tree; text stands in it as it is in the page, character references included.

    ``by_name=False``: no element is left out for its class or id. The time taken grows with the length of the page,
    whatever is broken in it.
    """
    root = Element("#root", None)
    path, elements = _Path(root), [root]
    position, rest = 0, _QUOTED

    def add(tag: str, *described) -> Element:
        element = Element(tag, path.last, *described)
        path.last.children.append(element)
        elements.append(element)
        return element

    while (m := _START.search(page, position)) is not None:
        tag, attributes, end = (m[2] or "").lower(), "", m.end()
        if tag:
            inside = rest.match(page, end)
            if inside is None and rest is _QUOTED:
                # a quote that nothing closes: from here on tags end at the next bracket, as no second look is affordable
                rest = _UNQUOTED
                inside = rest.match(page, end)
            if inside is None:
                break  # no tag ends any more
            attributes, end = inside[1], inside.end()
        if m.start() > position:
            path.last.children.append(page[position : m.start()])
        position = end
        if not tag:
            continue
        if m[1]:
            place = path.nearest((tag,))
            if place:
                path.close(place)
            elif tag in ("p", "br"):
                add(tag)
            continue
        if tag in BLOCK and (place := path.nearest(("p",))) > (path.borders[-1] if path.borders else 0):
            path.close(place)  # a block ends an open paragraph, and the inline elements in it
        if tag in ENDS:
            ended, border = ENDS[tag]
            if place := path.outermost(ended, path.nearest(border)):
                path.close(place)
        own = add(tag, *_described(tag, attributes, tag == "header" and path.nearest(("article", "main")) > 0))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            position = _END_OF[tag].search(page, position).end()
            continue
        path.enter(own)
    path.last.children.append(page[position:])
    _measure(elements, by_name)
    return root


def _measure(elements: list[Element], by_name: bool) -> None:
    """Counts the text of all elements, given parents first, from the innermost outwards, and judges their names by it."""
    for element in reversed(elements):
        for child in element.children:
            if isinstance(child, str):
                text = _BLANK.sub(" ", child)
                length = len(text) if text != " " else 0
                element.chars += length
                element.all_chars += length
                element.commas += text.count(",")
        if element.tag == "a":
            element.links, element.all_links = element.chars, element.all_chars
        element.longest = max(element.longest, element.chars - element.links)
        element.skipped = element.skipped or by_name and _left_out(element)
        above = element.parent
        if element.skipped or above is None:
            continue
        above.longest = max(above.longest, element.longest)
        above.titled |= element.titled or element.tag in ("article", "main", "h1")
        above.all_chars += element.all_chars
        above.all_links += element.all_links
        if element.tag not in BLOCK:
            above.chars += element.chars
            above.links += element.links
            above.commas += element.commas


def _blocks_of(root: Element) -> Iterator[Element]:
    """All elements that are not left out, in page order."""
    stack = [root]
    while stack:
        element = stack.pop()
        yield element
        stack += [c for c in reversed(element.children) if not isinstance(c, str) and not c.skipped]


def best(root: Element) -> list[Element]:
    """The frame around the container with the most points, without link lists; empty if no paragraph scores."""
    scored: dict[Element, float] = {}
    for element in _blocks_of(root):
        if element.tag not in PARAGRAPH or element.chars < 2:
            continue
        points = (1 + element.commas + min(element.chars / 100, 3)) * (1 - element.links / element.chars)
        own = element if element.tag in CONTAINER else element.container
        if own is None:
            continue
        for container, share in ((own, 1.0), (own.container, 0.5)):
            if container is not None:
                scored[container] = scored.get(container, container.bonus) + points * share
    scored = {e: s for e, s in scored.items() if e.tag not in ("html", "#root")}
    if not scored:
        return []
    path = [max(scored, key=scored.get)]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    outer = next((e for e in reversed(path) if e.tag in ("article", "main")), None)
    around = outer is None
    for frame, parent in zip(path, path[1:]):
        if frame is outer and frame.tag == "main":
            return [frame]
        around |= frame is outer
        if around and 2 * parent.all_links > parent.all_chars:
            return [frame]
        _leave_out_links(parent, frame)
    return path[-1:]


def _leave_out_links(parent: Element, frame: Element) -> None:
    """Leaves out what is mostly links beside the frame; headings stay."""
    children: list[Element | str] = []
    run: list[Element | str] = []  # text and inline elements that follow each other are judged together
    for child in [*parent.children, None]:
        if child is not None and child is not frame and (isinstance(child, str) or child.tag not in BLOCK):
            run.append(child)
            continue
        inline = [c for c in run if not isinstance(c, str) and not c.skipped]
        chars = sum(len(_BLANK.sub(" ", c)) for c in run if isinstance(c, str)) + sum(c.all_chars for c in inline)
        if 2 * sum(c.all_links for c in inline) <= chars:
            children += run
        run = []
        if child is not None:
            if child is not frame and child.tag not in HEADINGS and 2 * child.all_links > child.all_chars:
                child.skipped = True
            children.append(child)
    parent.children = children


def _text(elements: list[Element]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _BLANK.sub(" ", html.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    # elements to be opened, or None at the end of a block
    stack: list[Element | str | None] = list(reversed(elements))
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            line.append(item)
        elif item.skipped:
            if item.tag in BLOCK:
                close()
        elif item.tag == "br":
            line.append(" ")
        else:
            if item.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(item.children)
    close()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    """The page's main text: blocks in page order, one per line."""
    if not page:
        return ""
    for by_name in (True, False):
        root = parse(page, by_name)
        text = _text(best(root) or [root])
        if text:
            break
    return text


def with_main_text(pages: DataFrame, name: str = "main_text", source: str = "html") -> DataFrame:
    """Adds the main text of every page."""

    @F.pandas_udf("string")
    def main_text(batch: pd.Series) -> pd.Series:
        return batch.map(extract, na_action=None)

    return pages.withColumn(name, main_text(F.col(source)))
