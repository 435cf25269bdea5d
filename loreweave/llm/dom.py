"""Block trees of HTML pages, and their alignment by simple tree matching.

Only block elements are nodes; inline elements belong to the text around them. A node's label is its tag with its id and the names of
its classes; siblings with one label are one repeated slot, so that pages with more or fewer paragraphs have one skeleton. Trees are
walked with stacks of their own and skeletons are flat lists, so pages may be nested as deeply as they like.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

#: Fixed values of the HTML standard: elements without content, elements whose content is no markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>?", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, up to the nearest of the third.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
}
_SCOPE = frozenset("article aside body button dialog div footer form header html li main nav object section table td th".split())

#: Elements that hold no text of a page, wherever they stand.
GONE = frozenset("button canvas datalist embed frameset head iframe input label legend noembed noframes noscript object optgroup option script select style svg template textarea title".split())
#: Elements that are furniture by what the standard says of them, and those that hold the main text.
FURNITURE = frozenset("aside dialog fieldset footer form menu nav search".split())
MAIN = frozenset(["article", "main"])
#: Elements that hold one paragraph, and headings of a page.
PARAGRAPH = frozenset("address caption center dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
NAMED, MAINLY = 1, 2
#: Names (parts of class and id values) that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
NAMES = frozenset(
    """ad ads adbox adslot adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies copyright disclaimer disqus footer footers form gdpr header login masthead menu menus menubar modal nav navbar navigation newsletter notice
    notices notification overlay pager pagination paywall popup promo promos promoted promotion recommended register related replies reply responses search share
    sharing sidebar sidebars sidenav signin signup skip social sponsor sponsored subscribe subscription tags teaser teasers toc toolbar topbar tracking widget widgets""".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Inside an article these names mark its own headline, not the page's header.
_OWN = frozenset(["header", "banner", "masthead"])


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    gone: bool
    flag: int  # NAMED: furniture by its tag, role or name; MAINLY: an article or main element
    up: Node | None
    children: list[Node] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # of a block
    linked: int = 0  # characters inside links, of a block


def _names(value: str) -> list[str]:
    return [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)]


@lru_cache(20_000)
def _judge(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    """Label, whether the element is gone, whether it is named furniture, and whether that holds only outside articles."""
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw else {}
    kinds, own_id = values.get("class", "").split(), values.get("id", "")
    # A number of one or two digits tells columns apart, a longer one is that of a page.
    label = ".".join([tag, *sorted(re.sub(r"\d{3,}", "#", k) for k in kinds)])
    if re.fullmatch(r"[A-Za-z][A-Za-z_-]*\d*", own_id):
        label += "#" + re.sub(r"\d+", "", own_id)
    if tag in GONE or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
        return label, True, False, False
    if tag in FURNITURE or values.get("role", "").lower() in ROLES:
        return label, False, True, False
    if tag in ("html", "body", "main"):
        return label, False, False, False
    found = set()
    for value in (*kinds, own_id):
        names = _names(value)
        if not {"with", "has", "no", "without"} & set(names):  # "content-with-sidebar" is no sidebar
            found |= NAMES & {*names, *(a + b for a, b in zip(names, names[1:], strict=False))}  # "side-bar" is a sidebar
    own = found and found <= _OWN
    return label, False, bool(found) or tag == "header", bool(own) or (tag == "header" and not found)


def parse(page: str) -> Node:
    """The block tree of a page. Broken and unfinished markup is taken as far as it goes."""
    root = Node("#", "#", False, 0, None)
    at, here, links, silent = 0, root, 0, 0  # silent: left out inline elements that are open
    is_open: Counter = Counter()  # tags of here and the elements around it

    def say(text: str) -> None:
        blocks = here.children
        if not blocks or blocks[-1].tag != "#text":
            if not text.strip():
                return
            blocks.append(Node("#text", "#text", False, 0, here))
        blocks[-1].text.append(text)
        if links:
            blocks[-1].linked += len(text.strip())

    def leave(node: Node) -> None:
        """Closes node and all that is open inside it."""
        nonlocal here, links, silent
        while here is not node:
            is_open[here.tag] -= 1
            here = here.up
        is_open[node.tag] -= 1
        here, links, silent = node.up, 0, 0

    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside a script or the like
            continue
        if m.start() > at and not silent:
            text = page[at : m.start()]
            say(html.unescape(text) if "&" in text else text)
        at = m.end()
        closing, tag, rest = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                node = here if is_open[tag] else root  # an end without a start costs no walk
                while node is not root and node.tag != tag:
                    if tag not in _SCOPE and node.tag in _SCOPE:
                        node = root
                        break
                    node = node.up
                if node is not root:
                    leave(node)
            elif silent:
                silent -= 1
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in RAW and not rest.endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID and tag != "hr":
            continue
        label, gone, named, outside = _judge(tag, rest)
        if named and outside and (is_open["article"] or is_open["main"]):
            named = False
        if tag in BLOCK:
            if tag in _ENDS_P and is_open["p"]:
                node = here
                while node is not root and node.tag != "p" and node.tag not in _SCOPE:
                    node = node.up
                if node.tag == "p":
                    leave(node)
            if tag in _IMPLIED:
                ends, stop = _IMPLIED[tag]
                node = here
                while any(is_open[e] for e in ends) and node is not root and node.tag not in stop:
                    up = node.up
                    if node.tag in ends:
                        leave(node)
                    node = up
            node = Node(tag, label, gone, NAMED if named else MAINLY if tag in MAIN else 0, here)
            here.children.append(node)
            if tag != "hr" and not rest.endswith("/"):
                here = node
                is_open[tag] += 1
        elif silent or ((gone or named) and not rest.endswith("/")):
            silent += 1
        elif tag == "a":
            links += 1
    if not silent and not re.match(r"<[/!a-zA-Z]", page[at : at + 2]):
        say(html.unescape(page[at:]))
    return root


@dataclass(slots=True)
class Skeleton:
    """Slots of a page that have text below them, each after the one around it and its elder siblings. Slot 0 is the page."""

    labels: list[str]
    parents: list[int]
    flags: list[int]

    @property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for k, p in enumerate(self.parents[1:], 1):
            out[p].append(k)
        return out


@dataclass(slots=True)
class Block:
    slot: int
    text: str
    linked: int  # characters inside links


def read(page: str) -> tuple[Skeleton, list[Block]]:
    """The skeleton of a page, and its text blocks in order. White space inside a block is one space; gone elements have none."""
    labels, parents, flags, ids, found = ["#"], [-1], [0], {}, []
    stack = [(iter(parse(page).children), 0)]
    while stack:
        rest, at = stack[-1]
        node = next(rest, None)
        if node is None:
            stack.pop()
            continue
        if node.gone:
            continue
        text = _SPACE.sub(" ", "".join(node.text)).strip() if node.tag == "#text" else ""
        if node.tag == "#text" and not text:
            continue
        slot = ids.setdefault((at, node.label), len(labels))
        if slot == len(labels):
            labels.append(node.label)
            parents.append(at)
            flags.append(node.flag)
        if text:
            found.append(Block(slot, text, node.linked))
        else:
            stack.append((iter(node.children), slot))
    # Slots without text go, and the others are numbered anew in the order of the tree: equal trees get equal numbers.
    full = [False] * len(labels)
    for b in found:
        slot = b.slot
        while slot >= 0 and not full[slot]:
            full[slot], slot = True, parents[slot]
    full[0] = True
    below: list[list[int]] = [[] for _ in labels]
    for k in range(len(labels) - 1, 0, -1):
        if full[k]:
            below[parents[k]].append(k)
    new, order, open_ = [-1] * len(labels), [], [0]
    while open_:
        k = open_.pop()
        new[k] = len(order)
        order.append(k)
        open_ += below[k]
    for b in found:
        b.slot = new[b.slot]
    return Skeleton([labels[k] for k in order], [new[parents[k]] if k else -1 for k in order], [flags[k] for k in order]), found


def _heaviest(pairs: list[tuple[int, int]]) -> list[int]:
    """Which of the pairs (place, weight) make the heaviest run of rising places."""
    places: list[int] = []
    best: list[int] = []
    last: list[int] = []
    before = []
    for k, (place, weight) in enumerate(pairs):
        i = bisect_left(places, place)
        total = weight + (best[i - 1] if i else 0)
        before.append(last[i - 1] if i else -1)
        j = i
        while j < len(best) and best[j] <= total:
            j += 1
        places[i:j], best[i:j], last[i:j] = [place], [total], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out


def align(wrapper: Skeleton, page: Skeleton) -> list[int]:
    """For each slot of the page its slot in the wrapper, or -1. Simple tree matching: the most slots that can be paired top down, in
    order and by label. Siblings have different labels, so only slots with one path of labels can meet."""
    theirs, mine = wrapper.children, page.children
    pairs, below = [(0, 0)], [[]]
    for k, (a, b) in enumerate(pairs):  # grows while it is walked
        at = {wrapper.labels[x]: x for x in theirs[a]}
        for y in mine[b]:
            if (x := at.get(page.labels[y])) is not None:
                below[k].append(len(pairs))
                pairs.append((x, y))
                below.append([])
    size, chosen = [1] * len(pairs), [[]] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        chosen[k] = [below[k][i] for i in _heaviest([(pairs[x][0], size[x]) for x in below[k]])]
        size[k] += sum(size[x] for x in chosen[k])
    out, open_ = [-1] * len(page.labels), [0]
    while open_:
        k = open_.pop()
        out[pairs[k][1]] = pairs[k][0]
        open_ += chosen[k]
    return out
