"""Operator 1, HTML extraction: union-free wrappers inferred per host, then the article's text from each page.

A page's token stream becomes a tree of elements (name, class, id) and text. Equal neighbours collapse to
repeated groups. The wrapper of a host is the alignment of all its pages' trees: where two sequences of children
disagree, what only one has becomes optional, runs of equal groups become repeated, and texts that differ become
slots. Wrappers align with wrappers in the same way, so each task folds its own pages, and the few partial
wrappers of a host meet in two rounds: a host with a third of all pages is no larger for any task than others.

A wrapper tells what a page alone can't: which texts are constant on a host, which groups are lists of links, and
which element holds the varying text. On a page with article or main elements those are the article, less the
elements with a class or id of their own whose text is constant over different articles of the host (a call to share, a
tagline). On other pages the article is the wrapper's element with most of the varying text, less constant texts
and link lists. Template parts (see DROP_*) go everywhere. Where that would leave nothing, less is taken away.

Rows: null html, and pages without text, give the empty string; an empty table gives no rows. A null url is the
host "". Repeated rows are extracted alike, and copies of a page count once when constant texts are found. Other
columns are not read, whatever their names. Long pages and deep nesting take time and memory in proportion: nothing
recurses, and the children of an element are aligned in n log n steps. Broken markup is read as browsers do in
spirit: unknown ends are ignored, open ones close.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import materialise, slices

# Element and class names by their common meaning on the web.
DROP_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg canvas object dialog head title menu".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments commentlist respond reply replies disqus widget pagination pager toolbar skip".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe"))
LISTS = frozenset("ul ol div section table dl header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = ("ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body", "td", "th")
CELLS = frozenset(("tr", "td", "th"))

#: A tag as nearly all are: no "<" inside, quotes closed. It is one that the scan below would find, and never looks beyond the next "<".
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*+)(?=[\s/>])([^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+)>")
NAME_END = re.compile(r"[\s/>]")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

#: Children up to which a wrapper element aligns them in order. Beyond, those of one name become one, and what doesn't fit
#: stands in a group "#rest", by name and whole: decisions speak of it like of the others.
WIDEST = 60
#: Class and id values from this length on are named by their digest.
LONG_NAME = 60
#: Pages with the same text before it counts as constant; share of varying text that a content element must hold.
CONSTANT, HOLDS = 3, 0.6
#: Wrappers up to this many bytes in all are broadcast; more are joined by host.
BROADCAST_BYTES = 32 << 20
FLUSH_HOSTS = 2000
SALTS = 64


def signature(tag: str, attributes: str) -> tuple[str, bool]:
    """(name with class and id, whether the element is a template part)."""
    if "=" not in attributes:
        return tag, tag in DROP_TAGS
    drop, parts = tag in DROP_TAGS, [tag]
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind == "role":
            drop |= value.strip() in DROP_ROLES
        else:
            drop |= tag not in ("html", "body") and not DROP_WORDS.isdisjoint(WORD.findall(value))
            own = re.sub(r"\d+", "0", value.strip())
            parts.append(("." if kind == "class" else "#") + (own if len(own) < LONG_NAME else _digest(own)))
    return "".join(parts), drop


class Open:
    """The open elements of a page; where the last of a tag stands is known without a search."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.at[tag].pop()
        return tag

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def reaches(self, tag: str) -> bool:
        """Whether the last open `tag` can be closed from here: nothing that shields it stands above."""
        own = self.last(tag)
        return own >= 0 and all(self.last(s) <= own for s in (("table",) if tag in CELLS else SCOPE))


class Marks:
    """Where the tags, comments and declarations of a page stand.

    A tag ends at the first ">" outside quotes; a "<" whose tag has no end is text. What a scan met at a quote or at a ">" is remembered, so
    that any number of open "<" costs no more than one pass.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.stop = (0, -1)  # from here on the next of > " ' is there
        self.name = (0, -1)  # from here on names end there
        self.open_names: set[int] = set()  # ends of names that no tag's end follows, whichever quotes are theirs
        self.ends: dict[int, int] = {}  # from a quote outside of quotes: the tag's end, -1 without one

    def next_stop(self, at: int) -> int:
        begin, found = self.stop
        if not begin <= at <= found:
            m = STOP.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.stop = (at, found)
        return found

    def name_end(self, at: int) -> int:
        begin, found = self.name
        if not begin <= at <= found:
            m = NAME_END.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.name = (at, found)
        return found

    def end_of(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin here; -1 without one."""
        passed, end = [], -1
        while at <= self.last:
            at = self.next_stop(at)
            if at >= len(self.page):
                break
            if self.page[at] == ">":
                end = at
                break
            if at in self.ends:
                end = self.ends[at]
                break
            passed.append(at)
            closing = self.page.find(self.page[at], at + 1)
            if closing < 0:
                break
            at = closing + 1
        self.ends |= dict.fromkeys(passed, end)
        return end

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, slash, name, attributes) of the first mark from here on; the name of what is no tag is empty."""
        page, n = self.page, len(self.page)
        begin = page.find("<", at)
        while begin >= 0:
            m = PLAIN.match(page, begin)
            if m:
                return begin, m.end(), m[1], m[2], m[3]
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else n - (page.endswith("\n") and n - 1 >= begin + 4), "", "", ""
            if begin > self.last:
                begin = page.find("<!--", begin)
                continue
            if page[begin + 1 : begin + 2] in ("!", "?"):
                return begin, page.find(">", begin) + 1, "", "", ""
            slash = page[begin + 1 : begin + 2] == "/"
            first = begin + 1 + slash
            stop = self.name_end(first) if page[first : first + 1] in LETTERS else 0
            if stop and stop not in self.open_names:
                # a quote may stand in a name; without an end then it begins the attributes
                for cut in chain((stop,), (k for k in range(stop - 1, first, -1) if page[k] in "\"'")):
                    end = self.end_of(cut)
                    if end >= 0:
                        return begin, end + 1, "/" * slash, page[first:cut], page[cut:end]
                self.open_names.add(stop)
            begin = page.find("<", begin + 1)
        return None


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """Balanced events of a page: ("<", signature, template part), (">", tag, False), ("t", text, False)."""
    stack = Open()
    at, n, marks = 0, len(page), Marks(page)

    def close(tag: str) -> Iterator[tuple[str, str, bool]]:
        while stack.tags:
            top = stack.pop()
            yield ">", top, False
            if top == tag:
                return

    while at < n:
        mark = marks.find(at)
        if mark is None:
            yield "t", page[at:], False
            break
        begin, end, slash, name, attributes = mark
        if begin > at:
            yield "t", page[at:begin], False
        at = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag == "br":
                yield "<", "br", False
                yield ">", "br", False
            elif stack.last(tag) >= 0:
                yield from close(tag)
            continue
        if tag in BLOCKS and tag not in ("option", "legend") and stack.reaches("p"):
            yield from close("p")
        for other in CLOSED_BY.get(tag, ()):
            if stack.reaches(other):
                yield from close(other)
        name, drop = signature(tag, attributes)
        yield "<", name, drop
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            yield ">", tag, False
        elif tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, marks.last + 1)  # before the last > each one ends
            at = found.end() if found else n
            yield ">", tag, False
        else:
            stack.push(tag)
    while stack.tags:
        yield ">", stack.pop(), False


def tag_of(name: str) -> str:
    return re.split(r"[.#]", name, maxsplit=1)[0]


# A wrapper node is a list: name, dropped, optional, repeated, digests of up to CONSTANT different wholes (the page, or the article around
# it), chars, link chars, digest of the constant text or None, children.
NAME, DROPPED, OPTIONAL, REPEATED, WHOLES, CHARS, LINKS, TEXT, KIDS = range(9)
ANY = "#rest"


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def tree(page: str) -> list:
    """The collapsed tree of one page."""
    own: list[str] = [_digest(page)]
    root = ["#root", False, False, False, own, 0, 0, None, []]
    stack, links = [root], 0
    articles: list[tuple[list, list[str], object]] = []  # open article elements: node, its WHOLES, hash of its texts

    def close() -> None:
        nonlocal links
        node = stack.pop()
        links -= tag_of(node[NAME]) == "a"
        if articles and articles[-1][0] is node:
            _, whole, texts = articles.pop()
            whole[0] = texts.hexdigest()
        _append(stack[-1][KIDS], node)

    for kind, value, drop in events(page):
        if kind == "<":
            whole = articles[-1][1] if articles else own
            if tag_of(value) in MAIN_TAGS:
                whole = [""]
            stack.append([value, drop, False, False, whole, 0, 0, None, []])
            if whole == [""] and tag_of(value) in MAIN_TAGS:
                articles.append((stack[-1], whole, hashlib.blake2b(digest_size=9)))
            links += tag_of(value) == "a"
        elif kind == ">":
            close()
        elif text := " ".join(html.unescape(value).split()):
            name = _digest(text)
            for _, _, texts in articles:
                texts.update(name.encode())
            _append(stack[-1][KIDS], ["#text", False, False, False, articles[-1][1] if articles else own, len(text), len(text) if links else 0, name, []])
    while len(stack) > 1:
        close()
    return root


def _append(kids: list, node: list) -> None:
    """Add a child; a run of equal groups of one to three children becomes one repeated group."""
    kids.append(node)
    for period in (1, 2, 3):
        if len(kids) >= 2 * period and all(kids[-i][NAME] == kids[-i - period][NAME] for i in range(1, period + 1)):
            tail = kids[-period:]
            del kids[-period:]
            for mine, new in zip(kids[-period:], tail, strict=True):
                unite(mine, new)
                mine[REPEATED] = True
            return


def unite(a: list, b: list) -> list:
    """Align node b with a, of one name; a becomes their wrapper."""
    work = [(a, b)]
    while work:
        x, y = work.pop()
        if x[TEXT] != y[TEXT]:
            x[TEXT] = None
        x[WHOLES] = _wholes(x[WHOLES], y[WHOLES])
        for flag in (DROPPED, OPTIONAL, REPEATED):
            x[flag] = x[flag] or y[flag]
        x[CHARS] += y[CHARS]
        x[LINKS] += y[LINKS]
        mine, its = [k[NAME] for k in x[KIDS]], [k[NAME] for k in y[KIDS]]
        if ANY in mine[-1:] + its[-1:] or _length(mine, its) > WIDEST:
            _by_name(x, y, work)
        else:
            x[KIDS] = _align(x[KIDS], y[KIDS], work)
    return a


def _wholes(a: list[str], b: list[str]) -> list[str]:
    return a if a is b or a == b else sorted({*a, *b})[:CONSTANT]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: what both begin and end with, between them the longest one of equally numbered occurrences."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    seen: dict[str, int] = {}
    place: dict[tuple[str, int], int] = {}
    for j in range(first, len(b) - last):
        seen[b[j]] = turn = seen.get(b[j], 0) + 1
        place[b[j], turn] = j
    seen = {}
    tails: list[int] = []  # last place in b of the best run of each length
    chosen: list[tuple[int, int, int]] = []  # (i, j, index of the one before)
    at: list[int] = []
    for i in range(first, len(a) - last):
        seen[a[i]] = turn = seen.get(a[i], 0) + 1
        j = place.get((a[i], turn))
        if j is None:
            continue
        k = bisect_left(tails, j)
        chosen.append((i, j, at[k - 1] if k else -1))
        tails[k : k + 1] = [j]
        at[k : k + 1] = [len(chosen) - 1]
    between = []
    k = at[-1] if at else -1
    while k >= 0:
        i, j, k = chosen[k]
        between.append((i, j))
    return [(k, k) for k in range(first)] + between[::-1] + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def _align(a: list, b: list, work: list) -> list:
    """Align two sequences of children: common ones merge (as new work), the others become optional."""
    out: list = []

    def alone(node: list) -> None:
        node[OPTIONAL] = True
        if out and out[-1][NAME] == node[NAME]:  # an optional beside its like is a repetition
            out[-1][REPEATED] = True
            work.append((out[-1], node))
        else:
            out.append(node)

    i = j = 0
    for p, q in [*_common([x[NAME] for x in a], [x[NAME] for x in b]), (len(a), len(b))]:
        for node in (*a[i:p], *b[j:q]):
            alone(node)
        if p < len(a):
            out.append(a[p])
            work.append((a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def _length(a: list[str], b: list[str]) -> int:
    """How many children `_align` makes of these."""
    n, last, i, j = 0, None, 0, 0
    for p, q in [*_common(a, b), (len(a), len(b))]:
        for name in (*a[i:p], *b[j:q]):
            n, last = n + (name != last), name
        if p < len(a):
            n, last = n + 1, a[p]
        i, j = p + 1, q + 1
    return n


class Rest(list):
    """The children of a group "#rest"; `named` has all children of the element by name, so that a page costs no more than its own."""

    named: dict[str, list]


def _children(node: list) -> list:
    """Children of a wrapper's element, those of the group "#rest" among them."""
    if not node[KIDS] or node[KIDS][-1][NAME] != ANY:
        return node[KIDS]
    return [*node[KIDS][:-1], *node[KIDS][-1][KIDS]]


def _by_name(x: list, y: list, work: list) -> None:
    """Merge y's children into x's by name (as new work); a name is repeated if one side has it twice."""
    rest = x[KIDS][-1] if x[KIDS] and x[KIDS][-1][NAME] == ANY else None
    known = rest is not None and isinstance(rest[KIDS], Rest)
    named: dict[str, list] = rest[KIDS].named if known else {}
    new = []
    for kids in ([], _children(y)) if known else (_children(x), _children(y)):
        seen = set()
        for kid in kids:
            own = named.get(kid[NAME])
            if own is None:
                named[kid[NAME]] = own = kid
                own[OPTIONAL] = True
                new.append(kid)
            else:
                work.append((own, kid))
            if kid[NAME] in seen:
                own[REPEATED] = True
            seen.add(kid[NAME])
    if known:
        rest[KIDS] += new
    elif len(new) <= WIDEST:
        x[KIDS] = new
    else:
        held = Rest(new[WIDEST - 1 :])
        held.named = named
        x[KIDS] = [*new[: WIDEST - 1], [ANY, False, True, True, [], 0, 0, None, held]]


@dataclass
class View:
    """A wrapper in preorder, with what stands below each node; what a template part holds counts nowhere."""

    nodes: list[list]
    kids: list[list[int]]
    chars: list[int]
    links: list[int]
    varying: list[int]  # characters outside links that aren't a constant text of the host

    @classmethod
    def of(cls, wrapper: list) -> View:
        nodes, kids, parents, work = [], [], [], [(wrapper, -1)]
        while work:
            x, up = work.pop()
            if up >= 0:
                kids[up].append(len(nodes))
            work += [(kid, len(nodes)) for kid in reversed(_children(x))]
            nodes.append(x), kids.append([]), parents.append(up)
        chars, links = [x[CHARS] for x in nodes], [x[LINKS] for x in nodes]
        varying = [0 if x[TEXT] is not None and len(x[WHOLES]) >= CONSTANT and not x[REPEATED] else x[CHARS] - x[LINKS] for x in nodes]
        for k in range(len(nodes) - 1, -1, -1):
            if nodes[k][DROPPED]:
                chars[k] = links[k] = varying[k] = 0
            if parents[k] >= 0:
                for sums in (chars, links, varying):
                    sums[parents[k]] += sums[k]
        return cls(nodes, kids, chars, links, varying)

    def constant(self, k: int) -> bool:
        """Text that is the same wherever the element stands, in several different wholes."""
        return len(self.nodes[k][WHOLES]) >= CONSTANT and self.links[k] < self.chars[k] and not self.varying[k]

    def template(self, k: int) -> bool:
        """Constant text, or a list of links."""
        links = self.links[k] > 0.6 * self.chars[k] and tag_of(self.nodes[k][NAME]) in LISTS
        return links or (len(self.nodes[k][WHOLES]) >= CONSTANT and not self.varying[k])


def decide(wrapper: list) -> list:
    """What a host's wrapper says, as a tree of the paths it speaks of: [mark, {name: subtree}].

    Marks: "root" is the content of pages without article elements, "drop" what goes from there, "constant" what goes
    from articles; "" only leads on.
    """
    view = View.of(wrapper)
    said: list = ["", {}]
    total, at, here = view.varying[0], 0, said
    while total:
        best = max((k for k in view.kids[at] if view.nodes[k][NAME][0] != "#"), key=lambda k: view.varying[k], default=None)
        if best is None or view.nodes[best][REPEATED] or view.varying[best] < HOLDS * total:
            break
        name = view.nodes[best][NAME]
        if tag_of(name) not in BLOCKS or tag_of(name) in ("p", "li"):
            break
        at, here = best, here[1].setdefault(name, ["", {}])
    if at:
        here[0] = "root"
    work = [(0, said, False, at == 0)]  # node, its place in the answer, whether an article element holds it, whether the root does
    found: list[tuple[dict, str, list]] = []
    while work:
        k, place, inside, below = work.pop()
        alike: dict[str, list[int]] = {}
        for j in view.kids[k]:
            alike.setdefault(view.nodes[j][NAME], []).append(j)
        for name, those in alike.items():  # a path speaks of all children of a name
            tag = tag_of(name)
            if name[0] == "#" or any(view.nodes[j][DROPPED] for j in those):
                continue
            own = place[1].setdefault(name, ["", {}])
            found.append((place[1], name, own))
            if inside:
                constant = name != tag and tag in BLOCKS and tag not in HEADINGS and all(view.constant(j) and not view.nodes[j][REPEATED] for j in those)
                own[0] = own[0] or ("constant" if constant else "")
            elif below and tag in BLOCKS and sum(view.chars[j] for j in those):
                own[0] = own[0] or ("drop" if all(view.template(j) for j in those) else "")
            if own[0] not in ("constant", "drop"):
                work += [(j, own, inside or tag in MAIN_TAGS, below or own[0] == "root") for j in those]
    for up, name, own in reversed(found):  # only what leads to a mark stays
        if not own[0] and not own[1]:
            up.pop(name, None)
    return said


def extract(page: str | None, decision: list | None) -> str:
    """The article's text: blocks in page order."""
    if not page:
        return ""
    found = list(events(page))
    has_main, around = False, set()
    stack: list[int] = []
    flagged: list[int] = []  # open template parts
    for k, (kind, value, drop) in enumerate(found):
        if kind == "<":
            if not drop and tag_of(value) in MAIN_TAGS:
                if not flagged:
                    has_main = True
                elif not any(tag_of(found[i][1]) in DROP_TAGS for i in flagged):
                    around.update(flagged)
            stack.append(k)
            if drop:
                flagged.append(k)
        elif kind == ">" and stack.pop() in flagged[-1:]:
            flagged.pop()
    if not has_main and around:  # the only articles stand in a container that is named like a template part
        found = [(kind, value, drop and k not in around) for k, (kind, value, drop) in enumerate(found)]
        has_main = True
    said = decision or ["", {}]
    ways = [("constant",), ()] if has_main else [("root", "drop"), ("drop",), ()]
    for marks in ways:
        if text := _blocks(found, has_main, said, marks):
            return text
    return ""


def _blocks(found: list[tuple[str, str, bool]], has_main: bool, said: list, marks: tuple[str, ...]) -> str:
    blocks: list[str] = []
    held: list[str] = []
    places: list[list | None] = [said]  # where each open element stands in the decision
    dropped = inside = 0
    if not has_main and "root" not in marks:
        inside = -1  # everywhere
    elif not has_main and not _has_root(said):
        inside = -1

    def flush() -> None:
        if held and (text := " ".join("".join(held).split())):
            blocks.append(text)
        held.clear()

    for kind, value, drop in found:
        if kind == "<":
            up = places[-1]
            places.append(up[1].get(value) if up else None)
            mark = places[-1][0] if places[-1] else ""
            depth = len(places)
            tag = tag_of(value)
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                held.append(" ")
            if not dropped and (drop or (tag == "header" and not inside > 0 and has_main) or (mark in marks and mark in ("drop", "constant"))):
                dropped = depth
                flush()
            if not inside and not dropped and (tag in MAIN_TAGS if has_main else mark == "root"):
                inside = depth
        elif kind == ">":
            if value in BLOCKS:
                flush()
            if dropped == len(places):
                dropped = 0
            if inside == len(places):
                flush()
                inside = 0
            places.pop()
        elif inside and not dropped:
            held.append(html.unescape(value))
    flush()
    return "\n\n".join(blocks)


def _has_root(said: list) -> bool:
    work = [said]
    while work:
        mark, below = work.pop()
        if mark == "root":
            return True
        work += below.values()
    return False


def dump(tree: list) -> str:
    """A wrapper as JSON of its nodes in preorder with their numbers of children, so that depth costs nothing."""
    out, work = [], [tree]
    while work:
        x = work.pop()
        out.append([*x[:KIDS], len(x[KIDS])])
        work += reversed(x[KIDS])
    return json.dumps(out)


def parse(text: str) -> list:
    root: list = [None] * KIDS + [[]]
    open_: list[tuple[list, int]] = [(root, 1)]
    for row in json.loads(text):
        while open_[-1][1] == len(open_[-1][0][KIDS]):
            open_.pop()
        node = [*row[:KIDS], []]
        open_[-1][0][KIDS].append(node)
        open_.append((node, row[KIDS]))
    return root[KIDS][0]


def dump_decision(said: list) -> str:
    """A decision as JSON: (depth, name, mark) in preorder."""
    out, work = [], [(0, "", said)]
    while work:
        depth, name, (mark, below) = work.pop()
        out.append([depth, name, mark])
        work += [(depth + 1, k, v) for k, v in reversed(below.items())]
    return json.dumps(out)


def parse_decision(text: str | None) -> list | None:
    if text is None:
        return None
    path: list[list] = []
    for depth, name, mark in json.loads(text):
        del path[depth:]
        node: list = [mark, {}]
        if path:
            path[-1][1][name] = node
        path.append(node)
    return path[0]


def _keyed(pages: DataFrame) -> DataFrame:
    """(host, page_id, url, html): the one place where a host is read from its url."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(host.alias("host"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from every page of every host; see `parse`."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 16
        own: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": list(own), "salt": pa.array([salt] * len(own), pa.int32()), "wrapper": [dump(w) for w in own.values()]})

        for part in slices(batches, "html"):
            for host, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                new = tree(page)
                own[host] = unite(own[host], new) if host in own else new
            if len(own) > FLUSH_HOSTS:
                yield out()
                own.clear()
        if own:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, salt, held = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": [last], "salt": pa.array([salt], pa.int32()), "wrapper": [dump(held)]})

        for batch in batches:
            for host, s, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, s) != (last, salt) and held is not None:
                    yield out()
                    held = None
                last, salt = host, s
                held = unite(held, parse(text)) if held is not None else parse(text)
        if held is not None:
            yield out()

    schema = "host string, salt int, wrapper string"
    partial = _keyed(pages).where("html is not null").select("host", "html").mapInArrow(fold, schema)
    partial = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(merge, schema)
    return partial.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, schema).select("host", "wrapper")


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"host": batch.column(0), "decision": [dump_decision(decide(parse(w.as_py()))) for w in batch.column(1)]})

    decisions = materialise(wrappers(pages).mapInArrow(settle, "host string, decision string"), "decisions")
    size = decisions.agg(F.sum(F.octet_length("decision") + F.octet_length("host"))).first()[0] or 0
    # Each host's decision meets its pages by a join: broadcast where all decisions are small together, else over salts, so that a large host is split.
    rows = _keyed(pages).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    if size <= broadcast_bytes:
        rows = rows.join(F.broadcast(decisions), "host", "left")
    else:
        rows = rows.join(decisions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", "host", "decision")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list | None] = {}
        for part in slices(batches, "html"):
            page_id, url, pages_, hosts, said = part.columns
            texts = []
            for page, host, decision in zip(pages_.to_pylist(), hosts.to_pylist(), said.to_pylist(), strict=True):
                if host not in known:
                    if len(known) >= FLUSH_HOSTS:
                        known.clear()
                    known[host] = parse_decision(decision)
                texts.append(extract(page, known[host]))
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
