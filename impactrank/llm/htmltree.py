"""One pass over a page: its blocks of text, the tree they stand in, and simple tree matching of two such trees.

All loops are over explicit stacks and every step moves on in the page, so time is linear in its length
however its tags are nested, cut off or left open; only matching costs the product of two trees' nodes at worst.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from itertools import takewhile

import xxhash

#: Elements by their kind in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("head nav footer aside button select iframe svg canvas object dialog menu math audio video label".split())
IN_HEAD = frozenset("base link meta basefont bgsound object".split())
RAW = frozenset("script style textarea noscript template title".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner banners promo promotion sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond disqus replies reply related recommended recommendations widget widgets pagination pager search toolbar toc skip adsbygoogle advertorial discussion complementary contentinfo alert outbrain taboola".split())
HEADERS = frozenset("header topbar siteheader pageheader".split())
#: Marks that hold even for an article inside: what readers say, and other articles.
FIRM = frozenset("comment comments respond disqus replies reply discussion related recommended recommendations outbrain taboola".split())
#: Flags of a block: HTML says that it is no part of the article; a form or a mark says so; it stands in an article, in a main element.
#: Besides: a mark that holds for articles inside too, and an element inside a block whose text is no part of it.
HARD, SOFT, ARTICLE, MAIN, FIRMLY, HELD = 1, 2, 4, 8, 16, 32
#: Siblings of one label that stay apart; further ones are one node with the last of them, as runs of siblings of one label always are.
RUNS = 3

_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table select div article body".split())
_BARRIERS = frozenset("article body table td".split())
_CLOSES_BARRIERS = frozenset("article body html table main div section tr".split())
_START = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|!--|[!?])")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_STOP = re.compile("[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
_MARKING = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_LONG_NUMBER = re.compile(r"&#(?=[0-9]{8})0*+([0-9]*+);?+")


def code_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, frozenset[str], bool, bool]:
    """(label, words of its marks, hidden, main) of a start tag that has marks."""
    named, words, hidden, main = [], set(), False, tag == "main"
    for name, a, b, c in _MARKING.findall(attributes):
        name, value = name.lower(), (a or b or c).strip()
        if name in ("hidden", "aria-hidden"):
            hidden = hidden or (name == "hidden" or value.lower() == "true")
            continue
        main = main or (name != "class" and value.lower() == "main")
        if name != "role":
            named += re.sub("[0-9]+", "0", value).split()
        parts = [w.lower() for w in _PART.findall(value)]
        words.update(parts, (x + y for x, y in zip(parts, parts[1:])))  # side-bar as sidebar
    return ".".join([tag, *sorted(set(named))]), frozenset(words), hidden, main


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at ``at``: its '>' outside quotes; a quote that nothing closes is an ordinary character. -1: nowhere."""
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if m.start() < last[m[0]]:
            at = page.find(m[0], at) + 1
    return -1


class Tree:
    """Labels and parents of nodes in the order of their first text; node 0 is the page itself."""

    __slots__ = ("labels", "parents")

    def __init__(self, labels: list[str], parents: list[int]):
        self.labels, self.parents = labels, parents

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for i, up in enumerate(self.parents):
            if up >= 0:
                out[up].append(i)
        return out

    def layout(self) -> int:
        """A hash of the labels on the first level that has more than one."""
        below, level = self.children(), [0]
        while level:
            level = [c for i in level for c in below[i]]
            found = {self.labels[i] for i in level}
            if len(found) != 1:
                return code_of("\n".join(sorted(found)))
        return 0

    def shape(self) -> int:
        """A hash of the whole tree."""
        return code_of("\n".join([*self.labels, *map(str, self.parents)]))


class Page(Tree):
    """A page's blocks in order: ``texts``, the ``nodes`` they stand at and their ``flags``."""

    __slots__ = ("texts", "nodes", "flags", "_named", "_last")

    def __init__(self, page: str | None):
        super().__init__(["#"], [-1])
        self.texts: list[str] = []
        self.nodes: list[int] = []
        self.flags: list[int] = []
        self._named: list[dict[str, list[int]]] = [{}]
        self._last = [0]
        self._read(page or "")

    def _child(self, up: int, label: str) -> int:
        last = self._last[up]
        if last and self.labels[last] == label:
            return last
        own = self._named[up].setdefault(label, [])
        if len(own) < RUNS:
            own.append(len(self.labels))
            self.labels.append(label)
            self.parents.append(up)
            self._named.append({})
            self._last.append(0)
        self._last[up] = own[-1]
        return own[-1]

    def _read(self, page: str) -> None:
        # open elements: tag, flags, label, node (-1: none yet), the block element that holds it (its own place for a block)
        tags, flags, labels, nodes, block = ["#"], [0], ["#"], [0], [0]
        where: dict[str, list[int]] = {}  # places of the open elements of a tag
        lists, barriers, solid = [0], [0], [0]  # places of open list-like elements, of barriers, of blocks other than p
        held: list[str] = []
        last: dict[str, int] | None = None

        def flush() -> None:
            text = "".join(held)
            held.clear()
            if "&" in text:
                text = entities.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1] or 0};" if len(m[1]) < 8 else "�", text))
            text = " ".join(text.split())
            if text:
                own = block[-1]
                open_ = []
                while nodes[own] < 0:
                    open_.append(own)
                    own = block[own - 1]
                node = nodes[own]
                for k in reversed(open_):
                    node = nodes[k] = self._child(node, labels[k])
                self.texts.append(text)
                self.nodes.append(node)
                self.flags.append(flags[block[-1]])

        def close(to: int) -> None:
            """End the open elements from place ``to`` on; texts of blocks are flushed before."""
            while len(tags) > to:
                tag = tags.pop()
                flags.pop(), labels.pop(), nodes.pop(), block.pop()
                where[tag].pop()
                for places in (lists, barriers, solid):
                    if places[-1] == len(tags):
                        places.pop()

        done = 0
        while m := _START.search(page, done):
            at = m.start()
            if at > done and not flags[-1] & HELD:
                held.append(page[done:at])
            tag = m[2]
            if not tag:
                comment = m[0] == "<!--"
                end = page.find("-->" if comment else ">", at + 2)
                done = len(page) if end < 0 else end + (3 if comment else 1)
                continue
            if last is None and (rest := _REST.match(page, m.end())):
                end = rest.end() - 1
            else:  # quotes are out of order: from here on they are paired one by one
                last = last or {q: page.rfind(q) for q in "\"'"}
                end = _tag_end(page, m.end(), last)
                if end < 0:  # a tag that was cut off is no text
                    done = len(page)
                    break
            done, tag = end + 1, tag.lower()
            if m[1]:
                own = where.get(tag)
                if own and (own[-1] >= barriers[-1] or tag in _CLOSES_BARRIERS):
                    if block[-1] >= own[-1]:
                        flush()
                    close(own[-1])
                continue
            if tag in RAW:
                stop = _RAW_END[tag].search(page, done)
                done = stop.end() if stop else len(page)
                continue
            if tag == "br":
                held.append(" ")
                continue
            if where.get("head") and tag not in IN_HEAD:
                close(where["head"][-1])
            is_block = tag in BLOCKS
            if is_block:
                flush()
                own = where.get("p")
                if own and own[-1] > solid[-1]:  # a block ends an open paragraph
                    close(own[-1])
            if tag in _CLOSED_BY:
                open_ = [p for t in _CLOSED_BY[tag] for p in takewhile(lambda p: p > lists[-1], reversed(where.get(t, ())))]
                if open_:
                    flush()
                    close(min(open_))
            if tag in VOID or (page[end - 1] == "/" and (end - 1 == m.end() or page[end - 2] in " \t\r\n\"'")):
                continue
            before = flags[-1]
            now, label = before, tag
            inside = before & (ARTICLE | MAIN)
            words: frozenset[str] = frozenset()
            main = tag == "main"
            if end - m.end() > 2:
                attributes = page[m.end() : end]
                if "=" in attributes or "hidden" in attributes:
                    found = _MARKING.search(attributes)
                    if found:
                        label, words, hidden, main = _element(tag, attributes if len(attributes) < 400 else " ".join(x[0] for x in _MARKING.finditer(attributes)))
                        if hidden:
                            now |= HARD
            if tag in UNREAD or (tag == "header" and not inside):
                now |= HARD
            marked = bool(words & MARKS or (words & HEADERS and not inside)) and tag not in ("html", "body") and not main
            if tag == "form" or marked:
                now |= SOFT
            if words & FIRM and marked:
                now |= FIRMLY
            if not marked and (main or tag == "article"):
                if not now & FIRMLY:
                    now &= ~SOFT
                now |= ARTICLE if tag == "article" else MAIN
            if not is_block and now & ~before & (HARD | SOFT):
                now |= HELD
            place = len(tags)
            where.setdefault(tag, []).append(place)
            tags.append(tag)
            flags.append(now)
            labels.append(label)
            nodes.append(0 if tag in ("html", "body") else -1)
            block.append(place if is_block else block[-1])
            if tag in _LISTS:
                lists.append(place)
            if tag in _BARRIERS:
                barriers.append(place)
            if is_block and tag != "p":
                solid.append(place)
        if done < len(page) and not flags[-1] & HELD:
            held.append(page[done:])
        flush()


def _chain(pairs: list[tuple[int, int, int]], width: int) -> tuple[int, list[int]]:
    """The heaviest chain of (i, j, weight) that rises in both i and j, of pairs sorted by i and then by falling j: its weight and members."""
    tree = [(0, -1)] * (width + 1)
    back = []
    for n, (_, j, weight) in enumerate(pairs):
        best, k = (0, -1), j  # places below j
        while k > 0:
            if tree[k][0] > best[0]:
                best = tree[k]
            k &= k - 1
        back.append(best[1])
        total, k = best[0] + weight, j + 1
        while k <= width:
            if total > tree[k][0]:
                tree[k] = (total, n)
            k += k & -k
    best, k = (0, -1), width
    while k > 0:
        if tree[k][0] > best[0]:
            best = tree[k]
        k &= k - 1
    out, n = [], best[1]
    while n >= 0:
        out.append(n)
        n = back[n]
    return best[0], out


def match(a: Tree, b: Tree) -> tuple[int, dict[int, int]]:
    """Simple tree matching: the size of the largest match of two trees that keeps labels, parents and the order of siblings, and b's nodes with their partners in a."""
    if a.labels == b.labels and a.parents == b.parents:
        return len(a.labels), {i: i for i in range(len(a.labels))}
    below_a, below_b = a.children(), b.children()
    found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    stack: list[tuple[int, int, list | None]] = [(0, 0, None)]
    while stack:
        x, y, alike = stack.pop()
        if alike is None:
            places: dict[str, list[int]] = {}
            for j, c in enumerate(below_b[y]):
                places.setdefault(b.labels[c], []).append(j)
            alike = [(i, j) for i, c in enumerate(below_a[x]) for j in reversed(places.get(a.labels[c], ()))]
            stack.append((x, y, alike))
            stack += [(below_a[x][i], below_b[y][j], None) for i, j in alike]
        else:
            children = [(below_a[x][i], below_b[y][j]) for i, j in alike]
            size, chain = _chain([(i, j, found[c][0]) for (i, j), c in zip(alike, children)], len(below_b[y])) if alike else (0, [])
            found[x, y] = 1 + size, [children[n] for n in chain]
    partner: dict[int, int] = {}
    open_ = [(0, 0)]
    while open_:
        pair = open_.pop()
        partner[pair[1]] = pair[0]
        open_ += found[pair][1]
    return found[0, 0][0], partner
