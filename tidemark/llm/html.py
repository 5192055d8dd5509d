"""HTML extraction (operator 3) by union-free regular expressions inferred for each host.

A page is read as a stream of block tags and text slots, with open ends closed where HTML closes them. Its nested form is
a union-free expression: an element holds a row of elements, each of which may be optional (?) or repeated (+); a row that
repeats as a group is one loop of optional members. Pages of a host are aligned one after the other: elements that match
are merged, an element that one side lacks becomes optional, neighbours of one shape become a repeated element, and text
that differs becomes a slot. What comes out is the host's wrapper. Its statistics tell template from content: which slots
say the same on every page, where the text is that differs from page to page, how much of it is links.

Wrappers add up and stay small, so each task first merges the pages it reads, by host, then a few salted tasks merge those,
then one for each host merges what is left. No task sees the pages of a hot host together, and a task hands on what it
has once it holds HELD elements. The pages then meet their wrapper: by broadcast if all wrappers are small, else in a join
in which hosts with very many pages are broadcast apart.

The wrapper decides what is content. What changes from page to page and isn't links is the mass of an element, and the innermost
element that holds most of a host's mass is its content; slots that say the same on three pages or more are template
there and all around. Tags and words of class, id and role break ties: an article or main element with a fair part of the mass is
the content with its own bounds, and an element named like a menu, header, footer, sidebar, notice, advert, form or comments is
left out, unless it holds half of the mass (comments go always). Inside an article, words alone take out only containers named for nothing else,
or blocks whose name is just such a word. Where a host has fewer than three different pages nothing shows what changes;
there all text counts as mass.

Defined cases: null html is empty; a page without content has the empty text; a url without a host shares one wrapper
with its like; a host's only page is its own wrapper; repeated pages count as often as they occur, but three different
pages make a template, not copies; of elements that hold equally much the first in page order counts; pages and texts of any length and depth are read whole; columns
named text or n_chars are replaced, others may have any name and type; empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .common import cut, lean, named, replacing, table, with_arrays
from .grouping import BROADCAST_ROWS, join_unique

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|canvas|select|button|noframes|annotation|annotation-xml)(?=[\s/>])(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*>.*?(?:</\1(?=[\s/>])[^>]*>?|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?",
    re.S | re.I,
)
ATTRIBUTES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements of the HTML and MathML standards that stand inside a line. Fixed values.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong
    sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced msub msup msubsup munder mover
    munderover mmultiscripts mtable mtr mtd semantics""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the set, up to the nearest element named third.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "body": ({"head"}, set()), "article": ({"nav", "head", "p"}, {"article", "div", "section", "main"}), "main": ({"nav", "head", "p"}, {"div", "section"}),
}
#: Elements that hold text; neighbours of one name are repeats of each other.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption option address hr".split())
NOT_CONTENT_TAGS = frozenset("head nav footer aside form dialog menu fieldset".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOT_CONTENT_WORDS = frozenset(
    """ad ads adsbygoogle advert adverts advertisement advertising adslot adsense alert banner breadcrumb breadcrumbs comment commentlist comments consent
    cookie cookies discussion disqus footer gdpr login masthead menu menubar menus modal nav navbar navigation newsletter notice notices
    notification overlay pager pagination popup promo promoted promotion promotions related replies reply respond share sharing sidebar sidebars
    signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets""".split()
)
#: Words that say nothing against the others of a name they stand in.
PLAIN_WORDS = frozenset(
    """area article articles bar block body bottom box button buttons center column container content entry frame group header holder icon icons
    inner item items left link links list main message middle module outer page panel post posts right row section site slot stories story strip
    text thread title top unit wrap wrapper zone""".split()
)
COMMENT_WORDS = frozenset("comment commentlist comments discussion disqus replies reply respond".split())
#: What an article element isn't the article by; it may carry other words of the list, like with-ads.
NOT_THE_ARTICLE_WORDS = COMMENT_WORDS | frozenset("advert advertisement promo related sponsored teaser".split())
#: What tells a header of an article or of a page.
HEADER_WORDS, ARTICLE_WORDS = frozenset(["header"]), frozenset("article post entry story content".split())
#: Words by which an element is judged; a signature has all names that hold one.
TELLING_WORDS = NOT_CONTENT_WORDS | NOT_THE_ARTICLE_WORDS | HEADER_WORDS | ARTICLE_WORDS
#: Other names that a signature has; it has a hash of the rest, which only tells elements apart.
OTHER_NAMES = 8
#: Different pages that must say the same for it to be template.
ENOUGH = 3
#: Part of the mass that article and main elements must have to be the content, and that the innermost element must have.
FAIR, MOST = 0.3, 0.7
#: The same where nothing shows what changes, and the characters that there must be to judge by.
FAIR_ALONE, CHARACTERS = 0.1, 200
#: Elements of wrappers that a task holds.
HELD = 200_000
#: Characters of all wrappers up to which they are broadcast, so that pages needn't move.
BROADCAST_BYTES = 32 << 20


class Node:
    """An element of a page or wrapper. sig: its tag, names of class and id, and role."""

    __slots__ = ("chars", "few", "kids", "linked", "loop", "many", "opt", "pages", "same", "sig", "tag", "up")

    def __init__(self, sig: str, few: tuple[int, ...] = ()):
        self.sig, self.tag = sig, sig.partition(".")[0].partition("@")[0]
        self.many = self.opt = self.loop = False
        self.kids: list[Node] = []
        self.chars = self.linked = self.same = 0  # same: a hash of its own text, -1 once it differs, 0 without text
        self.pages, self.few = 1, few  # few: the smallest hashes of pages that have it, ENOUGH at most
        self.up: Node | None = None  # what it was merged into

    def shape(self) -> tuple:
        return (self.sig, tuple(dict.fromkeys(k.sig for k in self.kids)))

    def key(self):
        return self.sig if self.tag in TEXTUAL else self.shape()

    def order(self) -> list[Node]:
        """The element and all below it, in page order."""
        out, stack = [], [self]
        while stack:
            out.append(n := stack.pop())
            stack += reversed(n.kids)
        return out

    def dump(self) -> list:
        return [[n.sig, n.many, n.opt, n.loop, n.chars, n.linked, n.same, n.pages, n.few, len(n.kids)] for n in self.order()]

    def skeleton(self) -> tuple:
        return tuple((n.sig, n.many, n.loop, len(n.kids)) for n in self.order())

    def add(self, other: Node) -> None:
        """Statistics of one element added."""
        self.chars += other.chars
        self.linked += other.linked
        if other.same:
            self.same = other.same if self.same in (0, other.same) else -1
        if other.few != self.few:
            self.few = tuple(sorted({*self.few, *other.few})[:ENOUGH])

    def pattern(self) -> str:
        """The expression as text; # is a slot."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            out.append(("(" if n.many or n.opt else "") + f"<{n.sig}>" + ("#" if n.same else "") + ("(" if n.loop else ""))
            end = (")+" if n.loop else "") + f"</{n.tag}>"
            if n.many or n.opt:
                end += ")" + ("*" if n.many and n.opt else "+" if n.many else "?")
            stack += [end, *reversed(n.kids)]
        return "".join(out)


def load(rows: list) -> Node:
    root, open_ = None, []
    for sig, many, opt, loop, chars, linked, same, pages, few, kids in rows:
        n = Node(sig, tuple(few))
        n.many, n.opt, n.loop, n.chars, n.linked, n.same, n.pages = many, opt, loop, chars, linked, same, pages
        if root is None:
            root = n
        else:
            open_[-1][0].kids.append(n)
            open_[-1][1] -= 1
        while open_ and not open_[-1][1]:
            open_.pop()
        if kids:
            open_.append([n, kids])
    return root


# ---------------------------------------------------------------- reading a page
@lru_cache(maxsize=20_000)
def signature(tag: str, attributes: str) -> str:
    names, role = set(), ""
    for name, a, b, c in ATTRIBUTES.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            role = "@" + value.strip().lower()
        else:
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
            names |= {"-".join(w) for part in value.lower().split() if (w := [x for x in re.split(r"[^a-z]+", part) if x])}
    telling = sorted(n for n in names if not TELLING_WORDS.isdisjoint(n.split("-")))
    others = sorted(names.difference(telling))
    if rest := others[OTHER_NAMES:]:
        others[OTHER_NAMES:] = [f"{zlib.crc32(' '.join(rest).encode()):08x}"]
    return tag + "".join("." + w for w in sorted(telling + others)) + role


def _names(sig: str) -> list[set[str]]:
    """The words of each name of a signature."""
    return [set(n.split("-")) for n in sig.partition("@")[0].split(".")[1:]]


def read(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The page's elements below one root, and its blocks of text in order, each with its element."""
    few = (zlib.crc32(page.encode("utf-8", "surrogatepass")),)
    root = Node("#root", few)
    stack, blocks, buffer, linked, links = [root], [], [], 0, 0
    open_: Counter[str] = Counter()
    at, unescape = 0, entities.unescape

    def flush() -> None:
        nonlocal linked
        text = "".join(buffer)
        buffer.clear()
        if text and (text := " ".join((unescape(text) if "&" in text else text).split())):
            node = stack[-1]
            node.chars += len(text)
            node.linked += min(linked, len(text))
            mark = zlib.crc32(text.encode("utf-8", "surrogatepass")) + 1
            node.same = mark if node.same == 0 else -1
            blocks.append((node, text))
        linked = 0

    def close(start: int) -> None:
        for n in stack[start:]:
            open_[n.tag] -= 1
        del stack[start:]

    def end(names: set[str], stop: set[str]) -> None:
        while any(open_[t] > 0 for t in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    return
                if stack[i].tag in names:
                    close(i)
                    break
            else:
                return

    for m in TOKENS.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            buffer.append(" ")
        if tag in INLINE or tag == "br":
            continue
        flush()
        if closing:
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            links = 0
            continue
        if tag in VOID:
            continue
        if tag in ENDS:
            end(*ENDS[tag])
        elif stack[-1].tag == "p":  # any block ends a paragraph
            close(len(stack) - 1)
        node = Node(signature(tag, m[4] or ""), few)
        stack[-1].kids.append(node)
        if not (m[4] or "").endswith("/") or tag in TEXTUAL or tag in ("div", "article", "section", "main"):
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return root, blocks


# ---------------------------------------------------------------- inference
def _run(job: Iterator):
    """Jobs that yield other jobs and take their results, without recursion: elements may be nested to any depth."""
    stack, value = [job], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def absorb(a: Node, b: Node) -> Node:
    """a with b merged into it: the least expression that fits both."""
    return _run(_absorb(a, b))


def _absorb(a: Node, b: Node):
    a.add(b)
    a.many, a.opt, b.up = a.many or b.many, a.opt or b.opt, a
    if a.kids or b.kids:
        if a.loop or b.loop:
            a.loop = True
            a.kids = yield _members(a.kids + b.kids)
        else:
            a.kids = yield _aligned(a.kids, b.kids)
            yield _fold(a)
    return a


def _pairs(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    """Places that match, increasing on both sides: elements of one shape in the longest common order, and between those, elements of one
    signature as they come."""
    where: dict[tuple, list[int]] = {}
    for j, k in enumerate(right):
        where.setdefault(k.shape(), []).append(j)
    tails: list[tuple[int, int]] = []  # (right place, entry) that a common order of each length ends with
    entries: list[tuple[int, int, int]] = []  # (left place, right place, entry before)
    for i, k in enumerate(left):
        for j in reversed(where.get(k.shape(), ())):
            low, high = 0, len(tails)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if tails[mid][0] < j else (low, mid)
            entries.append((i, j, tails[low - 1][1] if low else -1))
            tails[low : low + 1] = [(j, len(entries) - 1)]
    anchors, e = [], tails[-1][1] if tails else -1
    while e >= 0:
        anchors.append(entries[e][:2])
        e = entries[e][2]
    out, i, j = [], 0, 0
    for ai, aj in [*reversed(anchors), (len(left), len(right))]:
        later: dict[str, list[int]] = {}
        for y in range(j, aj):
            later.setdefault(right[y].sig, []).append(y)
        for x in range(i, ai):
            here = later.get(left[x].sig, [])
            while here and here[0] < j:
                here.pop(0)
            if here:
                out.append((x, here[0]))
                j = here[0] + 1
        if ai < len(left):
            out.append((ai, aj))
        i, j = ai + 1, aj + 1
    return out


def _aligned(left: list[Node], right: list[Node]):
    """Rows aligned; what one row lacks becomes optional."""
    if [k.sig for k in left] == [k.sig for k in right]:
        pairs = [(i, i) for i in range(len(left))]
    else:
        pairs = _pairs(left, right)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(left), len(right))]:
        for k in (*left[i:x], *right[j:y]):
            k.opt = True
            out.append(k)
        if x < len(left):
            left[x].pages += right[y].pages
            out.append((yield _absorb(left[x], right[y])))
        i, j = x + 1, y + 1
    return out


def _members(row: list[Node]):
    """The row as members of a loop: each kind once, in order of appearance, optional."""
    kinds: dict[object, Node] = {}
    for k in row:
        if (old := kinds.get(k.key())) is None:
            kinds[k.key()] = k
            k.opt = True
        else:
            yield _absorb(old, k)
            old.pages = max(old.pages, k.pages)
    return list(kinds.values())


def _fold(parent: Node):
    """Neighbours of one kind become one repeated element. Kinds of text that come again further on, or any that come a
    third time, make the row a loop."""
    row: list[Node] = []
    for k in parent.kids:
        if row and row[-1].key() == k.key():
            yield _absorb(row[-1], k)
            row[-1].many = True
            row[-1].same = -1 if row[-1].same else 0
        else:
            row.append(k)
    parent.kids = row
    seen = Counter(k.key() for k in row)
    if any(n > 2 or (n > 1 and isinstance(k, str)) for k, n in seen.items()):
        parent.loop = True
        parent.kids = yield _members(row)


def fold(node: Node) -> Node:
    """The page's own repeats folded, from the leaves up."""
    for n in reversed(node.order()):
        if n.kids:
            _run(_fold(n))
    return node


def merge(wrappers: list[Node]) -> Node:
    """One wrapper of several, which are used up, in the order given."""
    first, skeleton = wrappers[0], None
    for w in wrappers[1:]:
        skeleton = skeleton or first.skeleton()
        first.pages += w.pages
        if w.skeleton() == skeleton:  # the common case: only statistics to add
            for x, y in zip(first.order(), w.order(), strict=True):
                x.add(y)
                x.opt = x.opt or y.opt
                x.pages += y.pages if x is not first else 0
        else:
            absorb(first, w)
            skeleton = None
    return first


# ---------------------------------------------------------------- what is content
def _named_out(n: Node, words: frozenset[str] = NOT_CONTENT_WORDS) -> bool:
    """Whether a name of the element is made of words of the list and of words that say nothing against them; the name of a
    block must be one word."""
    return any(x & words and x <= words | PLAIN_WORDS and (len(x) == 1 or n.tag not in TEXTUAL) for x in _names(n.sig))


def _words(n: Node) -> set[str]:
    return set().union(*_names(n.sig))


def _out_by_tag(n: Node) -> bool:
    return n.tag in NOT_CONTENT_TAGS or n.sig.partition("@")[2] in NOT_CONTENT_ROLES


class Marks:
    """What each element of a wrapper is: level 0 is not content, 1 is outside of the content's own element, 2 in it, 3 in an article."""

    def __init__(self, root: Node):
        self.order = root.order()
        self.at = {id(n): i for i, n in enumerate(self.order)}
        self.above = [-1] * len(self.order)
        for i, n in enumerate(self.order):
            for k in n.kids:
                self.above[self.at[id(k)]] = i
        # Whether something shows what changes: different pages, and text that differs.
        self.evidence = len(root.few) >= ENOUGH and any(n.same == -1 for n in self.order)
        self.articles = self._summed([int(n.tag in ("article", "main") and not self._left_out(n)) for n in self.order])
        everywhere = self._summed([self._own(n) for n in self.order])
        hidden = [not self._out_at(i, everywhere) for i in range(len(self.order))]
        self.level = self._by_tags(hidden)
        self._by_mass()
        if self.evidence:
            for i, n in enumerate(self.order):
                if self.level[i] in (1, 2) and not self.tagged[i] and n.same > 0 and not n.many and len(n.few) >= ENOUGH:
                    self.level[i] = 0  # says the same on every page, outside of any article

    def _own(self, n: Node) -> int:
        return max(n.chars - n.linked, 0) if not self.evidence or n.same == -1 else 0

    def _summed(self, values: list[int]) -> list[int]:
        """Sums over each element and all below it."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.above[i]] += out[i]
        return out

    def _left_out(self, n: Node) -> bool:
        if n.tag in ("html", "body", "main", "#root"):
            return False
        return _out_by_tag(n) or _named_out(n, NOT_THE_ARTICLE_WORDS if n.tag == "article" else NOT_CONTENT_WORDS)

    def _holds_article(self, i: int) -> bool:
        n = self.order[i]
        return self.articles[i] - int(n.tag in ("article", "main") and not self._left_out(n)) > 0

    def _out_at(self, i: int, mass: list[int]) -> bool:
        n = self.order[i]
        if not self._left_out(n):
            return False
        comments = _named_out(n, COMMENT_WORDS)
        if self.evidence and not comments and not _out_by_tag(n) and 2 * mass[i] >= mass[0]:
            return False  # half of what changes stands here
        return True

    def _by_tags(self, shown: list[bool]) -> list[int]:
        level, self.tagged = [0] * len(self.order), [False] * len(self.order)
        for i, n in enumerate(self.order):
            state = level[self.above[i]] if i else 1
            inner = state == 3 or _named_out(n, COMMENT_WORDS)
            if state and not shown[i] and (inner or not self._holds_article(i)):
                state = 0
            elif state == 1 and self._is_page_header(i):
                state = 0
            elif state and n.tag == "article":
                state = 3
            elif state and (n.tag == "main" or n.sig.endswith("@main")):
                state = max(state, 2)
            level[i], self.tagged[i] = state, state > 1
        return level

    def _is_page_header(self, i: int) -> bool:
        """A header that isn't an article's own."""
        n, words = self.order[i], _words(self.order[i])
        return (n.tag == "header" or not HEADER_WORDS.isdisjoint(words)) and ARTICLE_WORDS.isdisjoint(words) and not self._holds_article(i)

    def _by_mass(self) -> None:
        """The innermost element with most of the mass is the content, unless tags name one with a fair part of it."""
        own = [self._own(n) if self.level[i] else 0 for i, n in enumerate(self.order)]
        mass = self._summed(own)
        tagged = sum(x for x, t in zip(own, self.tagged, strict=True) if t)
        if any(self.tagged):
            fair = FAIR if self.evidence else FAIR_ALONE
            if tagged >= fair * mass[0] or (not self.evidence and mass[0] < CHARACTERS):
                return
        best = self._innermost(mass)
        if best is None:
            return
        if any(self.tagged):
            # Tags name something thin. The element with the mass must be another, that stands on the same pages.
            holds = any(self.tagged[i] for i in self._below(best)) or self.order[best].tag in ("#root", "html", "body")
            pages = max(n.pages for i, n in enumerate(self.order) if self.tagged[i])
            if holds or pages + self.order[best].pages <= self.order[0].pages:
                return
            for i, tagged_here in enumerate(self.tagged):
                if tagged_here:
                    self.level[i], self.tagged[i] = 1, False
        for i in self._below(best):
            n = self.order[i]
            if self.level[i] == 1 and not (n.chars and n.linked > MOST * n.chars):
                self.level[i] = 2

    def _innermost(self, mass: list[int]) -> int | None:
        if not mass[0]:
            return None
        at = 0
        while inner := [self.at[id(k)] for k in self.order[at].kids if k.tag not in TEXTUAL and mass[self.at[id(k)]] >= MOST * mass[0]]:
            at = inner[0]
        return at

    def _below(self, i: int) -> range:
        return range(i, i + len(self.order[i].order()))


def place(page: Node, wrapper: Node, numbers: dict[int, int]) -> list[int]:
    """For each element of a folded page, in order: the number of the wrapper's element that it matches, or -1."""
    out: list[int] = []
    stack: list[tuple[Node, Node | None]] = [(page, wrapper)]
    while stack:
        p, w = stack.pop()
        out.append(-1 if w is None else numbers[id(w)])
        if w is None:
            pairs = [(k, None) for k in p.kids]
        elif w.loop or p.loop:
            kinds = {k.key(): k for k in reversed(w.kids)}
            sigs = {k.sig: k for k in reversed(w.kids)}
            pairs = [(k, kinds.get(k.key()) or sigs.get(k.sig)) for k in p.kids]
        else:
            hits = {x: w.kids[y] for x, y in _pairs(p.kids, w.kids)}
            sigs = {k.sig: k for k in reversed(w.kids)}
            pairs = [(k, hits.get(x) or sigs.get(k.sig)) for x, k in enumerate(p.kids)]
        stack += reversed(pairs)
    return out


class Extractor:
    """A host's wrapper, made ready to read pages."""

    def __init__(self, wrapper: Node):
        self.wrapper, self.marks = wrapper, Marks(wrapper)
        self.known: dict[tuple, list[int]] = {}

    def blocks(self, page: str) -> list[str]:
        root, blocks = read(page)
        fold(root)
        shape = root.skeleton()
        found = self.known.get(shape)
        if found is None:
            places = place(root, self.wrapper, self.marks.at)
            own = Marks(root).level if -1 in places else places  # for what the wrapper lacks
            found = [self.marks.level[w] if w >= 0 else o for w, o in zip(places, own, strict=True)]
            if len(self.known) < 500:
                self.known[shape] = found
        index = {id(n): i for i, n in enumerate(root.order())}
        marked = []
        for node, text in blocks:
            while node.up is not None:
                node = node.up
            marked.append((found[index[id(node)]], text))
        wanted = max((m for m, _ in marked), default=0) or 1
        return [t for m, t in marked if m == wanted]


# ---------------------------------------------------------------- DataFrames
def _host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(named(url_col), r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def _rows(found: dict[str, Node]) -> pa.RecordBatch:
    columns = [pa.array(found.keys(), pa.string()), pa.array([json.dumps(w.dump()) for w in found.values()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper"])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, pattern, wrapper): one row for each host; wrapper is its expression with statistics, as JSON."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        size = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = fold(read(page)[0])
                if host in held:
                    merge([held[host], root])
                else:
                    held[host] = root
                    size += len(root.order())
                if size > HELD:
                    yield _rows(held)
                    held, size = {}, 0
        yield _rows(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with equal hosts side by side; a host may run over several batches."""
        host, one = None, None
        for batch in batches:
            for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node = load(json.loads(w))
                if h == host:
                    one = merge([one, node])
                else:
                    if one is not None:
                        yield _rows({host: one})
                    host, one = h, node
        if one is not None:
            yield _rows({host: one})

    kind = "host string, wrapper string"
    read_pages = pages.select(_host(url_col).alias("host"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    some = read_pages.mapInArrow(lean(by_task), kind)
    salted = some.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(16)))
    salted = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper")
    whole = salted.mapInArrow(again, kind).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(again, kind)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [load(json.loads(w)) for w in batch.column(1).to_pylist()]
            more = [pa.array([n.pages for n in nodes], pa.int64()), pa.array([n.pattern() for n in nodes], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, batch.column(1)], names=["host", "pages", "pattern", "wrapper"])

    return whole.mapInArrow(described, "host string, pages long, pattern string, wrapper string")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages, without the html, with text (blocks joined by a line end) and n_chars."""
    wrappers = cut(infer_wrappers(pages, url_col, html_col)).select(F.col("host").alias("__host_w"), F.col("wrapper").alias("__wrapper"))
    small = (wrappers.agg(F.sum(F.length("__wrapper") + F.length("__host_w"))).first()[0] or 0) <= BROADCAST_BYTES
    pages = replacing(pages, "text", "n_chars")
    kept = [c for c in pages.columns if c != html_col]
    rows = pages.select(*[named(c) for c in kept], F.coalesce(named(html_col), F.lit("")).alias("__html"), _host(url_col).alias("__host"))
    rows = join_unique(rows, "__host", wrappers, "__host_w", 0 if small else BROADCAST_ROWS + 1)
    rows = rows.select(*[named(c) for c in kept], "__html", "__wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        ready: dict[str, Extractor] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                if wrapper not in ready:
                    if len(ready) > 200:
                        ready.clear()
                    ready[wrapper] = Extractor(load(json.loads(wrapper)))
                texts.append("\n".join(ready[wrapper].blocks(page)))
            yield batch, [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_arrays(rows, run, [StructField("text", StringType()), StructField("n_chars", LongType())], keep=len(kept))


# ---------------------------------------------------------------- query
def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
