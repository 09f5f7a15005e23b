"""Main text of web pages by tag-path ratios.

Text length, punctuation and link text are summed per root-to-block tag path. Length and
punctuation per block, each smoothed with the other paths of the same container, are fused into one
score. The paths whose score is a share of the best one's select the content nodes: the smallest
element around them, with all that it holds (short cells, lists of links, its own header).
Elements that are no article text by their tag (nav, footer, aside, form) never count. Class words
bar an element outside of an article; inside, only whole names made of such words do, and names that
articles use for parts of themselves (notice, header) need a low score of the path as well.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe|object|select|title)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_NOT_CONTENT = frozenset("nav footer aside form button head menu dialog".split())
_HINTS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo masthead header comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar skip".split())
#: Readers' comments read like an article: no score tells them apart.
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Names that an article also has for parts of itself: a title, a note, a figure of speech.
_OWN_PARTS = frozenset("header masthead notice alert search banner".split())
#: Words that say nothing of their own in a name like comment-list or share-buttons.
_PLAIN = frozenset("area bar block body bottom box button buttons container content form group holder inner item items left link links list main message outer page panel post posts row section site text thread title top right unit widget wrap wrapper".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_INNER = frozenset("ul ol dl li dt dd table tbody thead tr td th blockquote figure".split())
_SCOPE = frozenset("ul ol dl table tbody thead tr div section article main body td th blockquote aside nav footer header form figure".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre address hr".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؛؟¡¿]")
#: Shares of the best path's score: of paths that say where the content is, and of such that are content
#: wherever they are, on a page without an article; share of the container in a path's score.
CORE, SHARE, SMOOTH = 0.5, 0.7, 0.5
#: Above this share of link text a path is a menu.
LINKS = 0.6


class _Element:
    """barred: never content. weak: content only by a high score of its path. Both hold for all that is
    inside; article is the outermost article around, itself included. A path is a number, found by its
    parent's and the name, so that deep pages cost no more than their elements."""

    __slots__ = ("tag", "parent", "path", "barred", "weak", "depth", "article")

    def __init__(self, name: str, tag: str, parent: _Element | None, paths: dict[tuple[int, str], int]):
        self.tag, self.parent = tag, parent
        self.barred, self.weak = (parent.barred, parent.weak) if parent else (False, False)
        self.path = paths.setdefault((parent.path if parent else -1, name), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.article = parent.article if parent else None
        if self.article is None and tag in ("article", "main"):
            self.article = self


def _judge(element: _Element, named: str, rest: str) -> None:
    """Sets barred and weak of an element from its tag, names and attributes, beside what it inherits."""
    within = element.parent.article is not None
    if element.tag in _NOT_CONTENT or element.tag == "header" and not within or rest and _HIDDEN.search(rest):
        element.barred = True
    if not named or element.tag in ("html", "body"):
        return
    names = [re.split(r"[^a-z]+", x) for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", named).lower().split()]
    names = [[w for w in x if w] for x in names]
    whole = [set(x) & _HINTS for x in names if x and set(x) <= _HINTS | _PLAIN]  # of names made of such words only
    if element.tag in ("article", "main") and not within:
        return  # class words alone never empty an article
    if any(x & _COMMENTS for x in whole):
        element.barred = True
    elif within:
        element.barred |= any(x - _OWN_PARTS for x in whole)
        element.weak |= any(x & _OWN_PARTS - {"header", "masthead"} for x in whole)
    else:
        element.weak |= any(set(x) & _HINTS for x in names)
        element.barred |= any(x for x in whole)


def blocks(page: str, paths: dict[tuple[int, str], int] | None = None) -> list[tuple[_Element, str, int]]:
    """Text blocks in page order: (element, raw text, characters of it in links). paths: gets the number of
    each path, by its parent's and its name."""
    paths = {} if paths is None else paths
    root = _Element("", "", None, paths)
    stack, out, held, links = [root], [], [], 0
    open_: dict[str, int] = defaultdict(int)  # tags on the stack: what is not there is not looked for

    def flush():
        nonlocal held, links
        if held:
            text = "".join(held)
            if text and not text.isspace():
                out.append((stack[-1], text, links))
            held, links = [], 0

    def pop(to: int):
        flush()
        for e in stack[to:]:
            open_[e.tag] -= 1
        del stack[to:]

    at, anchors = 0, 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            links += len(piece) if anchors else 0
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                anchors = 0 if m[2] else 1
            elif name == "br" or name == "img":
                held.append(" ")
            continue
        anchors = 0
        if m[2]:
            if open_[name]:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            else:
                flush()
            continue
        flush()
        if stack[-1].tag == "p":
            pop(len(stack) - 1)  # a block ends an open paragraph
        if name in _CLOSES and any(open_[x] for x in _CLOSES[name]):
            for i in range(len(stack) - 1, 0, -1):
                if (tag := stack[i].tag) in _CLOSES[name]:
                    pop(i)
                    break
                if tag in _SCOPE and tag != "tr":
                    break
        if name in _VOID:
            continue
        rest = m[4] or ""
        named = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
        element = _Element(name + ("." + named.split()[0] if named.strip() else ""), name, stack[-1], paths)
        _judge(element, named, rest)
        if not rest.rstrip().endswith("/"):
            stack.append(element)
            open_[name] += 1
    if at < len(page):
        tail = page[at:]
        held.append(tail)
    flush()
    return out


def _around(elements: list[_Element]) -> _Element:
    """The smallest element that holds all of them, and is no part of a list or table."""
    out = elements[0]
    under: set[_Element] = set()  # known to be inside of out
    for e in elements[1:]:
        while e is not out and e not in under:
            if e.depth >= out.depth:
                under.add(e)
                e = e.parent
            else:
                under.add(out)
                out = out.parent
    while out.parent is not None and (out.tag in _INNER or out.tag in _BLOCKS):
        out = out.parent
    return out


def _scores(found, smooth: float = SMOOTH) -> dict[int, float]:
    """The fused, smoothed ratios of each tag path."""
    paths: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4)
    above = {}
    for element, text, share in found:
        row = paths[element.path]
        above[element.path] = element.parent.path if element.parent else -1
        for i, v in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), share * len(text))):
            row[i] += v
    length, marks, inside = {}, {}, defaultdict(list)
    for path, (n, chars, points, linked) in paths.items():
        menu = linked > LINKS * chars
        length[path], marks[path] = (0.0, 0.0) if menu else (chars / n, points / n)
        inside[above[path]].append(path)
    score = {}
    for held in inside.values():
        total = sum(paths[p][0] for p in held)
        mean = [sum(v[p] * paths[p][0] for p in held) / total for v in (length, marks)]
        for p in held:
            if length[p]:
                a = (1 - smooth) * length[p] + smooth * mean[0]
                b = (1 - smooth) * marks[p] + smooth * mean[1]
                score[p] = math.log1p(a) * (1 + math.log1p(b))
    return score


def main_text(page: str) -> str:
    found = []
    for element, raw, links in blocks(page):
        if text := " ".join(html.unescape(raw).split()):
            if not element.barred:
                found.append((element, text, links / max(1, len(raw)), element.weak, element.article is not None))
    score = _scores([f[:3] for f in found])
    bare = _scores([f[:3] for f in found], 0.0) if any(f[3] for f in found) else {}
    # An article says where it is; on a page without one, the ratios decide among all paths. Weak
    # names need the score of the best path's core.
    articles = any(inside and not weak for *_, weak, inside in found)
    pool = [f for f in found if f[4]] if articles else found
    best = max((score.get(f[0].path, 0.0) for f in pool if not f[3]), default=0.0) or max((score.get(f[0].path, 0.0) for f in pool), default=0.0)
    if not best:
        return "\n\n".join(text for _, text, _, weak, inside in pool if inside and not weak)
    core = [f for f in pool if score.get(f[0].path, 0.0) >= CORE * best and not f[3]] or [f for f in pool if score.get(f[0].path, 0.0) == best]
    if articles:
        nodes = {f[0].article for f in core}
    else:
        node = _around([f[0] for f in core])
        nodes = {node} if node.tag not in ("", "html", "body") or any(_around([f[0]]) is node for f in core) else {_around([f[0]]) for f in core}
    whole = {e for e in nodes if e.tag not in ("", "html", "body")}
    out = []
    around: dict[_Element | None, tuple[bool, bool]] = {None: (False, False)}  # whether a node, and a whole one, is around
    for element, text, share, weak, _ in found:
        chain = []
        while element not in around:
            chain.append(element)
            element = element.parent
        for e in reversed(chain):
            in_node, in_whole = around[e.parent]
            around[e] = in_node or e in nodes, in_whole or e in whole
        element = chain[0] if chain else element
        held, in_whole = around[element]
        own = score.get(element.path, 0.0)
        if held and (not weak or bare.get(element.path, 0.0) >= CORE * best) and (in_whole or share <= LINKS) or not articles and own >= SHARE * best and not weak:
            out.append(text)
    return "\n\n".join(out)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (page_id, url, text).

    The whole html is read, however long (a page is one row of a task); null is empty and gives an
    empty text. Character references are decoded, white space inside a block becomes one space,
    blocks stand in page order with two newlines between. Of several articles that the ratios select,
    all count; of equal scores too. Repeated rows give repeated rows, rows without an id or url keep
    their null; an empty table gives none; other columns, whatever their names, are ignored.
    Paths and scores are of one page: no row depends on another.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.transform(in_arrow, _extract, "page_id long, url string, text string")
