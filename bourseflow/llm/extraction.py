"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text in page order. A classifier gives each block a log-odds of being content; positive ones become
capacities from the source, negative ones to the sink. Neighbouring blocks, and next blocks under the same parent, are tied by
smoothness edges, stronger the deeper the part of the document tree they share. The maximum flow separates content from boilerplate: a
short paragraph between content stays, a long notice inside a menu goes.

The classifier is naive Bayes over features of the text alone (link share, length, closing mark, tag), counted in Spark on a sample
of pages bounded by `sample_pages`; its labels come from blocks whose place in the page tells what they are (menus, footers, adverts
against article bodies). The place itself adds a fixed amount to the log-odds, little more than a sure text takes away, so that text and ties
together overrule a misleading tag or class word in both directions. If that leaves a page without content, it is cut once more with
class words at half weight: then a sure text stands alone. Only hidden elements, scripts and the like stay out in any case.

Defined results: null or empty html, or html without content: empty text; broken markup is read to its end (a tag cut off by the
end of the page is dropped, unclosed elements end with their parent). Scripts, drawings, forms' choices and the like are left out where they
stand and do not cut the block around them; formulas are read as text. Repeated rows give repeated rows. Extra columns are ignored. An
empty table gives no rows."""
from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import sampled


@dataclass(frozen=True)
class Settings:
    sample_pages: int = 2_000        # to learn from, about
    near: float = 0.4                # smoothness between neighbours
    shared: float = 1.2              # more of it for a wholly shared place in the tree
    sibling: float = 0.5             # between a block and the next under its parent
    place: float = 4.2               # log-odds of a telling place: little over `most`, so that text and ties can overrule it
    most: float = 4.0                # greatest log-odds of the text


#: Place of what a hidden element holds.
HIDDEN = -2
#: Fixed values of the page language.
UNTIL_END = frozenset("script style textarea title".split())
#: Elements whose content is no text of the page; they stand inside a block like a word that is not there.
SKIPPED = frozenset("noscript template svg iframe object canvas audio video select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody "
                  "td tfoot th thead tr ul".split()) - {"button"}
ENDS_SAME = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "body": ("head",)}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre search section table ul".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
GOOD_TAGS = frozenset(("article", "main"))
BOUNDS = ("table", "ul", "ol", "dl", "article", "section", "div", "body")
#: Words of class, id and role that tell a place.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu sidebar "
                      "side footer foot masthead topbar header cookie cookies consent gdpr notice alert popup modal overlay dialog toast share "
                      "sharing social related recommended recommendations more comment comments reply replies respond disqus newsletter "
                      "subscribe signup login breadcrumb breadcrumbs pagination pager widget toolbar search tags tagcloud legal copyright "
                      "contentinfo complementary hidden print skip disclaimer".split())
GOOD_WORDS = frozenset("article post entry story main content body text".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
HINT = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PART = re.compile(r"[a-z]+")


@dataclass
class _Open:
    tag: str
    up: _Open | None
    depth: int                       # elements from the root to this one
    place: int
    shut: bool                       # no place below it tells of content
    loose: bool                      # its place is told by class words alone
    mute: bool = False               # inside the head


@dataclass
class Block:
    text: str
    link: int                        # characters inside links
    tag: str
    node: _Open                      # innermost open element
    place: int                       # -1 boilerplate, 1 content, 0 unknown, HIDDEN
    loose: bool = False              # told by class words alone


def _place(tag: str, attributes: str, up: _Open) -> tuple[int, bool, bool]:
    """What an element tells about the blocks inside it; a boilerplate element overrules what elements below it tell, but for hidden ones.

    Returns place, shut and loose."""
    if up.place == HIDDEN:
        return HIDDEN, True, False
    words: set[str] = set()
    for name, value in HINT.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return HIDDEN, True, False
        if name in ("class", "id", "role"):
            words.update(PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
    if tag in BAD_TAGS or (tag == "header" and up.place <= 0 and not up.shut):
        return -1, True, False
    if up.shut:
        return -1, True, up.loose
    if tag in ("body", "html"):
        return 0, False, False
    if tag in GOOD_TAGS and not words & {"comment", "comments", "reply", "related"}:
        return 1, False, False
    if words & BAD_WORDS and not (tag in GOOD_TAGS or {"article", "content", "main"} & words):
        return -1, True, True
    if words & GOOD_WORDS:
        return 1, False, True
    return up.place, False, up.loose


@dataclass
class _Tag:
    start: int
    end: int
    closes: bool
    name: str                        # empty: a comment, a declaration or a cut-off tag
    attributes: str
    skip_to: int = -1                # number of the tag that ends a skipped element


def _tags(page: str) -> list[_Tag]:
    """The markup of a page in order. What ends only at its own closing tag (scripts and the like) is one piece, and a skipped element
    knows where it ends; one that is never closed is nothing but its tag."""
    out: list[_Tag] = []
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()
    at, size = 0, len(page)
    while at < size and (m := TOKEN.search(page, at)):
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name or not m[0].endswith(">"):
            out.append(_Tag(m.start(), at, False, "", ""))
            continue
        t = _Tag(m.start(), at, bool(end), name.lower(), attributes)
        if t.name in UNTIL_END and not t.closes and not attributes.endswith("/"):
            close = None if t.name in endless else re.compile(rf"</{t.name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if close is None:
                endless.add(t.name)
            at = t.end = close.end() if close else size
        elif t.name in SKIPPED:
            if not t.closes and not attributes.endswith("/"):
                opened.setdefault(t.name, []).append(len(out))
            elif t.closes and opened.get(t.name):
                out[opened[t.name].pop()].skip_to = len(out)
        out.append(t)
    return out


def blocks_of(page: str | None) -> list[Block]:
    """Blocks of text of a page, in page order. The work grows with the page, however deep its elements are nested."""
    page = page or ""
    out: list[Block] = []
    stack = [_Open("", None, 1, 0, False, False)]
    places: dict[str, list[int]] = {}                                # of each tag, where it stands in the stack
    text: list[str] = []
    link_chars, link_open = 0, False

    def close_block() -> None:
        nonlocal text, link_chars
        if text:
            whole = " ".join("".join(text).split())
            top = stack[-1]
            if whole and not top.mute:
                out.append(Block(whole, link_chars, top.tag, top, top.place, top.loose))
        text, link_chars = [], 0

    def pop_to(k: int) -> None:
        nonlocal link_open
        close_block()
        link_open = False
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def read(piece: str) -> None:
        nonlocal link_chars
        if piece:
            piece = entities.unescape(piece)
            text.append(piece)
            if link_open:
                link_chars += len(piece.strip())

    tags = _tags(page)
    at, i = 0, 0
    while i < len(tags):
        t = tags[i]
        i += 1
        read(page[at:t.start])
        at = t.end
        if t.skip_to >= 0:                                           # the element is left out, markup inside it included
            i = t.skip_to + 1
            at = tags[t.skip_to].end
            continue
        tag = t.name
        if tag == "br":
            text.append(" ")
        if tag == "a":
            link_open = not t.closes
        if tag not in BLOCK:
            continue
        if t.closes:
            if k := innermost((tag,)):
                pop_to(k)
            else:
                close_block()
            continue
        same = ENDS_SAME.get(tag, ())
        if tag in ENDS_P:
            same = (*same, "p")
        if same and (k := innermost(same)) and k >= innermost(BOUNDS):
            pop_to(k)
        close_block()
        link_open = False
        if tag in VOID:
            continue
        up = stack[-1]
        place, shut, loose = _place(tag, t.attributes, up)
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, up, up.depth + 1, place, shut, loose, up.mute or tag == "head"))
    read(page[at:])
    close_block()
    return out


def features(b: Block) -> list[str]:
    """What the classifier sees: the text, not the place."""
    words = b.text.count(" ") + 1
    share = b.link / max(1, len(b.text))
    kind = "h" if re.fullmatch(r"h[1-6]", b.tag) else b.tag if b.tag in ("p", "li", "td", "blockquote", "pre") else "other"
    return [f"link {min(4, int(share * 5))}", f"words {min(6, int(math.log2(words)))}", f"end {b.text[-1] in '.!?:;…'}", f"tag {kind}"]


def learn(pages: DataFrame, s: Settings = Settings()) -> dict[str, float]:
    """Log-odds of each feature from blocks in telling places, over a sample of pages chosen by a hash of their html.

    All pages count alike, so one with very many blocks does not outweigh the others."""
    rows = pages.select("html").where("html is not null")
    share = min(1.0, s.sample_pages / max(1, rows.count()))
    chosen = sampled(rows, share, "html")

    def run(batches):
        for batch in batches:
            n = Counter()
            for page in batch["html"]:
                told = [(b, max(-1, b.place)) for b in blocks_of(page) if b.place]
                of = Counter(p for _, p in told)
                for b, p in told:
                    n.update({(f, p): 1 / of[p] for f in features(b)})
            yield pd.DataFrame([(f, p, k) for (f, p), k in n.items()], columns=["feature", "place", "n"])
    counts = chosen.mapInPandas(run, "feature string, place int, n double").groupBy("feature", "place").agg(F.sum("n").alias("n")).collect()
    by = {(r["feature"], r["place"]): r["n"] for r in counts}                       # some tens of features
    total = {p: sum(n for (f, q), n in by.items() if q == p and f.startswith("end")) for p in (-1, 1)}
    return {f: math.log((by.get((f, 1), 0) + 0.5) / (total[1] + 1)) - math.log((by.get((f, -1), 0) + 0.5) / (total[-1] + 1))
            for f in {f for f, _ in by}}


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: node i is tied to the source by odds[i] > 0, to the sink by -odds[i] > 0.

    From each node with excess the flow goes to the nearest node with room, along edges with capacity left. A set from which no such
    node can be reached stays cut off for good and is not searched again."""
    left = list(odds)
    ties: list[dict[int, float]] = [{} for _ in odds]
    for i, j, w in edges:
        ties[i][j] = ties[i].get(j, 0.0) + w
        ties[j][i] = ties[j].get(i, 0.0) + w
    closed = [False] * len(odds)
    tiny = 1e-9
    for start in range(len(odds)):
        while left[start] > tiny and not closed[start]:
            came, queue, goal = {start: -1}, deque([start]), -1
            while queue and goal < 0:
                i = queue.popleft()
                for j, w in ties[i].items():
                    if w > tiny and j not in came and not closed[j]:
                        came[j] = i
                        if left[j] < -tiny:
                            goal = j
                            break
                        queue.append(j)
            if goal < 0:
                for i in came:
                    closed[i] = True
                break
            flow, j = min(left[start], -left[goal]), goal
            while came[j] >= 0:
                flow, j = min(flow, ties[came[j]][j]), came[j]
            left[start] -= flow
            left[goal] += flow
            j = goal
            while came[j] >= 0:
                ties[came[j]][j] -= flow
                ties[j][came[j]] += flow
                j = came[j]
    return closed


def ties_of(blocks: list[Block], s: Settings) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours and next siblings. From a block to the next the way through the tree is as long as the markup
    between them, so all ways together are as long as the page."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1].node
            out.append((i - 1, i, s.near + s.shared * _shared_depth(a, b.node) / max(a.depth, b.node.depth)))
        up = id(b.node.up)
        if (k := last.get(up)) is not None and k != i - 1:
            out.append((k, i, s.sibling))
        last[up] = i
    return out


def _shared_depth(a: _Open, b: _Open) -> int:
    """Open elements that two places share, the root included."""
    while a.depth > b.depth:
        a = a.up
    while b.depth > a.depth:
        b = b.up
    while a is not b:
        a, b = a.up, b.up
    return a.depth


def main_text(page: str | None, weights: dict[str, float], s: Settings = Settings()) -> str:
    blocks = blocks_of(page)
    text = [max(-s.most, min(s.most, sum(weights.get(f, 0.0) for f in features(b)))) for b in blocks]
    for half in (1.0, 0.5):                                          # the weight of class words
        odds = [-math.inf if b.place == HIDDEN else t + s.place * b.place * (half if b.loose else 1.0) for b, t in zip(blocks, text)]
        side = minimum_cut(odds, ties_of(blocks, s))
        if any(side) or not any(b.loose for b in blocks):
            break
    return "\n\n".join(b.text for b, content in zip(blocks, side) if content)


def extracted(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    weights = learn(pages, s)

    def run(batches):
        for batch in batches:
            batch["text"] = [main_text(page, weights, s) for page in batch.pop("html")]
            batch["n_chars"] = batch["text"].str.len().astype("int64")
            yield batch
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
