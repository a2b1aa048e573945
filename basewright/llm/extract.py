"""Main text of HTML pages by tree scoring.

A page becomes a tree of its block elements; text between two block boundaries is a segment of the block it stands
in. Segments pass points for their length and commas to their block and its ancestors, less with each level, and a
block's points are discounted by its share of link text. The best block, or the container of the text that it lies
in, is kept whole, and those siblings that score near it or are prose; menus, headers, footers, notices, adverts, forms,
comments and the like are left out by tag, role or name. Names that are also ordinary words only lower points: within
the container, a section, or an element with a heading, that has a paragraph of prose stays whatever it is called. No
name leaves out an element around the best block, and lists of dated entries by readers are told by their structure.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import slices, table

# Elements by what they are.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head nav footer menu dialog".split())
#: Left out unless the best block lies within.
OUT_UNLESS_BEST = frozenset("aside form fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names that leave out an element whatever else its class or id says.
SURE_NAMES = frozenset("comment comments commentlist disqus adsense outbrain taboola sidebar navbar navigation breadcrumb breadcrumbs pagination newsletter gdpr advertisement advertising adverts".split())
#: Names that do so if there are but these and qualifiers, as they may be parts of others.
OUT_NAMES = frozenset("ad ads adv advert banner sponsor sponsored promo nav pager masthead topbar aside cookie cookies consent rail login".split())
#: As OUT_NAMES, but ordinary words, which may name a part of an article.
MAYBE_NAMES = frozenset("promotion menu toolbar footer widget related recommended respond replies discussion notice popup modal overlay alert disclaimer share sharing social subscribe subscription signup form".split())
#: What may stand beside them, so that "form-factor" or "share-price" do not count.
QUALIFIERS = frozenset(
    "left right top bottom main site page global primary secondary inner outer list area box container wrapper wrap section block item items bar button buttons link links unit slot content post posts article articles story stories the"
    " this now more reading reader user trail card info law thread google news sign up in".split()
)
#: Parts that turn a name into its opposite.
DENIALS = frozenset("has no with without not non is".split())
#: Characters of a paragraph of prose.
PROSE = 80
_DATED = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d{2}\b|\b\d+ \w+ ago\b")
_ENDS = (".", "!", "?", "…", "。")
#: What points of text within a named element are multiplied by.
NAMED = 0.1
#: What starts an element ends an open one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Where the search for an element to end stops.
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+')|[="'])*+)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Block:
    __slots__ = ("chars", "dated", "headed", "inside", "link_chars", "named", "others", "out", "parent", "points", "prose", "tag", "within")

    def __init__(self, tag: str, parent: Block | None, out: bool, named: int = 0):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named  # named: 1 by an ordinary word, 2 surely
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.within = (named > 0) + (0 if parent is None else parent.within)  # named elements around, itself included
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        self.prose = self.headed = False  # has a paragraph of prose, a heading
        self.dated = self.others = 0  # segments that are short and dated, and others


def _names(value: str) -> Iterator[set[str]]:
    for token in value.split():
        yield {x.lower() for x in _NAME.findall(token)}


def _named(parts: set[str], inside: bool) -> int:
    if parts & DENIALS:
        return 0
    if parts & SURE_NAMES:
        return 2
    names = parts & (OUT_NAMES | MAYBE_NAMES)
    if names and parts <= names | QUALIFIERS:
        return 2 if names & OUT_NAMES else 1
    return 2 if "header" in parts and parts <= QUALIFIERS | {"header"} and not inside else 0


def _left_out(tag: str, attributes: str, parent: Block) -> tuple[bool, int]:
    """Whether an element is left out in any case, and how surely its name, tag or role leaves it out otherwise."""
    if tag in OUT or (tag == "header" and not parent.inside):
        return True, 0
    named = 2 if tag in OUT_UNLESS_BEST else 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, named
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, 0
        if name == "role" and value.lower() in OUT_ROLES:
            named = 2
        if name in ("class", "id"):
            named = max([named, *(_named(parts, parent.inside) for parts in _names(value))])
    return False, named


def segments(page: str) -> list[tuple[Block, str, int]]:
    """(block, text, characters in links) of a page's segments in order, without what is left out."""
    root = Block("html", None, False)
    stack, out = [root], []
    pieces: list[str] = []
    link_at, link_chars = None, 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not stack[-1].out:
                out.append((stack[-1], text, min(link_chars, len(text))))
            pieces.clear()
            link_chars = 0

    def close(depth: int) -> None:
        nonlocal link_at
        flush()
        del stack[depth:]
        if link_at is not None and link_at > len(stack):
            link_at = None

    def text(piece: str) -> None:
        nonlocal link_chars
        pieces.append(piece)
        if link_at is not None:
            link_chars += len(piece.strip())

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not end and not m[3].endswith("/"):
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closing.end() if closing else len(page)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link_at = None if end else len(stack)
        elif tag in BLOCKS:
            if end:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
                else:
                    flush()
                continue
            flush()
            ends = CLOSES.get(tag, ())
            if ends:
                first = None
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in SCOPE[tag]:
                        break
                    if stack[depth].tag in ends:
                        first = depth
                if first is not None:
                    close(first)
            if stack[-1].tag == "p":  # a block ends an open paragraph
                close(len(stack) - 1)
            if tag not in VOID and not (tag in ("html", "body") and len(stack) > 2):
                parent = stack[-1]
                gone, named = _left_out(tag, m[3], parent)
                stack.append(Block(tag, parent, parent.out or gone, named))
    if at < len(page):
        rest = page[at:]
        text(rest)
    flush()
    return out


def _container(best: Block) -> Block:
    """The nearest article that a block is or lies in, else the nearest main, else the outermost wrapper reached
    without taking in text that is dense with links."""
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for tag in ("article", "main"):
        for b in above:
            if b.tag == tag:
                return b
    top = best
    for b in above[1:]:
        chars, links = b.chars - top.chars, b.link_chars - top.link_chars
        if b.tag not in ("div", "section") or links > 0.25 * chars:
            break
        top = b
    return top


def main_text(page: str) -> str:
    """Blocks of the main text, joined by an empty line; empty if there is none."""
    found = segments(page)
    if not found:
        return ""
    scored: dict[int, Block] = {}
    every: dict[int, Block] = {}
    for block, text, links in found:
        points = (1 if len(text) >= 25 else 0) + min(len(text) / 100, 3) + 0.5 * (text.count(",") + text.count("、") + text.count("，"))
        points *= (1 - links / len(text)) * NAMED ** min(block.within, 4)
        at, level = block, 0
        prose, headed = len(text) >= PROSE and text.endswith(_ENDS) and links < 0.25 * len(text), block.tag in HEADINGS
        dated = len(text) <= 60 and _DATED.search(text) is not None
        while at is not None:
            at.chars += len(text)
            at.link_chars += links
            at.prose |= prose
            at.headed |= headed
            at.dated += dated
            at.others += not dated
            if level < 6:  # farther ancestors get nothing that matters
                at.points += points / (1, 1, 2, 4, 8, 16)[level]
                scored[id(at)] = at
            every[id(at)] = at
            at, level = at.parent, level + 1
    containers = [b for b in scored.values() if b.tag not in ("p", *HEADINGS, "li", "html")] or list(scored.values())
    bonus = {"article": 25.0, "main": 15.0}

    def score(b: Block) -> float:
        return (b.points + bonus.get(b.tag, 0.0) * NAMED ** min(b.within, 4)) * (1 - b.link_chars / b.chars)

    best = max(containers, key=score)  # of equals the first, which is the inner one
    around: set[int] = set()
    at: Block | None = best
    while at is not None:  # no name leaves out the best block
        around.add(id(at))
        at.named, at = 0, at.parent
    top = _container(best)
    lists: dict[int, list[Block]] = {}
    known = {id(top): True}

    def lies_in(b: Block) -> bool:
        """Whether a block lies in the container."""
        path = []
        while b is not None and id(b) not in known:
            path.append(id(b))
            b = b.parent
        found = b is not None and known[id(b)]
        known.update(dict.fromkeys(path, found))
        return found

    for b in every.values():
        if b.parent is not None and b.tag in ("li", "div", "article", "section", "dd"):
            lists.setdefault(id(b.parent), []).append(b)
        if b.named == 1 and b.prose and (b.headed or b.tag == "section") and b.link_chars < 0.25 * b.chars and lies_in(b):
            b.named = 0  # a part of the article with such a title
    for b in every.values():  # entries of a name and a date and something said, several of a kind
        entries = lists.get(id(b), [])
        if id(b) not in around and len(entries) >= 2 and all(x.dated == 1 and 1 <= x.others <= 6 and not x.headed for x in entries):
            b.named = 2
    whole, near = top.tag in ("article", "main"), 0.2 * score(best)
    kept = {id(top)}
    last: dict[int, str] = {}
    for block, text, _ in found:
        at = block
        while at is not None and at.parent is not top.parent:
            at = at.parent
        if at is not None:
            last[id(at)] = text
    for b in scored.values():
        if b is top or b.parent is not top.parent or b.tag == "html" or b.named or b.link_chars >= 0.25 * b.chars:
            continue
        ends = last.get(id(b), "").endswith(_ENDS)
        prose = b.tag in ("section", "blockquote", "pre", "table", "ul", "ol", *HEADINGS) or (b.tag in ("p", "div") and ends)
        if score(b) >= near or b.tag == "h1" or (prose and not whole) or (b.tag in ("p", "h2") and b.chars > 80):
            kept.add(id(b))
    out: list[tuple[str, bool, bool]] = []
    for block, text, links in found:
        at = block
        while at is not None and id(at) not in kept and not at.named:
            at = at.parent
        if at is None or at.named:
            continue
        listed = not whole and links > 0.6 * len(text) and block.tag in ("li", "ul", "ol", "dd", "div", "td")
        out.append((text, listed, block.tag in HEADINGS))
    # outside article and main, links before the text and after it are menus, unless they stand under a heading
    first = next((i for i, x in enumerate(out) if not x[1]), len(out))
    end = len(out)
    while end > first and out[end - 1][1]:
        end -= 1
    if end > first and out[end - 1][2]:
        end = len(out)
    return "\n\n".join(x[0] for x in (out[first:end] or out))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    Null html is empty and gives an empty text. Whatever is no tag is text; elements left open end with the page.
    Ids and URLs pass as they are; repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
