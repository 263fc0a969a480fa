"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Elements that are never content (menus,
forms, scripts, notices, reader comments, ...) are taken out with all they hold. Of the rest,
each word scores positive, less within links, and each tag negative, with weights learnt from
labelled pages: how much more often a tag, or a word of a link, stands outside the main text
than inside. One linear scan finds the contiguous region with the highest sum. Its text is
given by whole blocks: the region is widened to the smallest element that holds it, and below
the body to the children that lie in it for the most part.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import map_arrow

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_UNENDED = re.compile(r"<(?:!--|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
#: An opening tag ends an open sibling of these kinds.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an open sibling stops.
SCOPES = frozenset("ul ol menu dl table tbody thead tfoot select body html article main section div".split())

# What is never main text, by element, by role and by a word of class or id.
NEVER = frozenset("head nav footer aside form script style noscript template iframe svg math object embed canvas video audio button select textarea dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset("""ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs
footer foot masthead topbar cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations
comment comments commentlist respond reply replies disqus discussion widget widgets toolbar pagination pager login search skip copyright banner""".split())
#: Words of class or id that name the article itself: with one of them, ``header`` doesn't exclude.
OWN = frozenset("article post entry content story main body page".split())
CONTENT = frozenset(["article", "main"])
#: A short block of one of these kinds that begins so is a notice of rights, if it isn't in an article or main.
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)", re.I)
_RIGHTS_IN = frozenset("div section td center address".split())
#: The weight of a word within a link has this name among the tags' weights.
LINK_WORD = "a word"
#: Names of page parts that also turn up in names of wrappers, and the words that wrappers have.
PARTS = frozenset("sidebar sidebars nav navbar navigation menu footer foot topbar toolbar search widget widgets login skip banner header".split())
WRAPPERS = frozenset("layout wrapper wrap has with no container page site grid".split())


@dataclass(slots=True)
class Element:
    """An element; ``words`` counts all words inside, ``content`` whether an article or main is inside, ``link`` whether it is in a link."""

    name: str
    parent: int
    depth: int
    out: bool = False
    link: bool = False
    words: int = 0
    content: bool = False
    said: bool = False


@dataclass(slots=True)
class Page:
    """Elements by number and tokens (element, text or None, tag); a token with a text is a piece of text."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0)])
    tokens: list[tuple[int, str | None, str]] = field(default_factory=list)


def _excluded(name: str, attributes: str, inside_content: bool) -> bool:
    if name in NEVER:
        return True
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    if name == "header" and not inside_content:
        return True
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    words = {w.lower() for w in _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    hit = words & NAMES
    if hit and hit <= PARTS and words & WRAPPERS:
        return False
    return bool(hit) or "header" in words and not words & OWN and not inside_content


def parse(source: str) -> Page:
    """Elements and tokens of a page; unclosed and stray tags are put right as browsers do in the main."""
    page = Page()
    elements, tokens = page.elements, page.tokens
    stack, at, n = [0], 0, len(source)
    # places in the stack of the open elements of each name, so that no depth makes a look-up long
    places: dict[str, list[int]] = {}
    last_end = source.rfind(">")

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            piece = html.unescape(piece) if "&" in piece else piece
            tokens.append((stack[-1], piece, ""))
            elements[stack[-1]].words += len(piece.split())
        elif piece:
            tokens.append((stack[-1], " ", ""))

    def innermost(names: set[str] | frozenset[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def shut(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        k = innermost(names)
        if k and k >= innermost(stop):
            for e in stack[k:]:
                places[elements[e].name].pop()
            del stack[k:]

    while at < n:
        # without an end to come there is no tag to look for
        m = _TAG.search(source, at) if at <= last_end else None
        if m is None:
            # a tag or comment that never ends is no text
            open_end = _UNENDED.search(source, at)
            text(source[at : open_end.start()] if open_end else source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "p" and not places.get("p"):
                tokens.append((stack[-1], None, "p"))
            elif name not in ("body", "html"):
                shut({name}, CONTENT - {name})
            tokens.append((stack[-1], None, name))
            continue
        attributes = m[3] or m[6] or ""
        if name in CLOSES_P:
            shut({"p"}, SCOPES | {"li", "td", "th", "dd", "dt", "blockquote", "form"})
        if name in SIBLINGS:
            shut(SIBLINGS[name], SCOPES - {"div"})
        inside = any(places.get(x) for x in CONTENT)
        tokens.append((stack[-1], None, name))
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        elements.append(Element(name, stack[-1], len(stack), name not in ("body", "html") and _excluded(name, attributes, inside), name == "a" or elements[stack[-1]].link))
        if name in RAW:
            end = re.compile(f"</{name}(?![a-zA-Z0-9-])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append(len(elements) - 1)
    home: list[bool] = []
    for e in elements:
        home.append(e.name in CONTENT or e.parent >= 0 and home[e.parent])
    for k, piece, _ in tokens:
        e = elements[k]
        if piece is not None and not e.said and piece != " ":
            e.said = True
            if e.name in _RIGHTS_IN and not home[k] and e.words < 40 and _RIGHTS.match(piece):
                e.out = True
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.words += e.words
        up.content = up.content or e.content or e.name in CONTENT and not e.out
    for e in elements:
        # a wrapper of the whole article is not a menu, whatever its name
        if e.out and e.name not in ("head", "script", "style", "template", "noscript") and (e.content or e.name == "form" and 2 * e.words > elements[0].words):
            e.out = False
    return page


def _alive(page: Page) -> list[bool]:
    """Whether each element is in no excluded one; parents come first."""
    alive: list[bool] = []
    for e in page.elements:
        alive.append(not e.out and (e.parent < 0 or alive[e.parent]))
    return alive


def best_region(page: Page, alive: list[bool], weights: dict[str, float], unknown: float = -2.0) -> tuple[int, int]:
    """First and last token of the best region by one scan, (0, -1) if there is no word."""
    best, best_at, total, start = 0.0, (0, -1), 0.0, 0
    link_word = weights.get(LINK_WORD, 1.0)
    for k, (e, text, tag) in enumerate(page.tokens):
        if not alive[e]:
            continue
        if text is None:
            total += weights.get(tag, unknown)
        else:
            total += len(text.split()) * (link_word if page.elements[e].link else 1.0)
        if total <= 0:
            total, start = 0.0, k + 1
        elif text is not None and total > best:
            best, best_at = total, (start, k)
    return best_at


def _chain(page: Page, e: int) -> list[int]:
    chain = [e]
    while page.elements[chain[-1]].parent >= 0:
        chain.append(page.elements[chain[-1]].parent)
    return chain[::-1]


def widen(page: Page, alive: list[bool], first: int, last: int) -> tuple[int, int]:
    """The region as whole blocks.

    If the smallest element that holds it is a block, that is taken whole, and so is an article or
    main that it is in. If it is the body, those of its children are taken, from the first to the
    last, that have at least half of their words in the region.
    """
    live = [k for k in range(first, last + 1) if page.tokens[k][1] is not None and alive[page.tokens[k][0]] and page.tokens[k][1] != " "]
    chains = [_chain(page, page.tokens[k][0]) for k in (live[0], live[-1])]
    common = 0
    for a, b in zip(*chains, strict=False):
        if a != b:
            break
        common = a
    whole = next((e for e in reversed(_chain(page, common)) if page.elements[e].name in CONTENT), None)
    # the block that holds an inline element is taken whole
    while whole is None and page.elements[common].parent >= 0 and page.elements[common].name not in BLOCKS:
        common = page.elements[common].parent
    if whole is None and page.elements[common].name not in ("", "html", "body"):
        whole = common
    if whole is not None:
        held = [False] * len(page.elements)
        for k, e in enumerate(page.elements):
            held[k] = k == whole or e.parent >= 0 and held[e.parent]
        own = [k for k, t in enumerate(page.tokens) if held[t[0]] and t[1] is not None]
        return own[0], own[-1]
    # the child of ``common`` that each element is in
    child = [-1] * len(page.elements)
    for k, e in enumerate(page.elements):
        child[k] = k if e.parent == common else child[e.parent] if e.parent >= 0 else -1
    words: Counter = Counter()
    found: Counter = Counter()
    for k, (e, text, _) in enumerate(page.tokens):
        if text is not None and alive[e]:
            n = len(text.split())
            words[child[e]] += n
            found[child[e]] += n if first <= k <= last else 0
    own = [k for k, (e, text, _) in enumerate(page.tokens) if text is not None and alive[e] and text != " " and (2 * found[child[e]] >= words[child[e]] if child[e] >= 0 else first <= k <= last)]
    return (own[0], own[-1]) if own else (first, last)


def region_text(page: Page, alive: list[bool], first: int, last: int) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        joined = " ".join("".join(held).split())
        if joined:
            blocks.append(joined)
        held.clear()

    for e, text, tag in page.tokens[first : last + 1]:
        if text is None:
            if tag in BLOCKS:
                end()
            elif tag == "br" or not alive[e]:
                held.append(" ")
        elif alive[e]:
            held.append(text)
    end()
    return "\n\n".join(blocks)


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Main text of one page: blocks in page order, joined by two line feeds; empty if there is none."""
    page = parse(source or "")
    alive = _alive(page)
    first, last = best_region(page, alive, weights)
    if last < first:
        return ""
    return region_text(page, alive, *widen(page, alive, first, last))


def tag_counts(source: str | None) -> Counter | None:
    """(tag, inside) counts of a page that labels its main text by one article or main element, else None.

    The label's own tags count as outside, and as tags of a ``div`` too, so that pages without the label are learnt as well.
    """
    page = parse(source or "")
    homes = [k for k, e in enumerate(page.elements) if e.name in CONTENT and not e.out]
    if len(homes) != 1 or not page.elements[homes[0]].words:
        return None
    inside = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        inside[k] = k == homes[0] or e.parent >= 0 and inside[e.parent]
    alive = _alive(page)
    out: Counter = Counter()
    for e, text, tag in page.tokens:
        if text is not None:
            out["word", inside[e] and alive[e]] += len(text.split())
            if page.elements[e].link:
                out[LINK_WORD, inside[e] and alive[e]] += len(text.split())
        else:
            out[tag, inside[e] and alive[e] and tag not in CONTENT] += 1
            if tag in CONTENT:
                out["div", False] += 1
    return out


# Prior counts of tags (inside, outside main text) that stand for plain pages.
PRIOR = {"article": (1, 400), "main": (1, 400), "p": (40, 2), "br": (10, 2), "b": (5, 1), "i": (5, 1), "em": (5, 1), "strong": (5, 1), "span": (4, 4), "a": (4, 8), "h1": (5, 1), "h2": (8, 2), "h3": (8, 3), "blockquote": (5, 1), "pre": (5, 1), "code": (5, 1), "ul": (2, 6), "ol": (3, 2), "li": (4, 12), "img": (3, 3), "figure": (4, 1), "figcaption": (4, 1), "table": (2, 2), "tr": (4, 4), "td": (8, 8), "th": (4, 4), "div": (4, 16), "section": (3, 5)}


def learn_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Negative weight of each tag: log odds of standing inside the main text, from -8 to -0.1; and of a link's word, from 0.05 to 1.

    The latter is its odds of standing inside, against those of any word.
    """
    tags = {t for t, _ in counts} - {"word", LINK_WORD} | set(PRIOR)
    out = {}
    for t in tags:
        a, b = PRIOR.get(t, (1, 4))
        out[t] = max(-8.0, min(-0.1, math.log((counts.get((t, True), 0) + a) / (counts.get((t, False), 0) + b))))
    odds = lambda t, a, b: (counts.get((t, True), 0) + a) / (counts.get((t, False), 0) + b)
    out[LINK_WORD] = max(0.05, min(1.0, odds(LINK_WORD, 10, 100) / odds("word", 100, 100)))
    return out


def train_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 1000) -> dict[str, float]:
    """Weights from about ``sample`` pages, chosen by a hash of the id; pages without a label of their own don't count."""
    n = pages.count()
    if not n:
        return learn_weights({})
    share = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0):
                total.update(tag_counts(source.as_py()) or {})
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([v for _, v in rows], pa.int64())], names=["tag", "inside", "n"])

    counts = map_arrow(pages.where(share < sample / n).select(F.col(html_col).alias("html")), run, "tag string, inside boolean, n bigint")
    return learn_weights({(r[0], r[1]): r[2] for r in counts.groupBy("tag", "inside").agg(F.sum("n")).collect()})


def extract_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for each input row.

    Null pages count as empty and have an empty text, like pages without a word of main
    text. Repeated rows are worked on as often as they occur; an empty table gives an empty
    result; other columns are ignored. Pages of any length are read whole.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                said = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(said, pa.string()), pa.array(list(map(len, said)), pa.int64())], names=["id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return map_arrow(src, run, f"id {types['id']}, url {types['url']}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
