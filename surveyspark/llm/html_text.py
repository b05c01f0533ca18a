"""Main text of web pages by block rules in two passes.

First pass: the page is cut into blocks at block-level tags.  Length, link
density and stop-word density classify every block as good, bad, or undecided
(short, or nearly good).  The page part that a block stands in, as the markup
states it, settles what these leave open: in article and main, undecided blocks
are good, and links count only where the part as a whole is mostly links (a
teaser) or in a list of nothing but links (a menu); blocks of navigation, forms,
adverts, comments ... are bad.  An article inside comments or teasers is one of
them; one inside a wrapper with a layout name (sidebar, menu ...) is text.
Names count by whole class or id: each of its words must say so.  A page without
any good block is classified again: by length alone, if its prose has hardly any
of the known stop words (another language); then as if parts with layout names,
then also parts tagged so, were open.  Second pass: blocks that are still
undecided take the label of the nearest decided neighbours.

A null or empty page gives an empty text; ids may be null or repeated; markup
that is cut off at the end of the page is dropped, and open elements end there.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.words import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|</\Z""",
    re.S | re.I)
HINT = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside form menu dialog button fieldset".split())
#: Names of parts that are never the main text, whatever stands in them.
PART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies disqus "
    "respond related recommended teaser teasers".split())
#: Names of parts of a page's layout; wrappers of the whole page may carry them too.
LAYOUT_WORDS = frozenset(
    "banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer header masthead topbar cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social pagination pager "
    "toolbar tags".split())
#: Words that go with these in a name without giving it another meaning.
NEUTRAL_WORDS = frozenset(
    "container wrapper wrap list box block bar section area site page main top bottom left right link links item items form button "
    "buttons post posts article articles entry entries content story stories icon icons group inner outer row col column slot unit "
    "panel media user reader new view layout text body title fixed sticky primary secondary global".split())
OWN_HEADER = frozenset("post article entry content story main title text".split())
HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Names that say whether a page has such a part, not that they are one.
HINT_STATE = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without|is)[-_]\S+")

#: Stop words of the languages at hand; their density tells prose from lists of links.
STOP_WORDS = frozenset(
    "the of and to in is that it for as with was on by this be are from or an at not have but they which one you were all "
    "le la les de des du et un une en est que qui dans pour par sur au pas avec ce se plus ne son il elle "
    "der die das und zu den von ist mit für auf ein eine dem nicht im auch es sich des als an werden aus "
    "el los las y del que en por con una para no su al se lo como más pero sus".split())

SHORT, LONG = 70, 200
MANY_LINKS = 0.33
#: A block is all link from this share on; so many such list items in a row are a menu.
ALL_LINK, MENU = 0.9, 3
#: Prose with a smaller share of the stop words above is in another language.
STRANGE = 0.05
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.10, 0.20


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block(NamedTuple):
    text: str
    linked: int                 # characters inside links
    role: str                   # text, boilerplate (by tag), part or hinted (by name), or open
    heading: bool
    item: bool                  # inside a list item
    part: int                   # number of the innermost article or main; 0: none


class Place(NamedTuple):
    """An open element and what holds inside it."""
    name: str
    role: str
    item: bool
    part: int


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that are not empty."""
    out: list[Block] = []
    outside = Place("", "open", False, 0)
    stack: list[Place] = []
    pieces: list[str] = []
    linked, in_link, here, n_parts = 0, 0, outside, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), here.role, here.name in HEADINGS, here.item, here.part))
        pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = max(0, in_link + (-1 if m["close"] else 1))
        if name not in BLOCK_TAGS and name != "button":
            hint = "" if m["close"] or name in VOID_TAGS or name == "a" or not m["attrs"].strip() else m["attrs"]
            if not hint and not any(p.name == name for p in stack[-3:]):
                continue
            if hint and not named(hint):
                continue
        flush()
        in_link = in_link if name == "a" else 0
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        elif name not in VOID_TAGS and not m["attrs"].endswith("/"):
            if name == "p" or name == "li":                 # these end at the next one of their kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                    if stack[k].name not in ("p", "b", "i", "em", "strong", "span"):
                        break
            outer = stack[-1] if stack else outside
            own = name in ("article", "main")
            n_parts += own
            stack.append(Place(name, role_inside(name, m["attrs"], outer.role), not own and (outer.item or name == "li"),
                               n_parts if own else outer.part))
        here = stack[-1] if stack else outside
    add(page[at:])
    flush()
    return out


def named(attrs: str) -> str:
    """What class, id, role and label name an element: "part", "hinted" (a layout name), "header" (of layout names only that) or ""."""
    kinds = set()
    for m in HINT.finditer(attrs):
        value = HINT_STATE.sub(" ", m[2] or m[3] or m[4] or "")
        for token in [value] if m[1].lower() == "aria-label" else value.split():
            words = {w.lower() for w in HINT_WORD.findall(token)}
            parts, layout = words & PART_WORDS, words & LAYOUT_WORDS
            if not parts and not layout or words - parts - layout - NEUTRAL_WORDS:
                continue
            if parts:
                return "part"
            if layout != {"header"}:
                kinds.add("hinted")
            elif not words & OWN_HEADER:
                kinds.add("header")
    return "hinted" if "hinted" in kinds else "header" if kinds else ""


def role_inside(name: str, attrs: str, outer: str) -> str:
    if outer in ("boilerplate", "part") or name in ("html", "body"):
        return outer
    if name in BOILERPLATE_TAGS:
        return "boilerplate"
    kind = named(attrs) if attrs else ""
    if kind == "part":
        return "part"
    if name == "article" or name == "main":                 # also inside a wrapper with a layout name, unless it has one itself
        return "hinted" if outer == "hinted" and kind else "text"
    if outer == "hinted":
        return "hinted"
    if name == "header":
        return outer if outer == "text" and kind != "hinted" else "boilerplate"
    if kind == "header":
        return outer if outer == "text" else "hinted"
    return "hinted" if kind else outer


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP_WORDS for w in words), len(words)


def width(text: str) -> int:
    """Its length, in which characters of scripts that write a word with one or two count twice."""
    return len(text) if text.isascii() else len(text) + sum(c >= "\u2e80" for c in text)


def measure(text: str, linked: int, by_length: bool = False) -> str:
    """Good, near, few, short or bad by length, link density and (unless ``by_length``) stop words alone."""
    if linked > MANY_LINKS * len(text):
        return "bad"
    size = width(text)
    if size < SHORT:
        return "short"
    if by_length:
        return "good" if size > LONG else "near"
    stops, words = stop_words(text)
    if stops >= MANY_STOP_WORDS * words:
        return "good" if size > LONG else "near"
    return "near" if stops >= FEW_STOP_WORDS * words else "few"


def without_links(blocks: list[Block]) -> list[int]:
    """The linked characters that count against each block: none in an article that is not mostly links, but for lists of
    at least ``MENU`` items in a row that are all link."""
    total, linked = {}, {}
    for b in blocks:
        total[b.part] = total.get(b.part, 0) + len(b.text)
        linked[b.part] = linked.get(b.part, 0) + b.linked
    counted = [b.linked if b.role != "text" or linked[b.part] > MANY_LINKS * total[b.part] else 0 for b in blocks]
    start = 0
    for i in range(len(blocks) + 1):
        if i < len(blocks) and blocks[i].role == "text" and blocks[i].item and blocks[i].linked >= ALL_LINK * len(blocks[i].text):
            continue
        if i - start >= MENU:
            counted[start:i] = [b.linked for b in blocks[start:i]]
        start = i + 1
    return counted


def classify(label: str, role: str, linked: int, article: bool) -> str:
    """First pass, from what :func:`measure` says: good, bad, short or near; ``article``: the page has one."""
    if role == "text":                                      # what is undecided is text; few stop words need good neighbours
        return {"short": "good", "near": "good", "few": "near"}.get(label, label)
    if role != "open":
        return "bad"
    if label == "few" or label == "short" and (linked or article):
        return "bad"
    return label


def settle(labels: list[str], headings: list[bool]) -> list[bool]:
    """Second pass: an undecided block is kept if its nearest decided neighbours are good; where they differ, a nearly
    good block is kept, and a short one only if it is a heading with good text after it."""
    n = len(labels)
    left, right, last = [""] * n, [""] * n, ""
    for i in range(n):
        left[i] = last
        last = labels[i] if labels[i] in ("good", "bad") else last
    last = ""
    for i in range(n - 1, -1, -1):
        right[i] = last
        last = labels[i] if labels[i] in ("good", "bad") else last
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        around = {left[i], right[i]} - {""}
        if len(around) == 1:
            out.append(around == {"good"})
        else:
            out.append(label == "near" or headings[i] and right[i] == "good")
    return out


def main_text(page: str) -> str:
    """Blocks of main text in page order, one a line."""
    blocks = blocks_of(page)
    counted = without_links(blocks)
    article = any(b.role == "text" for b in blocks)

    def labels_of(opened: tuple[str, ...], by_length: bool) -> list[str]:
        return [classify(measure(b.text, n, by_length), "open" if b.role in opened else b.role, n, article) for b, n in zip(blocks, counted)]

    labels = first = labels_of((), False)
    if "good" not in labels:
        stops, words = map(sum, zip((0, 0), *(stop_words(b.text) for b, n in zip(blocks, counted)
                                              if width(b.text) >= SHORT and n <= MANY_LINKS * len(b.text))))
        other = stops < STRANGE * words
        for opened in ((), ("hinted",), ("hinted", "boilerplate")):
            if "good" not in labels:
                labels = labels_of(opened, other)
    keep = settle(labels if "good" in labels else first, [b.heading for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns of ``keep``, and ``text``."""
    bounded_batches(pages.sparkSession)
    src = pages.select(*[F.col(f"`{c}`") for c in (id_col, *keep)], F.col(f"`{html_col}`").cast("string").alias("__html"))
    names = [id_col, *keep, "text"]
    schema = T.StructType([src.schema[c] for c in names[:-1]] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, type=pa.string())], names=names)

    return src.mapInArrow(run, schema)
