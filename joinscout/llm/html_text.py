"""HTML extraction (3): two-pass block rules over a whole page.

A page is cut into blocks at block-level tags. Each block has its length, its share of characters inside links, its share of
stop words, and the containers it lies in. Some containers never hold article text: by tag or role (navigation, asides, footers,
hidden elements), or by name (a class or id whose whole name, last part, or first part before a plain word like "box" is telling).
Names like no-sidebar, has-ads or comments-open tell a state and don't count, nor do names of html, body and main; an article's name
counts as a whole only. A container by name (or a form) that holds most of the page's text, with nothing good outside, is no such
container after all.

Pass 1 looks at each block alone. Blocks in unfit containers and blocks mostly made of links are bad. Headings and short blocks stay
undecided. Long blocks are good with enough stop words, and those of middling length too; inside <article> or <main>, and on
pages whose stop words are none that are listed (other languages, technical pages), length and links alone decide.
Pass 2 gives each undecided block the label that its nearest decided neighbours share; where they differ, the nearer one
decides, in characters between them, the one before on a tie. A heading follows the next decided block. Blocks in unfit
containers say nothing about what lies outside those and are no neighbours; inside an article only its own blocks are. If no block of the
page is good, undecided ones are.

Defined cases: a null or empty page, or one without good blocks, has the text "". Unclosed comments, scripts and tags end with the page.
Repeated rows are extracted each by itself. Extra columns stay; `text` and `n_chars` replace clashing ones. Time is linear in the
page however tags nest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from joinscout.llm.common import slices

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in is was that for on as with by at from be are this it he she not or an have had his her which but they were you we all their has"
    " le la les de des du et est un une en que qui dans pour pas sur au aux par il elle ne se ce plus avec sont"
    " der die das und ist den dem von zu mit sich auf für nicht ein eine einer als auch es an werden aus er hat dass"
    " el los las y una por con para del al lo su sus se más como pero era son fue este esta".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title button select option textarea datalist".split())
RAW = frozenset("script style noscript template iframe svg title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr picture".split())
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
#: Unfit like a telling name: unless they hold the page.
FORMS = frozenset(("form", "fieldset"))
#: Of those by tag, the ones that an article begins in only because they were never closed.
UNCLOSED = frozenset("nav header menu".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or id that name what an article isn't. Compound names are cut at - and _ and at capitals.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay"
    " newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead topbar toolbar"
    " share sharing social related recommended recommendations comment comments commentlist respond disqus discussion pagination pager copyright skip".split()
)
HEADER_NAMES = frozenset(("header", "masthead", "topbar"))
#: Beginnings and ends of names that tell a state or a lack, and plain words that may follow a telling one.
STATES = frozenset("no not non without has have with is show hide open opened closed enabled disabled allowed active".split())
PLAIN = frozenset(
    "area bar block body bottom box button buttons col column container content entry feed form group header holder icons inner item items left link links list main message module outer panel"
    " placeholder post posts primary right row secondary section slot space text thread title top unit wrap wrapper zone".split()
)
LINKED, MOSTLY_LINKED = 0.33, 0.5
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.08, 0.2
#: Below this share of stop words on a whole page, they tell nothing about its blocks.
TELLING_STOPS = 0.05
#: Share of a page's text that a container by name must hold to be none.
MOST = 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_WIDE = re.compile("[\u2e80-\uffff\U00020000-\U0003ffff]")
GOOD, BAD, OPEN = 1, 0, -1
FIT, NAMED, HARD = 0, 1, 2


@dataclass
class Block:
    text: str
    linked: float
    n_words: int
    n_stops: int
    tag: str
    inside: bool
    bad: bool
    holder: int  # the innermost container that is unfit by name, -1 if there is none

    @property
    def length(self) -> int:
        """In letters of an alphabet: a character of a script without spaces stands for three."""
        return len(self.text) + 2 * len(_WIDE.findall(self.text))


def _telling(name: str, whole: bool, words: frozenset[str]) -> bool:
    """Whether a class or id names what an article isn't; with `whole`, only if nothing else is in it."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts or parts[0] in STATES or parts[-1] in STATES:
        return False
    if whole:
        return len(parts) == 1 and parts[0] in words
    return parts[-1] in words or (parts[0] in words and all(x in PLAIN or x in words for x in parts[1:]))


def _unfit(tag: str, rest: str, inside: bool) -> int:
    """Whether an element is never article text: HARD by its tag, role or style, NAMED by its class or id."""
    if tag in BAD_TAGS or (tag == "header" and not inside):
        return HARD
    found = NAMED if tag in FORMS else FIT
    for m in _NAMES.finditer(rest) if rest else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return HARD
        if key == "role" and value.lower() in BAD_ROLES:
            return HARD
        if key in ("class", "id") and tag not in ("html", "body", "main"):
            words = BAD_NAMES if inside else BAD_NAMES | HEADER_NAMES
            if any(_telling(x, tag == "article", words) for x in value.split()):
                found = NAMED
    return found


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in order, empty ones left out, and the container by name around each container by name."""
    out: list[Block] = []
    parents: list[int] = []
    stack: list[tuple[str, bool, str, int, str]] = []  # tag, and what held before it: in an article, unfit by which tag, container by name, tag of the block
    open_tags: Counter[str] = Counter()
    inside, hard, holder = False, "", -1
    pieces: list[str] = []
    linked = 0
    tag_of_block = ""

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                found = [w.strip(".,;:!?()[]\"'«»„“”%&*#$-").lower() for w in text.split(" ")]
                out.append(Block(text, min(1.0, linked / len(text)), len(found), sum(w in STOP_WORDS for w in found), tag_of_block, inside, bool(hard), holder))
        pieces, linked = [], 0

    def leave(tag: str) -> None:
        nonlocal inside, hard, holder, tag_of_block
        if not open_tags[tag]:
            return
        if tag not in INLINE:
            flush()
        while True:
            own, inside, hard, holder, tag_of_block = stack.pop()
            open_tags[own] -= 1
            if own == tag:
                return

    place, end = 0, len(page)
    while place < end:
        m = _TOKEN.search(page, place)
        text = page[place : m.start() if m else end]
        if text:
            pieces.append(text)
            if open_tags["a"]:
                linked += len(_SPACE.sub(" ", text).strip())
        if not m:
            break
        place = m.end()
        if m["cdata"] is not None:
            pieces.append(html.escape(m["cdata"], quote=False))
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            leave(tag)
            continue
        rest = m["rest"] or ""
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, place)
            place = close.end() if close else end
            if tag not in INLINE:
                pieces.append(" ")
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
            while stack and stack[-1][0] in INLINE:  # inline elements left open don't outlive their block
                leave(stack[-1][0])
            if tag == "p" or tag in HEADINGS or tag in ("li", "dt", "dd", "tr", "td", "th"):
                while stack and (stack[-1][0] == "p" or stack[-1][0] == tag):
                    leave(stack[-1][0])
        stack.append((tag, inside, hard, holder, tag_of_block))
        open_tags[tag] += 1
        kind = _unfit(tag, rest, inside or tag in CONTENT)
        if kind == NAMED:
            parents.append(holder)
            holder = len(parents) - 1
        elif kind == HARD or tag in SKIPPED:
            hard = hard or tag
        elif tag in CONTENT and (not hard or (hard in UNCLOSED and not inside)):
            inside, hard = True, ""  # an article inside a container that was never closed still counts
        if tag not in INLINE:
            tag_of_block = tag
    flush()
    return out, parents


def first_pass(b: Block, telling: bool = True) -> int:
    """The label of a block by itself; `telling` says whether stop words tell anything on its page."""
    if b.bad or b.linked > MOSTLY_LINKED:
        return BAD
    if b.linked > LINKED and not b.inside:
        return BAD
    length, stops = b.length, b.n_stops / b.n_words
    if b.tag in HEADINGS or length < SHORT or (b.linked > LINKED and length < LONG):
        return OPEN
    if b.inside or stops >= MANY_STOPS:
        return GOOD
    if length >= LONG:
        return GOOD if stops >= FEW_STOPS or not telling else OPEN
    return OPEN if stops >= FEW_STOPS or not telling else BAD


def _forgive(found: list[Block], parents: list[int], telling: bool) -> None:
    """Marks blocks in containers by name as bad, but for containers that hold MOST of the text with nothing good outside."""

    def sure(b: Block) -> bool:
        label = first_pass(b, telling)
        return label == GOOD or (b.inside and label != BAD)

    held = [0] * len(parents)
    for b in found:
        if b.holder >= 0 and not b.bad:
            held[b.holder] += len(b.text)
    for c in range(len(parents) - 1, -1, -1):  # an inner container comes after those around it
        if parents[c] >= 0:
            held[parents[c]] += held[c]
    total = sum(len(b.text) for b in found if not b.bad)
    unfit, forgiven = [True] * len(parents), set()
    good = any(b.holder < 0 and sure(b) for b in found)
    for c, parent in enumerate(parents):
        around = parent >= 0 and unfit[parent]
        unfit[c] = around or good or held[c] <= MOST * total
        if not unfit[c]:
            forgiven.add(c)
            good = any(b.holder in forgiven and sure(b) for b in found)
    for b in found:
        b.bad = b.bad or (b.holder >= 0 and unfit[b.holder])


def labels(found: list[Block], parents: list[int]) -> list[bool]:
    """Which blocks are article text, after both passes."""
    telling = sum(b.n_stops for b in found) >= TELLING_STOPS * sum(b.n_words for b in found)
    _forgive(found, parents, telling)
    first = [first_pass(b, telling) for b in found]

    def decided(order) -> dict[int, tuple[int, int]]:
        """For each block, the last decided label among its neighbours in `order` and the characters since; those inside articles stand apart."""
        state = {True: (OPEN, 0), False: (OPEN, 0)}
        out = {}
        for i in order:
            b = found[i]
            out[i] = state[b.inside]
            if not b.bad:
                label, gap = state[b.inside]
                state[b.inside] = (first[i], 0) if first[i] != OPEN else (label, gap + len(b.text))
        return out

    before, after = decided(range(len(found))), decided(range(len(found) - 1, -1, -1))
    out = []
    for i, b in enumerate(found):
        (back, back_gap), (ahead, ahead_gap) = before[i], after[i]
        if first[i] != OPEN:
            out.append(first[i])
        elif b.tag in HEADINGS and ahead != OPEN:
            out.append(ahead)
        elif OPEN in (back, ahead):
            out.append(max(back, ahead))  # the one that is decided, if any
        else:
            out.append(back if back_gap <= ahead_gap else ahead)
    sure = any(x == GOOD for x in out)
    return [x == GOOD or (x == OPEN and (b.inside or not sure)) for x, b in zip(out, found, strict=True)]


def main_text(page: str | None) -> str:
    found, parents = blocks(page) if page else ([], [])
    return " ".join(b.text for b, keep in zip(found, labels(found, parents), strict=True) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, pages in slices(batches, "html"):
        texts = [main_text(x) for x in pages]
        keep = [n for n in part.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Replaces `html` by `text` and n_chars in each row; narrow."""
    source = pages.drop("text", "n_chars")
    kept = [f for f in source.schema.fields if f.name != "html"]
    return source.mapInArrow(_extracted, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
