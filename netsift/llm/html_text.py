"""Main text of HTML pages by two-pass block rules (operator 8).

The page is cut into blocks at block-level tags. First pass: a block is bad in
a container that is no article (menu, footer, sidebar, form, advert, notice,
comments, by tag or by the words of its class, id and role) or when links hold
most of it; good when it is long enough and dense in stop words; otherwise
ambiguous. Second pass: ambiguous blocks take the label of the nearest decided
neighbour on either side, good when the two are equally near and differ.
Where the page marks an article, blocks outside it are bad and the neighbours
are those inside it; an article without decided blocks is good.

Stop words can't tell in other scripts than Latin, nor on a page without any
block dense in them: there a block of enough words is good; in scripts without
spaces two characters count as a word.

A class or id name is a hint when, without structural words at its end, it ends
in a hint word ('site-footer', 'comment-body'); names that negate, say how a
page is laid out, or file a post ('no-sidebar', 'has-menu', 'tag-search') say
nothing. A name never speaks against ``main``. On a page without a marked article
it doesn't speak against a wrapper either: an element that holds most of the
page's text outside links and a ``main``, ``article`` or ``h1``; on a page that
has no text otherwise, any heading or several containers will do, and a hinted
article counts. Comment sections and blocks that hold plain text alone (a long
notice, a sidebar, an advert) stay out whatever their share of the page.

Null and empty html, and pages without a good block: empty text. Broken markup
is read as far as it goes: unclosed elements end with their container. Every
input row gives one output row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from netsift.llm.common import narrow

# Frequent function words of the languages served.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can could did do for from had has have he her his i if in into is it its
like more most no not of on one only or other our out she so some than that the their them then there these they this to up was
we were what when which who will with would you your
au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on
ou outre par pas plus pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous
aber als am an auch auf aus bei bin bis bist da damit das dass dein den der des die dies doch du durch ein eine einem einen
einer eines er es für gegen hat hatte ich ihr im in ist ja kein können man mein mit nach nicht noch nur oder ohne sein sich sie
sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
al algo ante con como cuando del desde donde durante el ella ellos en entre era es esa ese eso esta este esto fue ha hasta la
las lo los mas más me mi muy ni no nos o otra para pero por porque que se ser si sin sobre son su sus también te tiene todo un
una y ya yo
""".split())

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody
td tfoot th thead title tr ul""".split())
CONTAINERS = frozenset("""article aside body center details dialog div dl fieldset figure footer form head header hgroup html li main
menu nav ol section table td tr ul span""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article, whatever stands inside.
STRONG_TAGS = frozenset("nav footer aside form head menu dialog".split())
STRONG_HINTS = frozenset("""comment comments commentlist reply replies respond disqus discussion nav navbar navigation menu breadcrumb
breadcrumbs footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored""".split())
WEAK_HINTS = frozenset("""aside banner promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay side
header masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription login signup
signin search widget widgets pagination pager legal copyright disclaimer tags tagcloud skip paywall hidden""".split())
COMMENT_HINTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that may follow the hint in a name.
ENDINGS = frozenset("""area bar block body bottom box button buttons card column container content dropdown element entry fixed form
frame group holder icons info inner item items law left link links list main media message outer page panel post posts primary respond
right row secondary section slot sticky text thread top unit wrap wrapper""".split())
#: Names with one of these tell what a page is like, not what an element holds.
LAYOUT_WORDS = frozenset("""closed collapsed disabled enabled expanded free has layout no non none not open overflow responsive with
without""".split())
FILED = re.compile(r"(?:post[-_])?(?:tag|category|cat|term|topic|taxonomy|type|format|status)[-_]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|select|button|textarea|object|canvas|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HINT_WORD = re.compile(r"[a-z]+")
#: Chinese, Japanese, Thai, Lao, Burmese and Khmer are written without spaces.
UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                      "\uff66-\uff9f\U00020000-\U0003ffff]")
LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
LETTERS = re.compile(r"[^\W\d_]+")

#: WEAK, STRONG and COMMENT come from names, TOP from ``header``, HARD from other tags, roles and hidden elements.
PLAIN, MAIN, TOP, WEAK, STRONG, COMMENT, HARD = range(7)
GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass(frozen=True)
class BlockRules:
    min_words: int = 8
    stop_density: float = 0.12
    link_density: float = 0.45
    #: A longer block than this without stop words is bad outside a marked article.
    long_words: int = 25


@dataclass
class Block:
    text: str
    link_chars: int
    place: int
    heading: bool
    label: str = field(default=OPEN)


@dataclass
class Hinted:
    """An element that names alone keep out of the text: its number on the page, tag, place, and characters outside links.

    Inside it: ``main``, ``article`` and ``h1`` elements; headings; containers.
    """

    number: int
    tag: str
    place: int
    chars: int
    marks: int = 0
    headings: int = 0
    containers: int = 0


def hints_of(value: str) -> set[str]:
    """The hint words of class or id names."""
    out: set[str] = set()
    for name in value.split():
        words = HINT_WORD.findall(name)
        if FILED.match(name) or not LAYOUT_WORDS.isdisjoint(words):
            continue
        while len(words) > 1 and (words[-1] in ENDINGS or len(words[-1]) == 1):
            words.pop()
        out.update(words[-1:])
    return out


def place_of(tag: str, attributes: str, outer: int, names: bool = True) -> int:
    """What an element says about its content, given what surrounds it; ``names``: by its class and id names too."""
    words: set[str] = set()
    roles: set[str] = set()
    hidden = main = False
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                roles.update(HINT_WORD.findall(value))
                main |= value == "main"
            elif name in ("class", "id"):
                words |= hints_of(value)
            elif name == "itemprop":
                main |= value == "articlebody"
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
            else:
                hidden |= name == "hidden" or value == "true"
    if tag in ("html", "body"):
        return PLAIN
    if outer == HARD or tag in STRONG_TAGS or hidden or roles & STRONG_HINTS:
        return HARD
    if tag == "main" or main or tag == "article" and not names:
        return MAIN
    if names:
        words |= roles
        if outer == COMMENT or words & COMMENT_HINTS:
            return COMMENT
        if outer == STRONG or words & STRONG_HINTS:
            return STRONG
        if tag == "article":
            return WEAK if words & WEAK_HINTS else MAIN
    if names and words & WEAK_HINTS:
        return WEAK
    return TOP if tag == "header" and outer < TOP else outer


def blocks_of(page: str, over: frozenset[int] = frozenset()) -> tuple[list[Block], list[Hinted], int]:
    """(blocks, hinted elements, characters outside links); the names of the elements ``over`` don't count."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    hinted: list[Hinted] = []
    running: list[tuple[int, Hinted]] = []  # (its depth, element)
    seen = elements = 0
    parts: list[str] = []
    link_parts: list[str] = []
    linked = heading = False

    def add(raw: str) -> None:
        if raw:
            parts.append(raw)
            if linked:
                link_parts.append(raw)

    def close() -> None:
        nonlocal parts, link_parts, seen
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(html.unescape("".join(link_parts)).split())) if link_parts else 0
                out.append(Block(text, links, stack[-1][1], heading))
                seen += len(text) - links if stack[-1][1] != HARD else 0
            parts, link_parts = [], []

    def leave(depth: int) -> None:
        while running and running[-1][0] >= depth:
            element = running.pop()[1]
            element.chars += seen
        del stack[depth:]

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(2) or m.group(5))
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            linked = not closing
            continue
        if tag in BLOCK_TAGS:
            close()
            heading = tag in HEADINGS and not closing
            if closing:
                linked = False
            for _, element in running if heading else ():
                element.headings += 1
                element.marks += tag == "h1"
        if tag not in CONTAINERS or tag in VOID:
            continue
        attributes = m.group(4) or m.group(7) or ""
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(stack[j][1] != stack[k - 1][1] for j in range(k, len(stack))):
                        close()
                    leave(k)
                    break
        elif tag == "body":
            leave(1)
        elif not attributes.rstrip().endswith("/"):
            outer = stack[-1][1]
            for _, element in running:
                element.containers += 1
                element.marks += tag in ("main", "article")
            place = place_of(tag, attributes, outer, elements not in over)
            if place != outer:
                close()
            if place in (WEAK, STRONG, COMMENT) and (place != outer or tag == "article") and place != place_of(tag, attributes, outer, False):
                hinted.append(Hinted(elements, tag, place, -seen))
                running.append((len(stack), hinted[-1]))
            elements += 1
            stack.append((tag, place))
    add(page[at:])
    close()
    leave(1)
    return out, hinted, seen


def length_of(text: str) -> int:
    """Words between spaces that hold a letter; in scripts without spaces half the characters."""
    spaced = UNSPACED.sub(" ", text)
    return sum(LETTERS.search(w) is not None for w in spaced.split()) + (len(UNSPACED.findall(text)) + 1) // 2


def other_script(text: str) -> bool:
    """Most letters aren't Latin."""
    return not text.isascii() and 2 * len(LATIN.findall(text)) < sum(map(str.isalpha, text))


def first_pass(blocks: list[Block], rules: BlockRules) -> None:
    article = any(b.place == MAIN for b in blocks)
    long = []
    for b in blocks:
        words = LETTERS.findall(b.text.lower())
        stop = sum(w in STOP_WORDS for w in words)
        links = b.link_chars / len(b.text)
        if b.place >= STRONG or b.place == WEAK or b.place == TOP and not (article and b.heading) or article and b.place == PLAIN:
            b.label = BAD
        elif links > rules.link_density:
            b.label = BAD
        elif other_script(b.text):
            b.label = GOOD if length_of(b.text) >= rules.min_words else OPEN
        elif len(words) >= rules.min_words and stop >= rules.stop_density * len(words):
            b.label = GOOD
        else:
            if length_of(b.text) >= rules.min_words:
                long.append(b)
            if b.place != MAIN and len(words) >= rules.long_words and not stop:
                b.label = BAD
    if all(b.label != GOOD for b in blocks):
        for b in long:
            b.label = GOOD


def decided_neighbours(area: list[Block]) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """For each block (distance, label) of the nearest decided block before and after it."""
    n = len(area)
    before, after = [(n + 1, OPEN)] * n, [(n + 1, OPEN)] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        far, label = n + 1, OPEN
        for i in order:
            far += 1
            found[i] = (far, label)
            if area[i].label != OPEN:
                far, label = 0, area[i].label
    return list(zip(before, after))


def second_pass(blocks: list[Block]) -> None:
    """Open blocks look to both sides; in a marked article only at blocks inside it.

    Elsewhere a block with good blocks on both sides is good even beside an
    advert or another container inside the text.
    """
    article = any(b.place == MAIN for b in blocks)
    area = [b for b in blocks if b.place == MAIN or b.place == TOP and b.heading and b.label == OPEN] if article else blocks
    plain = [b for b in blocks if b.place == PLAIN]
    inside = {id(b) for b, (one, two) in zip(plain, decided_neighbours(plain)) if one[1] == two[1] == GOOD}
    labels = []
    for b, ((d1, l1), (d2, l2)) in zip(area, decided_neighbours(area)):
        if b.label != OPEN:
            near = b.label
        elif id(b) in inside:
            near = GOOD
        elif l1 == OPEN and l2 == OPEN:
            near = GOOD if article else BAD
        elif l1 == OPEN or l2 == OPEN:
            near = l2 if l1 == OPEN else l1
        elif b.heading:
            near = l2
        elif d1 == d2:
            near = GOOD if GOOD in (l1, l2) else BAD
        else:
            near = l1 if d1 < d2 else l2
        labels.append(near)
    for b, label in zip(area, labels):
        b.label = label


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    blocks, hinted, chars = blocks_of(page)
    most = [h for h in hinted if h.place != COMMENT and 2 * h.chars > chars]
    over = frozenset(h.number for h in most if h.marks) if all(b.place != MAIN for b in blocks) else frozenset()
    if over:
        blocks, hinted, chars = blocks_of(page, over)
    text = good_text(blocks, rules)
    if not text:
        more = frozenset(h.number for h in hinted if h.tag == "article" and h.place == WEAK
                         or h.place != COMMENT and 2 * h.chars > chars and (h.headings or h.containers > 1))
        text = good_text(blocks_of(page, over | more)[0], rules) if more else ""
    return text


def good_text(blocks: list[Block], rules: BlockRules) -> str:
    first_pass(blocks, rules)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == GOOD)


def extract_text(pages: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """(page_id, url, text, n_chars) for each row; no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [main_text(h, rules) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return narrow(pages, page_id=("page_id", "bigint"), url=("url", "string"), html=("html", "string")) \
        .mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
