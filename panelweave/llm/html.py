"""Main text of web pages by equivalence-class template deduction.

A page is scanned once, forwards, into elements and blocks of text. The tokens of a host's pages are the start and end
tags of elements, told apart by their paths (names and classes down from the root), and the texts of blocks under their
paths. Over the pages of one host, tokens with the same occurrence vector (how often each page has them) form an
equivalence class. A vector is never gathered: its sum, its number of pages and a hash-weighted sum identify it, so
classes come from one grouped aggregate. A class is valid where an element's start and end tags share a vector, that is
where it nests. A text belongs to the template where its class nests in the class of an element around it: it then
stands there once for each time that the element does, on every page that has it, however many layouts a host has. Pages
must differ for that (equal pages count as one); two are enough for an element of its own, three for headings (two may
share a title) and for elements further up, and ``LEAST_INSIDE`` within articles. All other blocks are the slots of the
template, and what they hold is extracted.

Furniture goes whatever the template says: elements made for it (nav, header, footer, aside, form and such) and elements
whose class, role or id names an advert, a menu, comments and the like, with all that is in them. A name counts if what
follows the word in it only says what kind of box it is (menu-list, but not search-results). An element that holds
the article is no furniture. Words that may also be a topic (share, related, notice; within an article also menu, login,
search and others) are not enough by themselves: such an element's text goes only if it is the template's, or mostly
links; the same holds for headings and paragraphs within an article, whatever they are called. Where a page has article or main elements, blocks
in any of them stay, template or not, and outside them only headings and paragraphs that are not the template's; where
it has none, all blocks stay that are not the template's.

Defined cases: null or empty html gives an empty text; markup cut off anywhere counts as closed at its end, and a quote
whose value would end a tag and begin another does not begin one; a host with one page has no template; repeated rows are extracted each; a null or
relative URL belongs to the empty host; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import written
from panelweave.llm.urls import url_host

LEAST_INSIDE = 10  # pages whose articles all have a text, for the template to claim it
BROADCAST_TEXTS = 500_000  # template texts that a broadcast may hold, as numbers: 8 MB

#: Fixed values of HTML: elements inside a line of text, without an end, whose content is no markup, and of prose.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea template title svg iframe".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
_OWN_ENDS = frozenset("li dt dd tr td th option".split())
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
#: Elements that are furniture; words in a class, role or id that mark it, in an article too or only
#: outside of one; words that may; and words for a box, which may follow them.
FURNITURE = frozenset("nav header footer aside form menu dialog button select option head".split())
ALWAYS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe signup comment comments disqus sidebar breadcrumb breadcrumbs".split()
)
STRONG = ALWAYS | frozenset("banner promo nav navbar navigation menu masthead footer toolbar popup modal complementary contentinfo search login".split())
WEAK = frozenset("share sharing social related recommended notice notices alert header aside widget widgets reply replies respond discussion promotion".split())
BOXES = frozenset("bar block body bottom box button buttons container content entry area footer form group header inner item items label left link links list main notice outer panel right row section slot text thread title top unit widget wrap wrapper".split())
#: Ids that hold what readers wrote.
READERS = frozenset("comment comments disqus replies respond".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Element:
    """A block-level element: whether it is furniture by itself, may be by its words, and what it holds."""

    name: str
    path: int
    parent: int
    off: bool
    weak: bool
    named: bool  # furniture by its words or as a form, which an article in it overrides
    content: bool
    prose: bool
    depth: int
    holds: bool = False


@dataclass(slots=True)
class Block:
    text: str
    at: int  # the element that it stands in
    linked: int  # characters of it within links


def marks(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, whether an end tag) of the tags of a page; comments and declarations have no name.

    Each character is passed a bounded number of times: a search that found nothing is not made again.
    """
    at, size, missing = 0, len(page), set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while True:
        start = page.find("<", at)
        if start < 0 or start + 1 >= size:
            return
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", False
            continue
        if page[start + 1] in "!?":
            end = find(">", start)
            at = size if end < 0 else end + 1
            yield start, at, "", "", False
            continue
        closes = page[start + 1] == "/"
        name = _NAME.match(page, start + 1 + closes)
        if not name:
            at = start + 1
            continue
        at = name.end()
        while True:
            if find(">", at) < 0:
                at = end = size
                break
            stop = _STOP.search(page, at)
            if stop[0] == ">":
                end, at = stop.start(), stop.end()
                break
            shut = find(stop[0], stop.end())
            if shut >= 0 and 0 <= (past := page.find(">", stop.end(), shut)) and page.find("<", stop.end(), past) < 0 <= page.find("<", past, shut):
                shut = -1  # the tag ends and others begin before the next such quote
            at = stop.end() if shut < 0 else shut + 1
        lower, attributes = name[0].lower(), page[name.end() : end]
        yield start, at, lower, attributes, closes
        if lower in RAW and not closes and not attributes.endswith("/"):
            # What follows is no markup up to the end tag of the same name.
            shut = None if lower in missing else _RAW_END[lower].search(page, at)
            if shut is None:
                missing.add(lower)
            at = shut.start() if shut else size


def _marked(words: list[str], marks: frozenset[str]) -> set[str]:
    """The words of a name that mark it, if only words for a box follow the last of them."""
    at = [i for i, w in enumerate(words) if w in marks]
    return {words[i] for i in at} if at and BOXES.issuperset(words[at[-1] + 1 :]) else set()


def labels(name: str, attributes: str) -> tuple[str, set[str], bool]:
    """(the label in a path, the words of STRONG that count, whether a weak one does) of a start tag's class, role and id."""
    first, strong, weak = "", set(), False
    for kind, *values in _LABEL.findall(attributes) if attributes else ():
        names = "".join(values).lower().split()
        words = [[w for w in _PART.split(n) if w] for n in names]
        if kind.lower() == "class" and names:
            first = first or _DIGITS.sub("", names[0])
        if kind.lower() == "id" or name in PROSE:
            # An id is often a topic, and so is a paragraph's class: there only a whole name counts, or what readers wrote.
            strong |= STRONG.intersection(names)
            if name not in PROSE:
                strong |= {"comments" for w in words if READERS.intersection(w[-1:])}
        else:
            strong |= {x for w in words for x in _marked(w, STRONG)}
            weak = weak or any(not WEAK.isdisjoint(w) for w in words) or (not strong and any(not STRONG.isdisjoint(w) for w in words))
    return f"{name}.{first}" if first else name, strong, weak


def scan(page: str) -> tuple[list[Element], list[Block]]:
    """The block-level elements of a page, parents first, and its blocks of text."""
    elements = [Element("", 0, 0, False, False, False, False, False, 0)]
    blocks: list[Block] = []
    stack, opened = [0], Counter()
    parts: list[str] = []
    linked = links = 0  # characters within links, and links that are open
    hidden: tuple[str, int, int] | None = None  # an inline advert: its name, how deep it nests, and its block

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack[-1], linked))
            parts, linked = [], 0

    def close(depth: int) -> None:
        nonlocal hidden, links
        flush()
        while len(stack) > depth:
            opened[elements[stack.pop()].name] -= 1
        if hidden and hidden[2] >= depth:
            hidden = None
        links = 0

    def text(some: str) -> None:
        nonlocal linked
        if hidden is None and some:
            parts.append(some)
            linked += len(some) if links else 0

    at, skip = 0, None
    for start, end, name, attributes, closes in marks(page):
        if skip is not None:  # in an element whose content is no markup
            if closes and name == skip:
                skip, at = None, end
            continue
        text(page[at:start])
        at = end
        if not name:
            continue
        if name in RAW:
            if not closes and not attributes.endswith("/"):
                skip = name
        elif name == "br":
            text(" ")
        elif name in INLINE:
            if hidden and name == hidden[0]:
                depth = hidden[1] + (-1 if closes else 1)
                hidden = (name, depth, hidden[2]) if depth else None
            elif hidden is None and not closes and attributes and name not in VOID and labels(name, attributes)[1]:
                hidden = (name, 1, len(stack))
            if name == "a":
                links = 0 if closes else 1
        elif closes:
            if opened[name] > 0:
                depth = len(stack) - 1
                while elements[stack[depth]].name != name:
                    depth -= 1
                close(depth)
        else:
            flush()
            top = elements[stack[-1]]
            if top.name == "p" or (name == top.name and name in _OWN_ENDS):
                close(len(stack) - 1)
            above = elements[stack[-1]]
            label, strong, weak = labels(name, attributes)
            plain = name not in ("html", "body")
            inside = above.content or name in CONTENT
            made = name in FURNITURE and not (name == "header" and above.content)
            # Within an article fewer words are enough, and none for its headings and paragraphs.
            sure = bool(strong) and not (above.content and (name in PROSE or ALWAYS.isdisjoint(strong)))
            off = made or (sure and plain)
            element = Element(name, xxhash.xxh3_64_intdigest(label, above.path) >> 1, stack[-1], off, (weak or bool(strong)) and not off and plain, (sure and not made) or name == "form", inside, name in PROSE, len(stack))
            if name in CONTENT and not off:
                up = stack[-1]
                while up and not elements[up].holds:
                    elements[up].holds = True
                    up = elements[up].parent
            if name not in VOID and not (attributes.endswith("/") and name not in CONTENT):
                elements.append(element)
                stack.append(len(elements) - 1)
                opened[name] += 1
    if skip is None:
        text(page[at:])
    flush()
    for element in elements[1:]:
        above = elements[element.parent]
        element.off = above.off or (element.off and not (element.named and element.holds))
        element.weak = (element.weak and not element.holds) or above.weak
        element.content = element.content and not element.off
        element.prose = element.prose or above.prose
    return elements, blocks


def text_key(element: Element, block: Block) -> int:
    """A block's text under its path, as a number."""
    return xxhash.xxh3_64_intdigest(block.text, element.path) >> 1


def doubtful(element: Element) -> bool:
    """Whether the template decides on blocks in this element."""
    return not element.off and (element.weak or not element.content)


def tokens(page: str) -> Counter:
    """(path, text or 0, whether an end tag) -> how often a page has it, for the blocks that are no furniture."""
    return page_tokens(page)[0]


def page_tokens(page: str) -> tuple[Counter, dict[int, tuple[bool, bool, tuple[int, ...]]]]:
    """The tokens of a page; and for the paths of its blocks whether they are headings, and surely of an article, and the
    paths of the elements around them."""
    elements, blocks = scan(page)
    found: Counter = Counter()
    about: dict[int, tuple[bool, bool, tuple[int, ...]]] = {}
    wanted = set()
    for block in blocks:
        element = elements[block.at]
        if element.off:
            continue
        found[element.path, text_key(element, block), False] += 1
        if element.path not in about:
            around, at = [], block.at
            while at:
                at = elements[at].parent
                around.append(elements[at].path)
            about[element.path] = (element.name in HEADINGS, not doubtful(element), tuple(around))
            wanted.update(around)
    wanted.update(about)
    for element in elements:
        if element.path in wanted:
            found[element.path, 0, False] += 1
            found[element.path, 0, True] += 1
    return found, about


def main_text(page: str, template: frozenset[int] | set[int]) -> str:
    """The blocks of a page that are neither furniture nor the template's, one a line."""
    elements, blocks = scan(page)
    article = any(e.name in CONTENT and not e.off for e in elements)
    kept = []
    for block in blocks:
        element = elements[block.at]
        if element.off or text_key(element, block) in template:
            continue
        if element.weak and 2 * block.linked >= len(block.text):
            continue
        if not element.content and article and not element.prose:
            continue
        kept.append(block.text)
    return "\n".join(kept)


def templates(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """host, text: the texts that belong to the hosts' templates, as numbers of paths and texts."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, weight, page in zip(batch["_host"], batch["_weight"], batch["_html"]):
                found, about = page_tokens(page or "")
                for (path, text, end), n in found.items():
                    out.append((host, path, text, end, n, weight, *(about[path] if text else (None, None, None))))
            yield pd.DataFrame(out, columns=["host", "path", "text", "is_end", "n", "weight", "heading", "inside", "around"])

    # A page's weight in the vectors' identity; small enough that sums stay far from overflow in 128-bit decimals.
    # Equal pages have one weight, so that they don't pass for pages that differ.
    weight = F.xxhash64(F.col(html_col)).alias("_weight")
    rows = pages.select(url_host(F.col(url_col)).alias("_host"), weight, F.col(html_col).alias("_html"))
    found = rows.mapInPandas(seen, "host string, path long, text long, is_end boolean, n int, weight long, heading boolean, inside boolean, around array<long>")
    vector = F.struct(F.sum(F.col("n") * F.col("weight").cast("decimal(38,0)")).alias("weighted"), F.sum("n").alias("n"), F.count("*").alias("pages"))
    more = [(F.min("weight") < F.max("weight")).alias("differ"), F.max("heading").alias("heading"), F.min("inside").alias("inside"), F.first("around").alias("around")]
    classes = written(found.groupBy("host", "path", "text", "is_end").agg(vector.alias("vector"), *more), "classes")
    # An element is valid where its start and end tags are of one class; both tags of a path share its join keys.
    tags = classes.where("text = 0").groupBy("host", "path").agg(F.min("vector").alias("vector"), F.max("vector").alias("_other")).where("vector = _other")
    texts = classes.where("text <> 0 and differ").select("host", "path", "text", "vector", "heading", "inside", "around")
    # A class is its host and vector, by which its elements and texts meet; few of a host's texts share an element's.
    of = tags.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("vector").alias("_vector"))
    nested = texts.join(of, (F.col("host") == F.col("_host")) & (F.col("vector") == F.col("_vector")))
    own = F.col("path") == F.col("_path")
    enough = F.when(F.col("inside"), F.lit(LEAST_INSIDE)).when(own & ~F.col("heading"), F.lit(2)).otherwise(F.lit(3))
    return nested.where((own | F.array_contains("around", F.col("_path"))) & (F.col("vector.pages") >= enough)).select("host", "text").distinct()


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """One row per page: id, url and its main text.

    The template texts are written and counted; up to ``BROADCAST_TEXTS`` go to every task and no page is shuffled.
    Beyond that pages and their hosts' texts meet by host and salt; a host has as many as its layouts have blocks.
    """
    found = written(templates(pages, id_col, url_col, html_col), "template")
    small = found.count() <= BROADCAST_TEXTS
    listed = found.groupBy(F.col("host").alias("_of")).agg(F.collect_set("text").alias("_template"))
    if not small:
        listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), url_host(F.col(url_col)).alias("_host"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("_at"))
    joined = salted.join(F.broadcast(listed), F.col("_host") == F.col("_of"), "left") if small else salted.join(listed, (F.col("_host") == F.col("_of")) & (F.col("_at") == F.col("_salt")), "left")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page or "", set() if template is None else set(template.tolist())) for page, template in zip(batch["_html"], batch["_template"])]
            yield pd.DataFrame({id_col: batch["_id"], url_col: batch["_url"], "text": texts})

    kinds = [(id_col, pages.schema[id_col].dataType), (url_col, pages.schema[url_col].dataType), ("text", T.StringType())]
    return joined.select("_id", "_url", "_html", "_template").mapInPandas(extract, T.StructType([T.StructField(name, kind) for name, kind in kinds]))


def extract_digest(pages: DataFrame) -> DataFrame:
    """The contract of op10."""
    return extract_pages(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
