"""Main text of web pages by consensus container paths per host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved, small
from .urls import url_host

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?/][^A-Za-z>][^>]*>|<!?(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([A-Za-z][^\s/>]*)[^>]*>|<[A-Za-z/!][^>]*\Z",
    re.S,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select menu dialog".split())
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | DROPPED | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption pre blockquote address figure figcaption hr fieldset details summary".split()
)
INLINE_DROPPED = frozenset("button select textarea svg".split())
# Words of a class, id or role that name something other than the article.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo sidebar aside menu nav navbar navigation breadcrumb"
    " breadcrumbs footer header masthead banner notice cookie cookies consent comment comments reply replies disqus share"
    " sharing social related newsletter subscribe popup modal widget login pagination pager toolbar contentinfo"
    " complementary search".split()
)
# First words of marks that say whether a side part is there, not what the element is.
ABOUT_WORDS = frozenset("has have with no not without is hide hides hidden show shows".split())
# A longer path of a container is written as its hash, so deep nesting costs no more than depth.
LONGEST_PATH = 1000
MAIN_WORDS = frozenset("article content post entry story main body text".split())


@dataclass
class Element:
    tag: str
    path: str
    dropped: bool
    container: int  # index of the nearest container, itself if it is one
    side: int = -1  # nearest element dropped for its side words, itself if it is one; -2 inside other dropped ones
    within: bool = False  # whether it is or stands in an article or main


@dataclass
class Page:
    """Containers (path and bonus, parent) and kept blocks (container, text, characters in links)."""

    paths: list[str] = field(default_factory=list)
    bonus: list[float] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


@dataclass
class Side:
    """Element with side words: characters of text and of links in it, and whether it holds an article.
    Only an element that is not inline may turn out to hold the main text, ``within`` says whether
    it stands in an article or main itself."""

    parent: int
    inline: bool
    within: bool
    text: int = 0
    links: int = 0
    article: bool = False


def _marks(attributes: str) -> tuple[str, set[str], set[str]]:
    """Generalised class (first mark, digits as 0), all words of class, id and role, and those of
    marks that name the element itself (not has-comments, no-sidebar)."""
    found = [m.strip("\"'").lower() for m in MARKS.findall(attributes)] if "=" in attributes else []
    marks = [[w for w in re.split(r"[_-]+", mark) if w] for m in found for mark in m.split()]
    words = {w for mark in marks for w in mark}
    naming = {w for mark in marks if mark and mark[0] not in ABOUT_WORDS for w in mark}
    return re.sub(r"\d+", "0", found[0].split()[0]) if found and found[0].split() else "", words, naming


def misnamed(sides: list[Side], kept_text: int, article_outside: bool) -> frozenset[int]:
    """Dropped elements with side words that hold the page's main text, from the outside in.

    That is over three quarters of the text (nine tenths if they are part of an article or main), or
    the only article or main element, and not mostly links. The side elements in such an element
    are judged in turn: their sizes are summed up once, so nesting costs nothing more.
    """
    text, links, article = ([getattr(side, name) for side in sides] for name in ("text", "links", "article"))
    inside: list[list[int]] = [[] for _ in sides]
    outermost = []
    for i in range(len(sides) - 1, -1, -1):
        outer = sides[i].parent
        if outer >= 0:
            text[outer], links[outer] = text[outer] + text[i], links[outer] + links[i]
            article[outer] |= article[i]
        (inside[outer] if outer >= 0 else outermost).append(i)
    total = kept_text + sum(text[i] for i in outermost)
    kept = set()
    while outermost:
        chosen = [
            i
            for i in outermost
            if text[i] > (0.9 if sides[i].within else 0.75) * total or article[i] and not article_outside
            if not sides[i].inline and text[i] and 2 * links[i] < text[i]
        ]
        kept.update(chosen)
        article_outside |= any(sides[i].article for i in chosen)
        outermost = [j for i in chosen for j in inside[i]]
    return frozenset(kept)


def read_page(source: str) -> Page:
    """Blocks of a page outside boilerplate elements, with the container each stands in.

    Elements with side words are dropped, unless they turn out to hold the main text (misnamed);
    then the page is read a second time with those kept.
    """
    page, sides, article = _read(source, frozenset())
    kept = misnamed(sides, sum(len(text) for _, text, _ in page.blocks), article)
    return _read(source, kept)[0] if kept else page


def _read(source: str, kept: frozenset[int]) -> tuple[Page, list[Side], bool]:
    """Page, its elements with side words in order, and whether an article or main is outside them."""
    page, stack, pieces = Page(), [], []
    links, in_link = 0, False
    sides: list[Side] = []
    article = False

    def top() -> Element:
        return stack[-1] if stack else Element("", "", False, -1)

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text and not top().dropped:
            if not page.paths:
                page.paths.append("")
                page.bonus.append(0.0)
                page.parents.append(-1)
            page.blocks.append((max(top().container, 0), text, min(links, len(text))))
        links = 0

    def close(at: int) -> None:
        if any(element.tag in BLOCKS for element in stack[at:]):
            # Text before a dropped inline element belongs to the block around it.
            while len(stack) > at and stack[-1].tag not in BLOCKS:
                stack.pop()
            flush()
        del stack[at:]

    place, end = 0, len(source)
    while place < end:
        found = TOKEN.search(source, place)
        raw = source[place : found.start() if found else end]
        if raw and not top().dropped:
            text = entities.unescape(raw)
            pieces.append(text)
            links += len(text) if in_link else 0
        elif raw and top().side >= 0:
            size = len(" ".join(raw.split()))
            sides[top().side].text += size
            sides[top().side].links += size if in_link else 0
        if not found:
            break
        place = found.end()
        closing, tag, attributes = found[1] or found[4], found[2] or found[5], found[3] or ""
        if not tag or found[0].startswith("<!"):
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            pieces.append(" ")
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
            if at >= 0:
                close(at)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, place)
            place = stop.end() if stop else end
            if tag not in INLINE_DROPPED:
                flush()
            continue
        name, words, naming = _marks(attributes)
        side, dropped = top().side, tag in DROPPED
        if tag in ("main", "article"):
            article |= side == -1
            if side >= 0:
                sides[side].article = True
        if dropped:
            side = -2
        elif side != -2 and naming & SIDE_WORDS and tag not in ("html", "body", "main", "article", *VOID):
            sides.append(Side(side, tag not in BLOCKS and "-" not in tag, top().within))
            dropped = len(sides) - 1 not in kept
            side = len(sides) - 1 if dropped else side
        if tag not in BLOCKS and not dropped or tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or stack[i].tag in ends.get(tag, ()):
                    close(i)
                    break
                if stack[i].tag in CONTAINERS or stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
            flush()
        parent = top()
        path = f"{parent.path}>{tag}.{name}" if name else f"{parent.path}>{tag}"
        if len(path) > LONGEST_PATH:
            path = "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest()
        container = parent.container
        if tag in CONTAINERS:
            container = len(page.paths)
            page.paths.append(path)
            page.parents.append(parent.container)
            page.bonus.append(0.3 if tag == "article" else 0.2 if tag == "main" else 0.15 if words & MAIN_WORDS else 0.0)
        within = parent.within or tag in ("article", "main")
        stack.append(Element(tag, path, parent.dropped or dropped, container, side, within))
    flush()
    return page, sides, article


def container_scores(page: Page) -> dict[str, float]:
    """Score of every path that holds a quarter of the page's text: its share, and a bonus for
    names and depth; characters in links count against it."""
    inside = [0.0] * len(page.paths)
    for container, text, links in page.blocks:
        inside[container] += max(0, len(text) - 2 * links)
    total = sum(inside) or 1.0
    for i in range(len(inside) - 1, -1, -1):
        if page.parents[i] >= 0:
            inside[page.parents[i]] += inside[i]
    largest: dict[str, tuple[float, float]] = {}
    for path, held, bonus in zip(page.paths, inside, page.bonus, strict=True):
        largest[path] = max(largest.get(path, (0.0, 0.0)), (held / total, bonus))
    return {
        path: share + bonus + 0.01 * path.count(">") for path, (share, bonus) in largest.items() if share >= 0.25
    }


def main_text(page: Page, path: str | None) -> str:
    """Blocks inside containers of ``path``, or of the page's own best path where it has none."""
    if path is None or path not in page.paths:
        scores = container_scores(page)
        path = min(scores, key=lambda p: (-scores[p], p)) if scores else None
    chosen = [False] * len(page.paths)
    for i, own in enumerate(page.paths):
        chosen[i] = own == path or page.parents[i] >= 0 and chosen[page.parents[i]]
    return "\n\n".join(text for container, text, _ in page.blocks if path is None or chosen[container])


def consensus_paths(pages: DataFrame) -> DataFrame:
    """Winning container path of every host (host, path, votes); ``pages`` has host and html.

    Every page gives each of its container paths its score as votes, in thousandths; votes are
    summed per batch before the shuffle, then per host and path in Spark.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = defaultdict(int)
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, score in container_scores(read_page(source or "")).items():
                    votes[host, path] += round(1000 * score)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in votes], pa.string()),
                    pa.array([p for _, p in votes], pa.string()),
                    pa.array(list(votes.values()), pa.int64()),
                ],
                ["host", "path", "votes"],
            )

    counted = pages.select("host", "html").mapInArrow(vote, "host string, path string, votes long")
    counted = counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = F.max_by(F.struct("path", "votes"), F.struct("votes", "path")).alias("best")
    return counted.groupBy("host").agg(best).select("host", "best.path", "best.votes")


def extract_main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, container.

    1. Every page scores its containers (elements by their path of tags and generalised classes)
       by the text they hold outside boilerplate elements and links.
    2. Spark sums these votes per host and path; the path with most votes is the host's.
    3. Every page is read again with its host's path; a page without that path uses its own best.

    Blocks are joined by two line feeds, white space in a block is one space, character
    references are decoded. Elements whose class, id or role names a side part are dropped unless they hold
    three quarters of the page's text, or its only article, and are not mostly links. Null html gives '' and 0; null urls and urls without host share the
    host ''. Unclosed and cut-off markup ends with the page. Repeated rows stay repeated, an
    empty table stays empty, other columns are ignored. The winners are broadcast only if their
    counted rows are proven small; otherwise the join shuffles.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), url_host(F.col(url)).alias("host"), F.col(html).alias("html")
    )
    winners = saved(consensus_paths(rows).select("host", "path"))
    joined = rows.join(small(winners, winners.count(), 500), "host", "left").select("page_id", "url", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(read_page(source or ""), path)
                for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column(3)],
                ["page_id", "url", "text", "n_chars", "container"],
            )

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, container string"
    )
