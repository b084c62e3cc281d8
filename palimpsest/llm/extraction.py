"""Main text of pages: containers scored by page, tag-class paths voted on by host, text from the winners."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import stored, tidy
from .words import slices

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.DOTALL)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
# a name only begins where none goes on, so that a long run of letters is looked at once
_ATTRIBUTE = re.compile(r"(?<![-a-zA-Z0-9_:.])([a-zA-Z_:][-a-zA-Z0-9_:.]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text never belongs to an article.
DROPPED = frozenset("head nav header footer aside form script style noscript iframe template svg math object canvas audio video select option button input textarea title menu dialog label xmp noembed noframes".split())
#: Parts of a class, id or role (``page-footer`` has two) that mark what surrounds an article: as the whole of
#: it, its first part or its last.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter pager pagination popup promo promotion promoted replies respond sidebar signup skip sponsor sponsored "
    "sponsors subscribe subscription toolbar".split()
)
#: Parts that may be an article's own too: they mark as the whole or the last part, or before one of ``_FURNITURE``.
WEAK_MARKS = frozenset("alert aside notice notices notification notifications overlay recommended related search share sharing social toc widget widgets".split())
#: Words are also written together (``cookiebar``, ``sitefooter``): these begin or end a part that marks.
_BEGIN, _END = ("adsby", "advert", "breadcrumb", "cookie", "sponsor"), ("footer", "masthead", "menu", "navbar", "sidebar")
_WHOLE_MARKS = frozenset(["side", "foot"])
_FURNITURE = frozenset("area bar block box button buttons container form icons items left link links list message msg panel posts right section stories widget wrapper".split())
_BESIDE = re.compile(r"(?:has|with|no|without|is)[-_]", re.IGNORECASE)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPES = frozenset("table td th caption button object article section div li".split())
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")
_CLOSES_P = BLOCKS | {"hr"}
_SAME = {"li": ("li",), "option": ("option",), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements within a container rather than containers.
_INNER = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tbody thead tfoot tr td th dl dt dd figure figcaption address summary hr".split())
_SPACE = re.compile(r"[\s]+")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: What text counts in a container one level further out.
_OUTWARD = 0.8
#: Kinds of blocks.
PLAIN, HEADING, LINKS = 0, 1, 2


@lru_cache(maxsize=8192)
def mark_of(word: str) -> int:
    """2 where a word of a class, id or role surely marks what surrounds an article, 1 where it may, else 0.
    ``has-sidebar`` and the like tell what is beside an element, not what it is."""
    if _BESIDE.match(word):
        return 0
    parts = [p.rstrip("0123456789") for p in _PARTS.split(_CAMEL.sub("-", word.partition("--")[0]).lower().strip("-_"))]
    ends = (parts[0], parts[-1])
    if any(p in MARKS or p.startswith(_BEGIN) or p.endswith(_END) for p in ends):
        return 2
    weak = parts[-1] in WEAK_MARKS or (len(parts) == 1 and parts[0] in _WHOLE_MARKS) or (parts[0] in WEAK_MARKS and len(parts) > 1 and parts[1] in _FURNITURE)
    return 1 if weak else 0


def step_of(tag: str, attributes: str) -> tuple[str, int]:
    """``tag.class`` with digits as ``#``, and whether the element surrounds an article or is hidden: 2 surely,
    1 by a weak mark, 0 not."""
    return _step(tag, attributes) if len(attributes) < 256 else _step.__wrapped__(tag, attributes)


@lru_cache(maxsize=8192)
def _step(tag: str, attributes: str) -> tuple[str, int]:
    sure = 2 if tag in DROPPED else 0
    if not attributes:
        return tag, sure
    found: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), a or b or c)
    step = ".".join([tag, *sorted(_DIGITS.sub("#", m.lower()).replace(">", "_") for m in found.get("class", "").split())])
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true":
        sure = 2
    if sure or tag in ("html", "body", "main", "article"):
        return step, sure
    return step, max((mark_of(m) for k in ("class", "id", "role") for m in found.get(k, "").split()), default=0)


class Page:
    """Blocks of a page in order, and the containers they lie in.

    Containers are generalised paths: node ``i`` is the step ``steps[i]`` below ``parents[i]`` (node 0 is the
    page), and elements with one path are one node. Block ``i`` has text ``texts[i]``, lies in container
    ``nodes[i]`` and is of kind ``kinds[i]``; ``worth[i]`` is its length without link text.
    """

    def __init__(self, parents: list[int], steps: list[str], texts: list[str], nodes: list[int], kinds: list[int], worth: list[int] | None = None):
        self.parents, self.steps, self.texts, self.nodes, self.kinds, self.worth = parents, steps, texts, nodes, kinds, worth or []

    def best_path(self) -> str | None:
        """The path of the best container: it counts characters that aren't link text, in full for its own
        blocks and ``_OUTWARD`` of that for each level further in, so that a container wins over those around
        it if these add little. ``article`` and ``main`` count twice; of equal ones the longest path, then the first one wins.
        None without text."""
        if not self.texts:
            return None
        score, length = [0.0] * len(self.steps), [0] * len(self.steps)
        held = [False] * len(self.steps)
        for node, worth in zip(self.nodes, self.worth):
            score[node] += worth
            held[node] = True
        for node in range(len(self.steps) - 1, 0, -1):
            score[self.parents[node]] += _OUTWARD * score[node]
            held[self.parents[node]] |= held[node]
        best, top = None, (-1.0, -1)
        for node in range(1, len(self.steps)):
            length[node] = length[self.parents[node]] + len(self.steps[node]) + 1
            if held[node]:
                mine = (score[node] * (2.0 if self.steps[node].partition(".")[0] in ("article", "main") else 1.0), length[node])
                if mine > top:
                    best, top = node, mine
        spelled = []
        while best:
            spelled.append(self.steps[best])
            best = self.parents[best]
        return ">".join(reversed(spelled)) if spelled else None

    def under(self, path: str | None) -> list[str]:
        """Texts of the blocks under ``path`` (other steps may stand between its own). Where that is no ``article``
        or ``main``, what its parent holds of its own (unless that is the page's body) belongs to it, but for
        links, and headings further out."""
        steps = path.split(">") if path else []
        if not steps:
            return []
        whole = steps[-1].partition(".")[0] in ("article", "main")
        met, near, over = [0] * len(self.steps), set(), set()
        for node in range(1, len(self.steps)):
            parent = self.parents[node]
            k = met[parent]
            met[node] = k + (k < len(steps) and self.steps[node] == steps[k])
            if met[node] == len(steps) > k and not whole:  # a winner
                if self.steps[parent].partition(".")[0] not in ("", "html", "body"):
                    near.add(parent)
                while parent not in over:
                    over.add(parent)
                    if not parent:
                        break
                    parent = self.parents[parent]
        inside = [met[n] == len(steps) for n in self.nodes]
        if not any(inside):
            return []
        return [t for t, n, k, own in zip(self.texts, self.nodes, self.kinds, inside) if own or (k != LINKS and n in near) or (k == HEADING and n in over)]

    def text(self, path: str | None) -> str:
        """The text under ``path``; under the page's own best where it has none there, and all of its blocks
        where none lies in a container."""
        return "\n\n".join(self.under(path) or self.under(self.best_path()) or self.texts)


def read_page(page: str) -> Page:
    """The blocks of a page. Where nothing is left of its article but what a weak mark dropped, such marks
    are left out of account."""
    found, weak = _read(page, 1)
    return _read(page, 2)[0] if weak and not found.texts else found


def _read(page: str, least: int) -> tuple[Page, bool]:
    """Blocks without elements whose mark is ``least`` or more, and whether a weak mark dropped any within an
    article. Broken markup is read as browsers do in the main: end tags close up to their element, a block ends
    an open ``p``, what is left open ends with the page. Places of open elements are kept by tag, so that time
    grows with the page's length, however deep it is."""
    out = Page([0], [""], [], [], [], [])
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool]] = []  # tag (empty: closed before what it holds), container, dropped from here
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    scopes: list[int] = []
    text: list[str] = []
    dropped = links = linked = heading = 0
    weak_in_article = False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                worth = max(0, len(joined) - 2 * linked)
                out.texts.append(joined)
                out.nodes.append(stack[-1][1] if stack else 0)
                out.kinds.append(LINKS if linked and not worth else HEADING if heading else PLAIN)
                out.worth.append(worth)
            text.clear()
        linked = 0

    def push(tag: str, node: int, drop: bool) -> None:
        nonlocal dropped, links, heading
        at = len(stack)
        stack.append((tag, node, drop))
        places[tag].append(at)
        if tag in BLOCKS:
            blocks.append(at)
        if tag in _SCOPES:
            scopes.append(at)
        dropped += drop
        links += tag == "a"
        heading += tag in _HEADINGS

    def left(tag: str, drop: bool) -> None:
        nonlocal dropped, links, heading
        dropped -= drop
        links -= tag == "a"
        heading -= tag in _HEADINGS

    def cut(place: int) -> None:
        """Close all from ``place`` on."""
        while len(stack) > place:
            tag, _, drop = stack.pop()
            if tag:
                places[tag].pop()
                left(tag, drop)
        while blocks and blocks[-1] >= place:
            blocks.pop()
        while scopes and scopes[-1] >= place:
            scopes.pop()

    def last(tag: str) -> int:
        return places[tag][-1] if places[tag] else -1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            text.append(page[at:lt])
            if links:
                linked += lt - at
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if not m:  # not markup: "<" as text
            if not dropped:
                text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            end = page.find("-->", lt + 4 if page[lt + 4 : lt + 5] != ">" else lt + 2)
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        tag = m[4].lower()
        if m[3]:
            place = last(tag)
            if place < 0:
                if tag == "p":
                    flush()
                elif tag == "br":
                    text.append("\n")
            elif tag in BLOCKS or not blocks or blocks[-1] < place:
                if tag in BLOCKS:
                    flush()
                cut(place)
            else:  # an inline end tag does not close the blocks inside its element
                _, node, drop = stack[place]
                stack[place] = ("", node, False)
                places[tag].pop()
                if tag in _SCOPES:
                    del scopes[bisect_left(scopes, place)]
                left(tag, drop)
            continue
        if tag == "br":
            if not dropped:
                text.append("\n")
            continue
        if tag in _CLOSES_P and places["p"] and (not scopes or scopes[-1] < last("p")):
            flush()
            place = last("p")
            kept = [(t, drop) for t, _, drop in stack[place + 1 :] if t and t not in BLOCKS and (drop or t == "a")]  # links and hidden text go on
            cut(place)
            for t, drop in kept:
                push(t, stack[-1][1] if stack else 0, drop)
        if tag in _SAME:
            place = max(map(last, _SAME[tag]))
            outer = max(map(last, (*_LISTS, "tr") if tag in ("td", "th") else _LISTS))
            if place > outer:
                flush()
                cut(place)
        if tag in BLOCKS or tag == "hr":
            flush()
        if tag in _VOID or m[5].endswith("/") and tag not in BLOCKS:
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = n if end is None else end.end()
            continue
        step, mark = step_of(tag, m[5])
        drop = mark >= least
        if mark == 1 and (places["article"] or places["main"]):
            weak_in_article = True
        if drop and not dropped:
            flush()
        node = stack[-1][1] if stack else 0
        if tag in BLOCKS and tag not in _INNER and not dropped:
            if (node, step) not in known:
                known[node, step] = len(out.steps)
                out.parents.append(node)
                out.steps.append(step)
            node = known[node, step]
        push(tag, node, drop)
    flush()
    return out, weak_in_article


#: Hosts with more pages than this (or a hundred-thousandth of all, if that is more) get their path by a broadcast.
HEAVY = 100_000


@tidy
def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", heavy: int = HEAVY) -> DataFrame:
    """``id_col, url_col, text, n_chars`` of each row of ``pages``: the article's blocks, joined by an empty line.

    Each page is parsed once, to blocks and generalised tag-class paths of containers that are written to the
    shared folder, and votes for its best container's path. Votes are summed by host and path in Spark (partial
    sums first, so that a host with a third of all pages is no load), and each host's path with most votes wins.
    Each page then gives the blocks under its host's path, or, where it has nothing there, under its own best.

    Hosts with more than ``heavy`` pages, or a hundred-thousandth of all, are 100,000 at most: their paths are
    broadcast, so that no task gathers such a host; the rest are joined by host.

    Null and empty pages, and pages without text, give an empty text; a null url, or one without a host, shares
    the empty host. Very long and very deep pages take time in proportion to their length. Of paths with equal
    votes the longest wins, then the first in order. Repeated rows are each extracted, a null id stays null, an
    empty table gives no rows; other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 200)):
            read = [read_page(page or "") for page in batch.column(3).to_pylist()]
            made = [
                pa.array([p.best_path() for p in read], pa.string()), pa.array([p.parents for p in read], pa.list_(pa.int32())), pa.array([p.steps for p in read], pa.list_(pa.string())),
                pa.array([p.texts for p in read], pa.list_(pa.string())), pa.array([p.nodes for p in read], pa.list_(pa.int32())), pa.array([p.kinds for p in read], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["id", "url", "host", "own", "parents", "steps", "texts", "nodes", "kinds"])

    parsed = rows.select("id", "url", host.alias("host"), "html").mapInArrow(parse, f"id {kind}, url string, host string, own string, parents array<int>, steps array<string>, texts array<string>, nodes array<int>, kinds array<int>")
    parsed = stored(parsed, "pages")
    votes = parsed.groupBy("host", "own").agg(F.count("*").alias("votes"))
    by_host = Window.partitionBy("host")
    ranked = votes.withColumns({"n": F.sum("votes").over(by_host), "k": F.row_number().over(by_host.orderBy(F.col("own").isNull(), F.desc("votes"), F.length("own").desc(), "own"))})
    winners = stored(ranked.where("k = 1 and own is not null").select("host", F.col("own").alias("path"), "n"), "paths")
    bound = max(heavy, (winners.agg(F.sum("n")).first()[0] or 0) // 100_000)
    few = winners.where(F.col("n") > bound).select("host", F.col("path").alias("heavy_path"))
    known = parsed.join(F.broadcast(few), "host", "left")
    # pages that have their path already stand under keys that no winner has, many of them
    known = known.withColumn("key", F.when(F.col("heavy_path").isNull(), F.concat(F.lit("h"), "host")).otherwise(F.concat(F.lit("d"), F.pmod(F.xxhash64("id", "url"), F.lit(100_000)).cast("string"))))
    light = winners.where(F.col("n") <= bound).select(F.concat(F.lit("h"), "host").alias("key"), "path")
    joined = known.join(light, "key", "left").withColumn("path", F.coalesce("heavy_path", "path", "own"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 200)):
            texts = []
            for own, path, *page in zip(*(c.to_pylist() for c in batch.columns[2:])):
                found = Page(*page)
                texts.append("\n\n".join(found.under(path) or (found.under(own) if own != path else []) or found.texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = joined.select("id", "url", "own", "path", "parents", "steps", "texts", "nodes", "kinds").mapInArrow(extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
