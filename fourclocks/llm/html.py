"""Main text of web pages by consensus host paths.

A page's containers are scored by the text they hold; the generalised tag-class paths of the good ones are votes, which
Spark counts per host. Every page is then read again at its host's winning path, whatever its own scores were.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourclocks.llm.common import keep, whole_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select button title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
_NAMED = frozenset(["article", "main"])
CONTAINERS = frozenset("article main section div td body center blockquote".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
OUT_TAGS = frozenset("nav header footer aside form head dialog menu".split())
#: Words of class and id names, and roles, that mark what is not the article.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices "
    "menu nav navbar navigation breadcrumb breadcrumbs header footer sidebar aside widget comment comments discussion reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal toolbar pagination pager".split()
)
#: Words that say how such a part is laid out. A name marks a part if it consists of these and the words above, so that
#: ``share-buttons`` does and ``share-price`` does not.
PLAIN_NAMES = frozenset(
    "area bar block bottom box btn button buttons center col column columns container content fixed global holder icon icons inner item "
    "items left link links list main middle module outer page panel post posts primary right row secondary section side site slot small "
    "sticky strip text top unit widgets wrap wrapper zone".split()
)
#: Words that inside an article may well name a part of it.
OUTSIDE_ONLY = frozenset(["discussion"])
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)", re.I)
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_P = frozenset(["p"])
_END = re.compile(r"""[>]|=\s*(["'])""")
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})\b", re.I)
#: Raw tags that cannot hold themselves: a second one shows that the first was never closed.
_FLAT = frozenset("button select textarea".split())
#: The share of a page's text from which a container's name does not make it unwanted.
_MOST = 0.9
#: The share from which an article or main outweighs all that is beside it.
_SOME = 0.25


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, past quoted values; -1 where the page ends first."""
    while True:
        m = _END.search(page, at)
        if m is None or m[1] is None:
            return -1 if m is None else m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return -1


class Node:
    """An element. ``hard`` marks what is not the article whatever its name; ``mark`` is the number of the innermost tag around
    it whose name says so (0: none). Its blocks are ``lo`` to ``hi`` of the page's, the tags inside it ``number`` to ``last``.
    ``owner`` is the nearest container, ``whole`` the outermost article or main, ``key`` stands for the path."""

    __slots__ = ("tag", "step", "key", "parent", "hard", "mark", "score", "lo", "hi", "number", "last", "owner", "whole", "inside")

    def __init__(self, tag: str, step: str, parent: "Node | None", hard: bool, mark: int, number: int, lo: int) -> None:
        self.tag, self.step, self.parent, self.hard, self.mark, self.number, self.lo = tag, step, parent, hard, mark, number, lo
        self.score, self.hi, self.last = 0.0, lo, number
        fine = not hard and not mark
        self.key = 0 if parent is None else _child(parent.key, step) if fine else parent.key
        self.owner = self if parent is None or fine and tag in CONTAINERS else parent.owner
        self.whole = parent.whole if parent is not None and parent.whole is not None else self if fine and tag in _NAMED else None
        self.inside = parent is not None and parent.inside or tag in _NAMED

    def path(self) -> str:
        steps, at = [], self
        while at is not None:
            steps.append(at.step)
            at = at.parent
        return "".join(reversed(steps))


class Page:
    """The containers of a page in page order, the root first, and its blocks of text without unwanted parts."""

    def __init__(self, found: list[Node], blocks: list[str]) -> None:
        self.found, self.blocks = found, blocks
        self.sums = [0, *accumulate(map(len, blocks))]

    def size(self, node: Node) -> int:
        return self.sums[node.hi] - self.sums[node.lo]

    def text(self, nodes: list[Node]) -> str:
        return " ".join(b for n in nodes for b in self.blocks[n.lo : n.hi])


@lru_cache(maxsize=200_000)
def _child(key: int, step: str) -> int:
    """The number that stands for a path, from that of the path above and a step: the same in every process."""
    return int.from_bytes(hashlib.blake2b(f"{key} {step}".encode(), digest_size=8).digest(), "little")


def key_of(path: str) -> int:
    key = 0
    for step in path.split(">")[1:]:
        key = _child(key, f">{step}")
    return key


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open', tag, attributes) and ('close', tag, ''), in one pass without backtracking."""
    at, size, torn = 0, len(page), False
    unclosed: set[str] = set()  # raw tags without an end in the rest of the page
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        close = nxt == "/"
        name = _NAME.match(page, lt + 1 + close)
        if name is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = -1 if torn else _tag_end(page, name.end())
        if end < 0:  # some quote is never closed: from here on a tag ends at its first >
            torn, end = True, page.find(">", name.end())
            end = size if end < 0 else end
        tag, rest = name[0].lower(), page[name.end() : end]
        at = end + 1
        if close:
            yield "close", tag, ""
            continue
        yield "open", tag, rest
        if tag in RAW and not rest.endswith("/"):
            stop = re.compile(rf"</?{tag}\b" if tag in _FLAT else rf"</{tag}\b", re.I).search(page, at) if tag not in unclosed else None
            again = stop is not None and page[stop.start() + 1] != "/"
            if again or stop is None and tag not in ("script", "style"):  # not closed: it ends where a block begins or ends
                if not again:
                    unclosed.add(tag)
                block = _NEXT_BLOCK.search(page, at)
                at = min(size if block is None else block.start(), stop.start() if again else size)
                yield "close", tag, ""
                continue
            at = size if stop is None else stop.start()
            if stop is not None:
                past = page.find(">", at)
                at = size if past < 0 else past + 1
            yield "close", tag, ""


def _says_out(names: str, inside: bool) -> bool:
    """Whether a class or id has a name that consists of words of unwanted parts and their layout."""
    for one in names.split():
        parts = set(_WORD.findall(_HUMP.sub(" ", one).lower()))
        told = parts & (OUT_NAMES - OUTSIDE_ONLY if inside else OUT_NAMES)
        if told and parts <= OUT_NAMES | PLAIN_NAMES:
            return True
    return False


@lru_cache(maxsize=50_000)
def _judge(tag: str, rest: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether a tag opens an unwanted part, whether only its name says so, and its step in a generalised path (tag
    and first class, digits dropped). ``inside`` an article, some names say nothing."""
    if tag in OUT_TAGS or tag in RAW:
        return True, False, ""
    values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
    hidden = _HIDDEN.search(rest) or "display:none" in values.get("style", "").replace(" ", "").lower()
    marked = tag not in ("html", "body", "main", "article") and _says_out(f"{values.get('class', '')} {values.get('id', '')}", inside)
    first = _DIGITS.sub("", (values.get("class", "").split() or [""])[0].lower()).replace(">", "")
    out = bool(hidden or values.get("role", "").lower() in OUT_ROLES)
    return out or marked, marked and not out, f">{tag}.{first}" if first else f">{tag}"


def parse(page: str) -> Page:
    """The containers of a page in page order and its blocks of text without unwanted parts.

    Containers whose names mark them as unwanted, but that hold nearly all text of a page without article or main, are wanted
    after all: such containers lie inside each other, and they are spared from the outside in, until an article or main is
    found. A page is read twice at most.
    """
    read, kept, own, above, told = _parse(page, frozenset())
    if not own or 0 in told:
        return read
    total, inner = kept + sum(own.values()), dict(own)
    for mark in sorted(above, reverse=True):
        if above[mark]:
            inner[above[mark]] = inner.get(above[mark], 0) + inner.get(mark, 0)
    spared = []
    for mark in sorted(m for m, size in inner.items() if size >= _MOST * total):
        spared.append(mark)
        if mark in told:
            break
    return _parse(page, frozenset(spared))[0] if spared else read


def _parse(page: str, spared: frozenset[int]) -> tuple[Page, int, dict[int, int], dict[int, int], set[int]]:
    """The page; the length of its text; the lengths lost to marked tags, by number; the mark around each mark; the marks (0:
    none) right below which there is text of an article or main. Linear in the page's length."""
    blocks: list[str] = []
    root = Node("", "", None, False, 0, 0, 0)
    stack, found = [root], [root]
    open_ = Counter()
    words: list[str] = []
    kept, number, own, above, told = 0, 0, Counter(), {}, set()
    in_link = 0

    def flush() -> None:
        nonlocal words, kept
        if not words:
            return
        text = "".join(words)
        words = []
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if not text:
            return
        kept += len(text)
        blocks.append(text)
        owner = stack[-1].owner
        if stack[-1].inside:
            told.add(0)
        worth = (len(text) + 25 * text.count(",")) * (0.2 if in_link else 1.0)
        owner.score += worth
        if owner.parent is not None:
            owner.parent.owner.score += worth / 2

    def cut(depth: int) -> None:
        """Close all elements from a depth on."""
        nonlocal in_link
        for node in stack[depth:]:
            node.hi, node.last = len(blocks), number
            open_[node.tag] -= 1
            in_link -= node.tag == "a"
        del stack[depth:]

    for kind, tag, rest in _tags(page):
        top = stack[-1]
        if kind == "text":
            if top.hard:
                continue
            if top.mark:
                size = len(" ".join(tag.split()))
                own[top.mark] += size
                if size and top.inside:
                    told.add(top.mark)
            else:
                words.append(tag)
            continue
        if kind == "open":
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            closing = CLOSES.get(tag)
            if closing or tag in BLOCK:
                goes = closing | _P if closing else _P
                if any(open_[t] for t in goes):
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth].tag in goes:
                            cut(depth)
                            break
                        if stack[depth].tag in BLOCK:
                            break
            number += 1
            parent = stack[-1]
            if parent.hard:
                node = Node(tag, "", parent, True, parent.mark, number, len(blocks))
            else:
                out, named, step = _judge(tag, rest if rest and _TELLING.search(rest) else "", parent.inside)
                mark = parent.mark
                if named and number not in spared:
                    above[number], mark = mark, number
                node = Node(tag, step, parent, out and not named, mark, number, len(blocks))
            stack.append(node)
            open_[tag] += 1
            in_link += tag == "a"
            if tag in CONTAINERS and not node.hard and not node.mark:
                found.append(node)
                if tag in _NAMED:
                    node.score += 50.0
            continue
        if tag in BLOCK:
            flush()
        if open_[tag]:
            depth = len(stack) - 1
            while stack[depth].tag != tag:
                depth -= 1
            cut(depth)
    flush()
    cut(1)
    root.hi, root.last = len(blocks), number
    return Page(found, blocks), kept, own, above, told


def _whole(node: Node, page: Page) -> Node:
    """The container that holds the whole article of a good container: its outermost article or main, else the lowest one
    around it, below the body, with nearly all text of the page; itself where there is none."""
    if node.whole is not None:
        return node.whole
    most, at = _MOST * page.sums[-1], node
    while at is not None:
        if (at is node or at.tag in CONTAINERS and at.tag != "body") and page.size(at) >= most:
            return at
        at = at.parent
    return node


def votes(page: str, most: int = 3) -> list[tuple[str, float]]:
    """The paths of a page's best containers, each with its share of the best score.

    Equal paths add up, and containers inside an article or main count for it. Where one article or main holds a good part of
    the page's text, only these count, however many teasers stand beside it. The best path then climbs from its best container
    to the one that holds the whole article.
    """
    read = parse(page)
    scores: dict[int, float] = {}
    best: dict[int, Node] = {}
    for node in read.found:
        if node.score > 0:
            key = (node.whole or node).key
            scores[key] = scores.get(key, 0.0) + node.score
            if key not in best or node.score > best[key].score:
                best[key] = node
    held = [(read.size(n), n.key) for n in read.found if n.tag in _NAMED]
    if held and max(held)[0] >= _SOME * read.sums[-1]:
        told = {key for _, key in held}
        scores = {key: value for key, value in scores.items() if key in told}
    first = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]
    out: dict[str, float] = {}
    for k, (key, value) in enumerate(first):
        to = (best[key].whole or best[key]) if k else _whole(best[key], read)
        path = to.path()
        out[path] = max(out.get(path, 0.0), value / first[0][1])
    return list(out.items())


def extract(page: str, path: str | None) -> str:
    """Blocks of the containers at ``path``, in page order; of the whole article around the page's best container where it
    has none there."""
    read, key = parse(page), None if path is None else key_of(path)
    outer: list[Node] = []
    for node in read.found:
        # a container inside one that is taken is taken with it
        if node.key == key and node.hi > node.lo and (not outer or node.number > outer[-1].last):
            outer.append(node)
    if not outer:
        best = max(read.found, key=lambda n: n.score, default=None)
        outer = [_whole(best, read)] if best is not None else []
    return read.text(outer)


def host(url: str):
    """Host of a URL column in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): per host the path with the most votes; ties go to the path that sorts first.

    Pages of one host are counted per task before the shuffle, so a hot host costs no more than its paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], float] = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, share in votes(page.as_py()):
                    tally[h, path] = tally.get((h, path), 0.0) + round(share, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array([round(1000 * v) for v in tally.values()], pa.int64())],
                names=["host", "path", "vote"],
            )

    cast = pages.select(host(url_col).alias("host"), whole_text(html_col).alias("html")).mapInArrow(run, "host string, path string, vote long")
    summed = cast.groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct((-F.col("vote")).alias("v"), F.col("path"))).alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, path (the host's winning path), n_chars.

    Null or empty html, and pages without text, give an empty text; pages without a host vote together. Repeated rows
    stay, other columns are ignored. The winners are one short row per host; the join may be skewed by a hot host and is
    left to AQE, which splits it.
    """
    winners = keep(host_paths(pages, url_col, html_col), "paths")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host(url_col).alias("host"), whole_text(html_col).alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), w) for p, w in zip(batch.column("_html"), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url").cast(pa.string()), pa.array(texts, pa.string()), batch.column("path"), pa.array([len(t) for t in texts], pa.int64())],
                names=["_id", "_url", "text", "path", "n_chars"],
            )

    read = rows.join(winners, "host", "left").select("_id", "_url", "_html", "path").mapInArrow(run, f"_id {kind}, _url string, text string, path string, n_chars long")
    return read.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
