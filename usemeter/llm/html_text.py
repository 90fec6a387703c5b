"""Main text of web pages: markup says what it can, a suffix array over each host's pages says the rest.

A page becomes a stream of blocks.  Elements that are never main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) are marked by element and by the words of their class,
id and role; where a page marks an article or main part that holds most of its own text, only that part is kept.  The token streams of a
host's pages are concatenated, a suffix array (sorted by prefix doubling up to ``MIN_TOKENS`` tokens, which
tells all longer repeats) finds substrings that stand on ``MIN_PAGES`` pages of different content; blocks
that such substrings cover whole are boilerplate and go, all others stay.  Inside a marked part the substrings must
stand on half of the host's pages: a line that a few articles share is theirs.

Substrings are always counted over the whole host.  One task takes a host of up to ``HOST_TOKENS`` tokens; a larger
one is dealt into shards, whose counts ``large_hosts`` adds up: the same texts, by whichever way.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usemeter.llm.common import keep, small_batches

MIN_TOKENS = 8
MIN_PAGES = 3
#: In a marked article or main part only what stands on this share of the host's pages is boilerplate.
HOST_SHARE = 0.5
#: Pages of one host whose substrings are equal to this share are one content.
NEAR = 0.9
#: Tokens, by a rough estimate, of a host that one task takes whole; larger hosts are dealt over several tasks.
HOST_TOKENS = 2_000_000
#: Characters of a page for each token of that estimate.
_TOKEN_CHARS = 6
#: Characters of blocks that a task holds, packed together by where they go, and characters of one package about.
HELD_CHARS, PACKAGE_CHARS = 16_000_000, 100_000

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|title|select|object|canvas|audio|video)\b(?:"[^"]*"|'[^']*'|[^'">])*+(?:>.*?(?:</(?P=raw)\b[^>]*>|\Z)|\Z)
      | <(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)
      | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_PART = re.compile(r"[a-z]+")

_SLOTS, _BAND = 64, 8
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 2**31, _SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WEIGHTS = _RANDOM.integers(0, 2**63, MIN_TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIXER = np.uint64(0xC4CEB9FE1A85EC53)

#: Elements that hold no main text.
_DROPPED = frozenset("nav header footer aside form button menu dialog head".split())
#: Words of a class, id or role that say the same, alone or as first or last part of a name ("left-sidebar").
_DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended promo promotion ad ads advert advertisement advertising sponsor sponsored "
    "banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login search social share sharing comment comments disqus respond replies "
    "pagination pager toolbar contentinfo complementary".split()
)
#: Parts that turn the name round: "no-sidebar" and "has-sidebar" are names of what stands beside a sidebar.
_NOT_ITSELF = frozenset("no non not without with has have hide".split())
_MAIN = frozenset(["article", "main"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that another block ends without an end tag.
_OPEN_END = frozenset("p li dt dd tr td th option".split())


@dataclass
class Page:
    """Blocks of text in page order; ``main`` tells which stand in a marked article or main part."""

    blocks: list[str] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)

    @property
    def settled(self) -> bool:
        """Whether the markup says what the main part is."""
        return any(self.main)


def _is_hinted(name: str, rest: str) -> bool:
    """Whether class, id or role call the element something that is never main text."""
    if "=" not in rest or name in ("html", "body"):
        return False
    for attribute, value in _ATTRIBUTE.findall(rest):
        if value and attribute.lower() in ("class", "id", "role"):
            for word in value.strip("\"'").lower().split():
                for named in word.split("--")[0].split("__"):
                    parts = _PART.findall(named)
                    if parts and (parts[0] in _DROPPED_WORDS or parts[-1] in _DROPPED_WORDS) and _NOT_ITSELF.isdisjoint(parts):
                        return True
    return False


@dataclass
class _Hinted:
    """An element that its class, id or role would drop; ``level`` counts the open elements of its name."""

    name: str
    level: int
    outer: int | None
    main_depth: int
    has_main: bool = False
    size: int = 0


def _dropped(hinted: list[_Hinted], size: int, main_size: int) -> list[bool]:
    """Which hinted elements go, of a page with ``size`` characters, ``main_size`` of them marked and not hinted.

    A name alone drops neither the only article or main part nor most of a page's text; of a page with a marked part
    of its own most is four times that part, so long comments still go.
    """
    gone: list[bool] = []
    for h in hinted:
        most = h.size > 4 * main_size if main_size else 2 * h.size > size
        gone.append(h.outer is not None and gone[h.outer] or not (most or h.has_main and not main_size))
    return gone


def parse(html: str) -> Page:
    """The blocks of ``html`` outside elements that are never main text; never fails on broken markup."""
    pieces: list[tuple[int | None, str]] = []  # of the block being read: the innermost hinted element and the text
    blocks: list[tuple[list[tuple[int | None, str]], bool]] = []
    hinted: list[_Hinted] = []
    inside: list[int] = []  # hinted elements that are open
    levels: dict[str, int] = {}
    skipped, depth = None, 0  # the dropped element that is open, and how many of its name
    main_depth, at = 0, 0

    def end_block():
        if pieces:
            blocks.append((pieces.copy(), main_depth > 0))
            pieces.clear()

    def leave(place: int):
        """Ends the open hinted elements from ``place`` on."""
        nonlocal main_depth
        main_depth = hinted[inside[place]].main_depth
        while len(inside) > place:
            h = hinted[inside.pop()]
            levels[h.name] = h.level - 1
            if not levels[h.name]:
                del levels[h.name]

    for m in _MARKUP.finditer(html):
        if skipped is None and m.start() > at:
            pieces.append((inside[-1] if inside else None, html[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, closes, rest = name.lower(), bool(m["close"]), m["rest"]
        opens = not closes and name not in _VOID and not rest.endswith("/")
        inline = name in _INLINE
        if not inline and skipped is None:
            end_block()
        # A paragraph or item without an end tag lasts until the next block starts or its parent ends.
        while inside and not inline and hinted[inside[-1]].name in _OPEN_END:
            leave(len(inside) - 1)
        if name in levels and (opens or closes):
            levels[name] += 1 if opens else -1
            if closes:
                ended = next((i for i in range(len(inside) - 1, -1, -1) if hinted[inside[i]].name == name), None)
                if ended is not None and hinted[inside[ended]].level > levels[name]:
                    leave(ended)
                    skipped, depth = None, 0
                    continue
        if skipped is not None:
            if name == skipped:
                depth += opens - closes
                if depth <= 0:
                    skipped = None
            continue
        if not opens:
            main_depth -= closes and name in _MAIN and main_depth > 0
            continue
        if name in _DROPPED:
            skipped, depth = name, 1
            continue
        if _is_hinted(name, rest):
            if name not in levels:
                levels[name] = 1
            hinted.append(_Hinted(name, levels[name], inside[-1] if inside else None, main_depth))
            inside.append(len(hinted) - 1)
        if name in _MAIN:
            main_depth += 1
            if inside:
                hinted[inside[-1]].has_main = True
    if skipped is None:
        pieces.append((inside[-1] if inside else None, html[at:]))
    end_block()
    return _page(blocks, hinted)


def _page(blocks: list[tuple[list[tuple[int | None, str]], bool]], hinted: list[_Hinted]) -> Page:
    gone: list[bool] = []
    if hinted:
        size = main_size = 0
        for pieces, main in blocks:
            for of, piece in pieces:
                n = len(piece.strip())
                size += n
                if of is not None:
                    hinted[of].size += n
                elif main:
                    main_size += n
        for h in reversed(hinted):
            if h.outer is not None:
                hinted[h.outer].size += h.size
                hinted[h.outer].has_main |= h.has_main
        gone = _dropped(hinted, size, main_size)
    page = Page()
    for pieces, main in blocks:
        block = " ".join(unescape("".join(piece for of, piece in pieces if of is None or not gone[of])).split())
        if block:
            page.blocks.append(block)
            page.main.append(main)
    return page


# --- suffix array of a host ----------------------------------------------------------------------------


def ranks(pages: list[np.ndarray], min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each suffix of the concatenated streams by its first ``min_tokens`` tokens, and the pages' stops.

    Suffixes are ranked by their first 1, 2, 4, ... tokens; equal ranks are equal substrings.  A stop behind each
    page, of a value of its own, keeps repeats inside pages.
    """
    lengths = np.array([len(p) for p in pages])
    stream = np.concatenate([np.r_[p, np.uint64(0)] for p in pages]) if pages else np.zeros(0, np.uint64)
    stops = np.cumsum(lengths + 1) - 1
    _, rank = np.unique(stream, return_inverse=True)
    rank = rank.astype(np.int64)
    rank[stops] = rank.max(initial=0) + 1 + np.arange(len(stops))
    done = 1
    while done < min_tokens:
        step = min(done, min_tokens - done)
        following = np.r_[rank[step:], np.full(min(step, len(rank)), -1)]
        _, rank = np.unique(rank * (rank.max(initial=0) + 2) + following + 1, return_inverse=True)
        done += step
    return rank, stops


def owned(rank: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The first suffix of each pair of a rank and an owner, in the order of ranks."""
    suffixes = np.lexsort((owners, rank))
    r, p = rank[suffixes], owners[suffixes]
    return suffixes[np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])]] if len(r) else suffixes


def covering(starts: np.ndarray, min_tokens: int = MIN_TOKENS) -> np.ndarray:
    """For each token the highest of the counts of the substrings of ``min_tokens`` over it."""
    most = starts.copy()
    for back in range(1, min(min_tokens, len(starts))):
        np.maximum(most[back:], starts[:-back], out=most[back:])
    return most


def _counts(rank: np.ndarray, owners: np.ndarray, min_tokens: int) -> np.ndarray:
    """For each token the most ``owners`` that share one of the substrings of ``min_tokens`` over it."""
    return covering(np.bincount(rank[owned(rank, owners)])[rank] if len(rank) else rank, min_tokens)


# --- contents and near copies --------------------------------------------------------------------------


def _signed(digest: int) -> int:
    return digest - (digest >> 63 << 64)


def content_of(host: str, page: Page) -> int:
    """The 64-bit name of a host's page by its tokens: equal pages of one host are one content."""
    return _signed(xxhash.xxh3_64_intdigest(" ".join(page.blocks), xxhash.xxh3_64_intdigest(host)))


def gram_hashes(tokens: np.ndarray, content: int) -> np.ndarray:
    """A hash of 56 bits of the ``MIN_TOKENS`` tokens from each token on; those that reach past the end are the content's own."""
    n, own = len(tokens), np.uint64(content & 0xFFFFFFFFFFFFFFFF)
    stream = np.r_[tokens, (own ^ np.arange(1, MIN_TOKENS, dtype=np.uint64)) * _MIXER | np.uint64(1)]
    h = np.zeros(n, np.uint64)
    for at, weight in enumerate(_WEIGHTS):
        h += stream[at : at + n] * weight
    h = (h ^ (h >> np.uint64(33))) * _MIXER
    return (h ^ (h >> np.uint64(29))) >> np.uint64(8)


def signature(grams: np.ndarray) -> np.ndarray:
    """``_SLOTS`` minimum hashes of a set of substrings, 16 bits of each."""
    least = np.full(_SLOTS, np.iinfo(np.uint32).max, np.uint32)
    short = (grams >> np.uint64(24)).astype(np.uint32)
    for at in range(0, len(short), 10_000):
        mixed = _FACTORS[:, None] * short[at : at + 10_000]
        mixed ^= mixed >> np.uint32(15)
        least = np.minimum(least, mixed.min(axis=1))
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def bands_of(slots: np.ndarray) -> list[int]:
    """Near copies share one of these numbers, each of ``_BAND`` slots."""
    return [_signed(xxhash.xxh3_64_intdigest(slots[k : k + _BAND].tobytes())) for k in range(0, _SLOTS, _BAND)]


def near_roots(contents: np.ndarray, signatures: list[np.ndarray]) -> np.ndarray:
    """For each content the least content of its class, whatever the order.

    In each band contents are compared with the least one that shares it and linked if ``NEAR`` of their slots are
    equal; links make the classes.  The work is linear in the contents.
    """
    ordered = np.argsort(contents, kind="stable")
    parent, seen = np.arange(len(contents)), [{} for _ in range(0, _SLOTS, _BAND)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in ordered.tolist():
        for hub in {first.setdefault(band, i) for first, band in zip(seen, bands_of(signatures[i]))}:
            if hub != i and (signatures[i] == signatures[hub]).mean() >= NEAR:
                a, b = root(i), root(hub)
                low, high = (a, b) if contents[a] < contents[b] else (b, a)
                parent[high] = low
    return contents[[root(i) for i in range(len(contents))]] if len(contents) else contents


def repeat_counts(named: list[int], pages: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each page's token hashes, how many contents share a substring of ``MIN_TOKENS`` over it; and all contents.

    Equal pages, which have one name, are one content, and so are pages whose substrings are equal to nine tenths.
    """
    distinct = dict(zip(named, pages))
    place = {c: i for i, c in enumerate(distinct)}
    contents, streams = np.array(list(distinct), np.int64), list(distinct.values())
    rank, stops = ranks(streams, MIN_TOKENS)
    lengths = np.array([len(p) for p in streams], np.int64)
    owners = contents.copy()
    long = np.flatnonzero(lengths)
    owners[long] = near_roots(contents[long], [signature(gram_hashes(streams[i], int(contents[i]))) for i in long])
    most = _counts(rank, np.repeat(owners, lengths + 1), MIN_TOKENS)
    return [most[stops[i] - lengths[i] : stops[i]] for i in (place[c] for c in named)], len(np.unique(owners))


def repeated_tokens(pages: list[np.ndarray], min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each page's token hashes, which lie in a substring of ``min_tokens`` or more found on ``min_pages`` pages."""
    rank, stops = ranks(pages, min_tokens)
    lengths = np.array([len(p) for p in pages], np.int64)
    most = _counts(rank, np.repeat(np.arange(len(pages)), lengths + 1), min_tokens)
    return [most[e - n : e] >= min_pages for e, n in zip(stops, lengths)]


class Hashes(dict):
    """Token hashes, remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token) | 1
        return h

    def of(self, page: Page) -> np.ndarray:
        tokens = " ".join(page.blocks).split(" ") if page.blocks else []
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def main_text(page: Page, count: np.ndarray, contents: int) -> str:
    """The blocks of a page that stay: they go whole, if all their tokens lie in repeats."""
    sizes = np.array([b.count(" ") + 1 for b in page.blocks], np.int64)
    least = np.minimum.reduceat(count, np.cumsum(sizes) - sizes) if len(sizes) else sizes
    main, unique = np.array(page.main, bool), least < MIN_PAGES
    # A teaser card is an article as well: the main part is what holds most of the page's own text.
    if page.settled and 2 * sizes[main & unique].sum() >= sizes[unique].sum():
        unique = main & (least < max(MIN_PAGES, contents * HOST_SHARE))
    return " ".join(b for b, u in zip(page.blocks, unique) if u)


def main_texts(pages: list[Page], hashes: Hashes | None = None, host: str = "") -> list[str]:
    """The main texts of one host's pages."""
    hashes = Hashes() if hashes is None else hashes
    counts, contents = repeat_counts([content_of(host, p) for p in pages], [hashes.of(p) for p in pages])
    return [main_text(page, count, contents) for page, count in zip(pages, counts)]


# --- tables --------------------------------------------------------------------------------------------

TEXT_DDL = "page_id long, url string, text string, n_chars long"


_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()


def packed(rows: list[tuple], pages: list[Page]) -> bytes:
    """Pages that go the same way, each with a row of its own values; together they take less than apart.

    Blocks hold no white space but single spaces, so none of the separators; JSON escapes them.
    """
    texts = ("\n".join(["".join("01"[m] for m in p.main), *p.blocks]) for p in pages)
    return _SQUEEZE.compress("\x1e".join([json.dumps(rows), *texts]).encode())


def unpacked(data: bytes) -> Iterator[tuple[list, Page]]:
    """Each row of ``packed`` with its page."""
    rows, *texts = _EXPAND.decompress(data).decode().split("\x1e")
    for row, text in zip(json.loads(rows), texts, strict=True):
        marks, *blocks = text.split("\n")
        yield row, Page(blocks, [m == "1" for m in marks])


class Packages:
    """Pages of a task by where they go: a package is ready when it or all together are long enough."""

    def __init__(self):
        self.open: dict[tuple, tuple[list[tuple], list[Page]]] = {}
        self.sizes: Counter[tuple] = Counter()
        self.held = 0

    def add(self, to: tuple, row: tuple, page: Page) -> Iterator[tuple]:
        """Takes a page with its row; gives ``(*to, package)`` of what is ready."""
        rows, pages = self.open.setdefault(to, ([], []))
        rows.append(row)
        pages.append(page)
        size = sum(map(len, page.blocks)) + 100
        self.sizes[to] += size
        self.held += size
        if self.sizes[to] >= PACKAGE_CHARS:
            self.held -= self.sizes.pop(to)
            yield *to, packed(*self.open.pop(to))
        elif self.held >= HELD_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[tuple]:
        for to, own in self.open.items():
            yield *to, packed(*own)
        self.__init__()


def packages(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def text_rows(rows: list[tuple[int | None, str | None]], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def columns_of(batch: pa.RecordBatch, *names: str) -> Iterable[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names))


_PARSED = pa.schema([("host", pa.string()), ("pages", pa.binary())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Packages()
    for batch in batches:
        ready = []
        for page_id, url, html, host in columns_of(batch, "page_id", "url", "html", "host"):
            ready += held.add((host,), (page_id, url), parse(html))
        yield packages(_PARSED, ready)
    yield packages(_PARSED, list(held.rest()))


def _extract(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages of pages sorted by host, in runs of one host."""
    hashes, run, host = Hashes(), [], None

    def out():
        return text_rows(run, main_texts([page for _, _, page in run], hashes, host))

    for batch in groups:
        for its_host, pages in columns_of(batch, "host", "pages"):
            if run and host != its_host:
                yield out()
                run = []
            host = its_host
            run += [(page_id, url, page) for (page_id, url), page in unpacked(pages)]
    if run:
        yield out()


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row: its blocks of main text joined by spaces.

    A null or empty page gives an empty text; null urls and urls without a host share one host; null ids and
    repeated rows give a row each (equal and nearly equal pages of one host count as one); an empty table gives
    none; other columns are not looked at.  A host's pages are compared all with each other: in one task up to about
    ``HOST_TOKENS`` tokens, else by shards whose counts are added up.  The result does not depend on which.
    """
    from usemeter.llm.large_hosts import large_host_texts

    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"), host.alias("host")
    )
    tokens = F.sum(F.length("html") / _TOKEN_CHARS + 1)
    # As many hosts at most as the table has ``HOST_TOKENS`` tokens: a row each is little to broadcast.
    large = keep(rows.groupBy("host").agg(tokens.alias("tokens")).where(F.col("tokens") > HOST_TOKENS), "hosts")
    small = rows.join(F.broadcast(large), "host", "left_anti").select("page_id", "url", "html", "host")
    parsed = small.mapInArrow(_parsed, "host string, pages binary")
    texts = parsed.repartition("host").sortWithinPartitions("host").mapInArrow(_extract, TEXT_DDL)
    return texts if large.isEmpty() else texts.unionByName(large_host_texts(rows, large))
