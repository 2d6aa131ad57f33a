"""Main text of web pages: page elements, and runs that a host repeats.

Each page is walked once and cut into blocks of three kinds: those of its article
or main element, those that elements or their names mark as menus, headers,
footers, sidebars, notices, adverts, forms or reader comments, and the rest. A class or
id marks an element only if all its words do (``comment-list``, but not ``social-history``),
and not if hardly any text is left without the elements that names mark.

The token streams of a host's pages, blocks of all kinds in page order, go through
a suffix array. Tasks gather pages into blocks of about ``BLOCK_BYTES`` of source. As
a first sieve, each run of ``MIN_RUN`` tokens is stood for by the least hash among
its shorter grams: equal runs have equal ones, so a run whose gram fewer than
``MIN_PAGES`` pages of the host hold cannot be shared, and a third of all hashes does.
The suffixes that are left are sorted by their first ``MIN_RUN`` tokens with prefix
doubling, and the classes of equal suffixes are merged with those of all other blocks
by a 64-bit key of host and tokens. So a run is known by all pages of its host,
however the pages were dealt and however large the host is, and no host sits in one task.

A longer substring that pages share is covered by its own runs of ``MIN_RUN`` tokens, each
shared by those pages and perhaps by more, so what runs cover is what all maximal repeats
of that length or more cover. A run that ``MIN_PAGES`` distinct pages of a host share is
judged by where it stands; pages with equal tokens and kinds count once. What articles share,
such as quoted passages and near copies, is text, also where single adverts say the
same. So of an article only the blocks go that are filled from end to end by runs
which at least half of the host's pages have outside of their article: the notices
and menus of a site. A page without article loses every word of its unmarked blocks that
is covered by runs which fewer than half of their pages have in an article. What is
left is the text: the article's blocks, or without one the unmarked ones.

Tokens are compared without regard to the case of A-Z, by 64-bit hashes.

Defined results: null and empty pages give the empty text. Null ids and urls, and
repeated rows, stay rows of their own; a null url belongs to the nameless host. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm import exchange
from quaver.llm.common import forget, small_batches, stored
from quaver.llm.exchange import packed, unpacked
from quaver.llm.textarrays import NOT_WHITE, Words, mix
from quaver.llm.url_filter import host

MIN_RUN, MIN_PAGES, BLOCK_BYTES = 8, 3, 4 << 20
#: Tokens of a gram of the sieve.
GRAM = 4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object head title canvas audio video".split())
MARKED = frozenset("nav footer aside form button select textarea dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new element of the same kind ends.
IMPLIED = frozenset("p li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: A class or id is a marker if one of its words is of the first list and all of them are of either.
MARKERS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr "
    "notice notices notification notifications comment comments disqus reply replies sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer "
    "share sharing social newsletter subscribe subscription signup related popup modal widget widgets skip".split()
)
FRAMES = frozenset(
    "area articles bar block body bottom box button buttons col column container content count dialog element entries entry feed form frame global group head header "
    "holder icon icons inner item items layer left link links list main message messages nr outer overlay page panel popup posts primary right row secondary section "
    "site slot stories sub text thread toggle top unit wrap wrapper zone".split()
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marked elements without which less than this share of a text is left are its text.
LEAST_LEFT = 0.1


@lru_cache(maxsize=4096)
def is_marker(name: str) -> bool:
    words = [w.lower() for w in WORDS.findall(name)]
    return not MARKERS.isdisjoint(words) and all(w in MARKERS or w in FRAMES for w in words)


ARTICLE, JUNK, REST, NAMED = 0, 1, 2, 3


class _Walker(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements (tag, kind it sets or None, silent), and how many there are of each tag and kind.
        self.open: list[tuple[str, int | None, bool]] = []
        self.tags: dict[str, int] = {}
        self.kinds = [0, 0, 0, 0]
        self.silent, self.text = 0, []
        #: Kind, text, and the number of the outermost element whose name marks it, or 0.
        self.blocks: list[tuple[int, str, int]] = []
        #: Numbers of open elements that names mark.
        self.named: list[int] = []
        self.n_named = 0

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                kind = JUNK if self.kinds[JUNK] else ARTICLE if self.kinds[ARTICLE] else REST
                self.blocks.append((kind, text, self.named[0] if self.named else 0))
            self.text = []

    def push(self, tag: str, kind: int | None) -> None:
        silent = tag in SILENT
        self.open.append((tag, kind, silent))
        self.tags[tag] = self.tags.get(tag, 0) + 1
        self.silent += silent
        if kind is not None:
            self.kinds[kind] += 1
        if kind == NAMED:
            self.n_named += 1
            self.named.append(self.n_named)

    def pop_to(self, depth: int) -> None:
        for tag, kind, silent in self.open[depth:]:
            self.tags[tag] -= 1
            self.silent -= silent
            if kind is not None:
                self.kinds[kind] -= 1
            if kind == NAMED:
                self.named.pop()
        del self.open[depth:]

    def mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int | None:
        """What an element's tag and attributes say: ``JUNK`` for sure, ``NAMED`` by a class or id, or nothing."""
        inside = self.kinds[ARTICLE] > 0
        if tag in MARKED or tag == "header" and not inside:
            return JUNK
        if not attrs:
            return None
        named = {k: v or "" for k, v in attrs}
        if named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true":
            return JUNK
        if "style" in named and re.search(r"(?i)display\s*:\s*none", named["style"]):
            return JUNK
        if tag in ("html", "body", "article", "main"):
            return None
        # A heading's id is the slug of its words.
        names = named.get("class", "").split() + ([named["id"]] if "id" in named and tag not in HEADINGS else [])
        return NAMED if any(map(is_marker, names)) else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in VOID:
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in IMPLIED and self.tags.get(tag):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] == tag:
                    self.pop_to(depth)
                    break
                if self.open[depth][0] in BLOCKS and self.open[depth][0] not in IMPLIED:
                    break
        article = tag in ("article", "main") or any(k == "role" and v == "main" for k, v in attrs)
        kind = self.mark(tag, attrs)
        kind = ARTICLE if kind is None and article else kind
        if kind == ARTICLE and not self.kinds[ARTICLE] and (self.kinds[JUNK] or self.named):
            # An article inside an element that was left open does not belong to it.
            self.pop_to(next(depth for depth, (_, k, _) in enumerate(self.open) if k in (JUNK, NAMED)))
        self.push(tag, kind)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in SILENT:
            self.text.append(" ")
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not self.tags.get(tag):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.pop_to(depth)
                return
            if self.open[depth][0] in ("article", "main") and tag not in ("body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in page order."""
    walker = _Walker()
    walker.feed(html)
    walker.close()
    walker.flush()
    blocks = walker.blocks
    own = ARTICLE if any(kind == ARTICLE for kind, _, _ in blocks) else REST
    sizes = [len(text) if kind == own else 0 for kind, text, _ in blocks]
    named = sum(n for n, (_, _, mark) in zip(sizes, blocks) if mark)
    # A name only votes: what holds nearly all of the text is the text, whatever it is called.
    believed = sum(sizes) - named >= LEAST_LEFT * sum(sizes)
    return [(JUNK if mark and (believed or kind != own) else kind, text) for kind, text, mark in blocks]


def suffix_classes(tokens: np.ndarray, page: np.ndarray, run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that have ``run`` tokens of their page left, and their classes.

    ``tokens`` are numbers; ``page`` is each token's page, not falling. Ranks of prefixes
    double in length until they reach ``run``; suffixes of equal rank are the array's
    neighbours with a common prefix of that length.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    length = 1
    while length < run:
        step = min(length, run - length)
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank * (n + 1) + second, return_inverse=True)
        length += step
    places = np.flatnonzero(page[: n - run + 1] == page[run - 1 :])
    return places, rank[places]


class _Suffixes:
    """A block's tokens, the suffixes of its streams and the keys of their classes.

    They are worked out anew in each round: keys do not compress, so storing them
    would take more than the pages themselves.
    """

    def __init__(self, texts: list[str], n_blocks: np.ndarray, kinds: np.ndarray, hosts: np.ndarray):
        column = pa.array(texts, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
        words = Words(offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8), NOT_WHITE)
        self.pages, self.kinds, self.hosts = len(n_blocks), kinds, hosts
        self.page_of_block = np.repeat(np.arange(self.pages), n_blocks)
        self.block_of_token = words.doc
        self.sizes = np.bincount(words.doc, minlength=len(texts))
        self.page_of_token = self.page_of_block[words.doc]
        self.tokens = mix(words.hash ^ hosts[self.page_of_token])

    def sieve(self) -> None:
        """Set the ``places`` of all runs, their ``page``, the sorted ``grams`` that stand for them and each run's in ``gram``."""
        n = max(0, len(self.tokens) - MIN_RUN + 1)
        self.places = np.flatnonzero(self.page_of_token[:n] == self.page_of_token[MIN_RUN - 1 :])
        self.page = self.page_of_token[self.places]
        grams = np.zeros(max(0, len(self.tokens) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + self.tokens[k : k + len(grams)])
        least = grams[:n]
        for k in range(1, MIN_RUN - GRAM + 1):
            least = np.minimum(least, grams[k : k + n])
        self.grams, self.gram = np.unique(least[self.places], return_inverse=True)

    def classes(self, shared: np.ndarray) -> None:
        """Keep the runs whose gram is ``shared``; set the sorted ``keys`` of their classes and each run's key in ``local``."""
        keep = shared[self.gram]
        self.places, self.page = self.places[keep], self.page[keep]
        near = self.covered(self.places)
        at = np.flatnonzero(near)
        # Runs do not reach from one stretch of tokens that are left into the next.
        stretch = np.cumsum(np.append(True, np.diff(at) > 1)) if len(at) else at
        places, classes = suffix_classes(self.tokens[at], stretch * (self.pages + 1) + self.page_of_token[at])
        wanted = np.isin(at[places], self.places, assume_unique=True)
        _, first, local = np.unique(classes[wanted], return_index=True, return_inverse=True)
        keys = np.zeros(len(first), np.uint64)
        for k in range(MIN_RUN):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + self.tokens[self.places[first] + k])
        self.keys, again = np.unique(keys, return_inverse=True)
        self.local = again[local]

    def covered(self, places: np.ndarray) -> np.ndarray:
        """Tokens in runs that begin at ``places``."""
        delta = np.zeros(len(self.tokens) + MIN_RUN + 1, np.int64)
        np.add.at(delta, places, 1)
        np.add.at(delta, places + MIN_RUN, -1)
        return np.cumsum(delta)[: len(self.tokens)] > 0

    def streams(self) -> np.ndarray:
        """A hash of each page's tokens in order, with the kinds of their blocks."""
        turn = np.arange(len(self.tokens)) * 3 + self.kinds[self.block_of_token] - np.searchsorted(self.page_of_token, self.page_of_token) * 3
        own = mix(self.tokens + turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
        cut = np.searchsorted(self.page_of_token, np.arange(self.pages + 1))
        return mix(total[cut[1:]] - total[cut[:-1]] + self.hosts)

    @classmethod
    def of(cls, row) -> _Suffixes:
        out = cls(list(row.texts), unpacked(row.n_blocks, np.uint32), unpacked(row.kinds, np.uint8), unpacked(row.hosts, np.uint64))
        out.sieve()
        return out


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of parsed pages."""
    task, seq = TaskContext.get().partitionId(), 0
    rows: list = []
    held = 0

    def close() -> pa.RecordBatch:
        nonlocal seq
        texts = [t for r in rows for _, t in r[3]]
        n_blocks, kinds = np.array([len(r[3]) for r in rows], np.uint32), np.array([k for r in rows for k, _ in r[3]], np.uint8)
        hosts = pd.util.hash_array(np.array(["\0" if r[2] is None else r[2] for r in rows], object), categorize=False)
        at = _Suffixes(texts, n_blocks, kinds, hosts)
        row = [f"{task}-{seq}", [r[0] for r in rows], [r[1] for r in rows], texts, packed(n_blocks), packed(kinds), packed(at.streams()), packed(hosts), len(at.tokens)]
        seq += 1
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

    for batch in batches:
        for page_id, url, name, html in zip(*(batch.column(k) for k in range(4))):
            html = html.as_py() or ""
            rows.append((page_id.as_py(), url.as_py(), name.as_py(), blocks_of(html)))
            held += len(html)
            if held >= block_bytes:
                yield close()
                rows, held = [], 0
    if rows:
        yield close()


_BLOCK = pa.schema(
    [("block", pa.string()), ("page_ids", pa.list_(pa.int64())), ("urls", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("n_blocks", "kinds", "streams", "hosts")]
    + [("n_tokens", pa.int64())]
)
BLOCK_SCHEMA = "block string, page_ids array<long>, urls array<string>, texts array<string>, n_blocks binary, kinds binary, streams binary, hosts binary, n_tokens long"
OUT = "page_id long, url string, text string, n_repeated long"


def _first_blocks(place: np.ndarray, numbers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """1 for the first entry of each key."""
    out = np.zeros(len(place), np.uint8)
    out[np.unique(place, return_index=True)[1]] = 1
    return out


def _enough(place: np.ndarray, numbers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """1 where enough distinct pages hold the key."""
    return (sums[:, 0] >= MIN_PAGES).astype(np.uint8)[place]


def _pages(place: np.ndarray, numbers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Distinct pages of each key, and in the high half how many of them have it in their article."""
    sums = sums.astype(np.uint64)
    return (sums[:, 0] | sums[:, 1] << np.uint64(32))[place]


def main_texts(pages: DataFrame, block_bytes: int = BLOCK_BYTES, array: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` of pages with ``page_id``, ``url`` and ``html``.

    ``n_repeated`` counts the words of the page, of whatever kind, that shared runs cover.
    Without ``array`` no run counts as shared, for comparison.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), BLOCK_SCHEMA)
    with exchange.block_table(blocks, "main_text_blocks") as blocks:
        n_tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        buckets = exchange.bucket_count(n_tokens, 2)

        def send_streams(row) -> pd.DataFrame:
            keys = np.unique(unpacked(row.streams, np.uint64))
            return exchange.messages(row.block, keys, np.ones(len(keys), np.uint8), buckets)

        def counted(row, replies: pd.DataFrame) -> np.ndarray:
            """The pages that stand for their stream."""
            streams = unpacked(row.streams, np.uint64)
            out = np.zeros(len(streams), bool)
            out[np.unique(streams, return_index=True)[1]] = exchange.answer(replies, np.uint8) > 0
            return out

        def send_hosts(row, replies: pd.DataFrame) -> pd.DataFrame:
            keys, place = np.unique(unpacked(row.hosts, np.uint64), return_inverse=True)
            n = np.bincount(place, counted(row, replies), len(keys)).astype(np.uint32)
            return exchange.messages(row.block, keys, np.stack([n, np.zeros_like(n)], 1), buckets)

        def send_grams(row, replies: pd.DataFrame) -> pd.DataFrame:
            at, counts = _Suffixes.of(row), counted(row, replies)
            keep = counts[at.page]
            pair = np.unique(at.gram[keep] * at.pages + at.page[keep])
            return exchange.messages(row.block, at.grams, np.bincount(pair // at.pages, minlength=len(at.grams)).astype(np.uint32), buckets)

        def send_runs(row, replies: pd.DataFrame) -> pd.DataFrame:
            at, counts = _Suffixes.of(row), counted(row, replies[replies["kind"] == "stream"])
            at.classes(exchange.answer(replies[replies["kind"] == "gram"], np.uint8) > 0)
            # Tokens of articles before each place, and so whether a run has any.
            before = np.concatenate([[0], np.cumsum(at.kinds[at.block_of_token] == ARTICLE)])
            article = before[at.places + MIN_RUN] > before[at.places]
            keep = counts[at.page]
            pair, where = np.unique(at.local[keep] * at.pages + at.page[keep], return_inverse=True)
            inside = np.bincount(where, article[keep], len(pair)) > 0
            n = len(at.keys)
            numbers = np.stack([np.bincount(pair // at.pages, minlength=n), np.bincount(pair // at.pages, inside, n)], 1)
            return exchange.messages(row.block, at.keys, numbers.astype(np.uint32), buckets)

        def finish(row, replies: pd.DataFrame) -> pd.DataFrame:
            at = _Suffixes.of(row)
            at.classes(exchange.answer(replies[replies["kind"] == "gram"], np.uint8) > 0)
            both = exchange.answer(replies[replies["kind"] == "run"], np.uint64)[at.local] if array else np.zeros(len(at.local), np.uint64)
            total, inside = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)
            host_pages = exchange.answer(replies[replies["kind"] == "host"], np.uint64).astype(np.int64)
            host_pages = host_pages[np.unique(at.hosts, return_inverse=True)[1]]
            repeats = total >= MIN_PAGES
            everywhere = repeats & (2 * (total - inside) >= host_pages[at.page])
            outside = repeats & (2 * inside < total)

            n = len(at.sizes)
            has_article = np.bincount(at.page_of_block, at.kinds == ARTICLE, at.pages) > 0
            boiler = np.where(has_article[at.page_of_block[at.block_of_token]], at.covered(at.places[everywhere]), at.covered(at.places[outside]))
            gone = np.bincount(at.block_of_token, boiler, n)
            shared = np.bincount(at.page_of_block, np.bincount(at.block_of_token, at.covered(at.places[repeats]), n), at.pages)
            start = np.cumsum(at.sizes) - at.sizes
            out: list = [[] for _ in range(at.pages)]
            for b, (page, kind, text) in enumerate(zip(at.page_of_block.tolist(), at.kinds.tolist(), row.texts)):
                if kind != (ARTICLE if has_article[page] else REST) or gone[b] == at.sizes[b]:
                    continue
                if kind == REST and gone[b]:
                    own = boiler[start[b] : start[b] + at.sizes[b]]
                    text = " ".join(w for w, c in zip(text.split(" "), own) if not c)
                out[page].append(text)
            ids = pd.array([None if x is None or x != x else int(x) for x in row.page_ids], "Int64")
            return pd.DataFrame({"page_id": ids, "url": list(row.urls), "text": ["\n".join(x) for x in out], "n_repeated": shared.astype(np.int64)})

        def kind(answers: DataFrame, name: str) -> DataFrame:
            return answers.withColumn("kind", F.lit(name))

        source = ("texts", "n_blocks", "kinds", "streams", "hosts")
        firsts = exchange.tallied(exchange.sent_by(blocks, ("streams",), send_streams), np.uint8, 1, _first_blocks, "main-text-streams")
        hosts = exchange.answered(blocks, ("streams", "hosts"), firsts, send_hosts, exchange.MESSAGE)
        hosts = kind(exchange.tallied(hosts, np.uint32, 2, _pages, "main-text-hosts"), "host")
        grams = exchange.answered(blocks, source, firsts, send_grams, exchange.MESSAGE)
        grams = kind(exchange.tallied(grams, np.uint32, 1, _enough, "main-text-grams"), "gram")
        runs = exchange.answered(blocks, source, kind(firsts, "stream").union(grams), send_runs, exchange.MESSAGE)
        runs = kind(exchange.tallied(runs, np.uint32, 2, _pages, "main-text-runs"), "run")
        out = exchange.answered(blocks, ("page_ids", "urls", *source[:3], "hosts"), grams.union(runs).union(hosts), finish, OUT)
        out = stored(out, "main-texts")
        forget(firsts, hosts, grams, runs)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
