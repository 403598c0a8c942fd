"""Main text of web pages: markup zones and a suffix array for each host.

A page is read once, tag by tag, into blocks of text, each in a zone: dropped (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments, by element, role or class),
open, inside <main>, inside <article>. The blocks that are not dropped, in page order, are the page's
token stream.

Text inside an article is kept whole, since the markup says that it is the article even where pages share a passage. What stands
beside it, or on pages without one, is judged over the whole host. A host's pages are dealt into groups of about GROUP. In each, the
streams of blocks outside articles are laid end to end and their suffix array is built by prefix doubling: adjacent suffixes with a common
prefix of RUN tokens or more hold one passage, and a group tells for each of its passages up to MIN_PAGES different pages
that hold it. These are added up by passage over all groups of the host, and a passage on MIN_PAGES different pages of
the host, wherever they were dealt, is boilerplate. Its tokens are covered, and only the runs of tokens that
are not covered stay (a covered run that reaches less than RUN tokens into a block leaves it alone, unless it covers the block). Where a
host has fewer than MIN_PAGES different pages, so that nothing can be seen to repeat, text beside an article or <main> goes by
markup. Pages with equal blocks count once. Passages are told apart between groups by 64-bit fingerprints.

Defined results: null html is empty; a null url belongs to the empty host; repeated rows are
pages of their own; an unclosed element ends with its parent; a `<` that opens no tag is text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, unused, with_columns
from .packed import FOUND, ROW, ROW_ARROW, found_rows, gathered, pack_rows, stream
from .runtime import cut, partitions
from .urlfilter import split_url
from .wordscan import U64, give_back, mix, segments

DROPPED, OPEN, MAIN, ARTICLE = range(4)
#: Tokens of a passage, and different pages of a host that make one boilerplate.
RUN, MIN_PAGES = 8, 3
#: Pages that one suffix array is built for; a larger host has several, whose counts are added up.
GROUP = 200
#: Large hosts are broadcast with their page counts if there are at most so many, counted.
BROADCAST_HOSTS = 100_000
_DEPTH = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]{0,8192}+"|'[^']{0,8192}+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:-][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_RAW = frozenset("script style noscript template iframe textarea title xmp noframes noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = frozenset("head nav footer aside form button select option svg canvas object dialog menu audio video map datalist fieldset".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_GONE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion sidebar menu navbar nav navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr notice notices notification banner popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond reply replies related recommended share sharing social footer masthead widget widgets pagination pager copyright toolbar skip".split()
)
#: A class or id of one of these names outside an article; inside, such words name parts of it.
_GONE_OUTSIDE = frozenset("header legal disclaimer topbar search form".split())
#: Words that may stand beside such a name in one class or id (`site-footer`, `menu-left`); others (`has-sidebar`, `page-share`) make it another name.
_BESIDE = frozenset("area bar block bottom box buttons container icons inner item items left links list outer panel posts right section site strip top wrap wrapper".split())
#: Elements that go even if an article stands in them: their articles are comments, teasers or menus.
_HOLDS_OTHERS = frozenset("comment comments commentlist disqus respond reply replies related recommended sidebar widget widgets".split())
#: Elements that stay if the page's article stands in them, though they would go without.
_AROUND = frozenset("form fieldset header".split())
#: Elements that may stand in a head; any other one ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
_STOP = re.compile("[>\"']")


def _gone_names(names: str, gone: frozenset[str]) -> set[str]:
    """The words of those classes and ids that are a name of `gone`, alone or with words that may stand beside it."""
    out: set[str] = set()
    for token in names.lower().split():
        words = set(_WORDS.findall(token))
        if words & gone and words <= gone | _BESIDE:
            out |= words & gone
    return out


def _zone(tag: str, attributes: str, outer: int, around: bool = False) -> int:
    """Zone of an element's content, from its own markup and the zone it stands in; around: whether an article or main stands in it."""
    spared = around and outer < ARTICLE
    if outer == DROPPED or tag in _GONE and not (spared and tag in _AROUND):
        return DROPPED
    zone = ARTICLE if tag == "article" else max(outer, MAIN) if tag == "main" else outer
    if attributes.strip():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        style = found.get("style", "").replace(" ", "").lower()
        if role in _GONE_ROLES and not (spared and role in ("form", "search")) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return DROPPED
        if tag not in ("html", "body", "article", "main"):
            names = _gone_names(f"{found.get('class', '')} {found.get('id', '')}", _GONE_NAMES if outer == ARTICLE else _GONE_NAMES | _GONE_OUTSIDE)
            if names and not (spared and not names & _HOLDS_OTHERS):
                return DROPPED
        if role in ("main", "article") or "articleBody" in found.get("itemprop", ""):
            zone = max(zone, MAIN if role == "main" else ARTICLE)
    if tag == "header" and zone < ARTICLE and not spared:
        return DROPPED
    return zone


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Behind the `>` that ends a tag whose attributes start at `at`; the first one if a quote isn't closed.

    failed holds the opening quotes from which no end was found, so that a page is not searched again and again.
    """
    seen, p = [], at
    while (m := _STOP.search(page, p)) and m.start() not in failed:
        if m[0] == ">":
            return m.end()
        seen.append(m.start())
        p = page.find(m[0], m.end()) + 1
        if not p:
            break
    failed.update(seen)
    return page.find(">", at) + 1


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks that are not dropped and not empty, in page order."""
    blocks, lost = _read_blocks(page, frozenset())
    # An article or main was dropped with an element around it: such elements are judged anew, knowing what they hold.
    return _read_blocks(page, lost)[0] if lost else blocks


def _read_blocks(page: str, around: frozenset[int]) -> tuple[list[tuple[int, str]], frozenset[int]]:
    """The blocks, and where the elements start in which an article or main is dropped; around: such elements of an earlier reading."""
    out: list[tuple[int, str]] = []
    begins: list[int] = []
    lost: set[int] = set()
    failed: set[int] = set()
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone, at, in_header = OPEN, 0, 0

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((zone, text))

    def put(text: str) -> None:
        if zone != DROPPED and (not in_header or any(t in _HEADINGS for t, _ in stack[in_header:])):
            parts.append(text)

    while True:
        m = _TAG.search(page, at)
        put(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        closing, tag = (m[1] or m[4], (m[2] or m[5] or "").lower())
        attributes = m[3] or m[6] or ""
        if m[5]:
            at = _tag_end(page, m.end(5), failed)
            attributes = page[m.end(5) : at - 1]
        if not tag:
            continue
        if tag in _BLOCK:
            close_block()
        elif tag == "br":
            put(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_block() if tag not in _BLOCK and stack[k][1] != zone else None
                    zone = stack[k][1]
                    del stack[k:], begins[k:]
                    if in_header > len(stack):
                        in_header = 0
                    break
            continue
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD:
            zone = stack.pop()[1]
            begins.pop()
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not attributes.endswith("/"):
            if zone == DROPPED and tag in ("article", "main"):
                lost.update(begins)
            inner = _zone(tag, attributes, zone, m.start() in around)
            if inner != zone:
                close_block()
            stack.append((tag, zone))
            begins.append(m.start())
            zone = inner
            if tag == "header" and zone == ARTICLE and not in_header:
                in_header = len(stack)
    close_block()
    return out, frozenset(lost)


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of the common prefix of each with the one before it), by prefix doubling up to _DEPTH tokens."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    while width < _DEPTH and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        distinct, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        levels.append(rank)
        width *= 2
        if len(distinct) == n:
            break
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        got = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            fits = np.maximum(a, b) + step <= n
            same = np.zeros(n - 1, bool)
            same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
            got[same] += step
            a[same] += step
            b[same] += step
        common[1:] = got
    return order, common


_BREAK = "\n"
_PAGES = U64(0x5DEECE66D2B5C1A3)


def stream_of(blocks: list[tuple[int, str]]) -> list[str]:
    """The tokens of the blocks outside articles, a break behind each block."""
    out = []
    for zone, text in blocks:
        if zone != ARTICLE:
            out += [*text.split(" "), _BREAK]
    return out


def _fingerprint(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _host_key(host: str) -> np.uint64:
    return U64(_fingerprint(host))


def _runs(hashes: np.ndarray, at: np.ndarray, host: np.uint64) -> np.ndarray:
    """Fingerprints, for this host, of the RUN tokens from each position on."""
    out = np.full(len(at), host, U64)
    for k in range(RUN):
        out = mix(out * U64(3) + hashes[at + k])
    return out


def passages(pages: list[list[tuple[int, str]]], host: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, index of the page, key) of passages, up to MIN_PAGES different pages for each; content names pages with equal blocks.

    One key stands for the host's pages themselves, so that their number is told like that of a passage.
    """
    contents = np.array([_fingerprint(f"{blocks}") for blocks in pages], U64).view(np.int64)
    every = _host_key(host) ^ _PAGES
    distinct = np.unique(contents, return_index=True)[1]
    first = distinct[:MIN_PAGES]
    names: dict[str, int] = {}
    flat, page = [], []
    for p in distinct.tolist():
        s = stream_of(pages[p])
        flat += [names.setdefault(t, len(names)) for t in s]
        flat.append(-1 - p)  # ends each stream with a token of its own
        page += [p] * (len(s) + 1)
    hashes = np.append(np.array([_fingerprint(t) for t in names], U64), U64(0))
    tokens, page = np.array(flat, np.int64), np.array(page, np.int64)
    order, common = suffix_array(tokens)
    left = np.diff(np.append(np.flatnonzero(tokens < 0), 0), prepend=-1)[:-1] if len(tokens) else tokens
    room = np.concatenate([np.arange(n - 1, -1, -1) for n in left]) if len(left) else left  # tokens before the stream's end
    group = np.cumsum(common < RUN)
    live = room[order] >= RUN
    order, group = order[live], group[live]
    # The first MIN_PAGES pages of each run of suffixes with equal beginnings.
    by = np.lexsort((page[order], group))
    order, group = order[by], group[by]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (page[order[1:]] != page[order[:-1]])
    order, group = order[new], group[new]
    lo, hi = segments(group)
    nth = np.arange(len(group)) - np.repeat(lo, hi - lo)
    order = order[nth < MIN_PAGES]
    keys = _runs(hashes[np.maximum(tokens, 0)], order, _host_key(host)) if len(order) else np.zeros(0, U64)
    index = np.concatenate([page[order], first]).astype(np.int64)
    return contents, index, np.concatenate([keys, np.full(len(first), every, U64)])


def repeated(contents: np.ndarray, groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, key) of the keys that MIN_PAGES different contents hold, for every group that has told of them."""
    order = np.lexsort((contents, keys))
    contents, groups, keys = contents[order], groups[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (contents[1:] != contents[:-1])
    lo, hi = segments(keys)
    many = np.add.reduceat(new.astype(np.int64), lo) >= MIN_PAGES if len(lo) else np.zeros(0, bool)
    keep = np.repeat(many, hi - lo)
    pairs = np.unique(np.stack([groups[keep].astype(np.int64).view(U64), keys[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), U64)
    return pairs[:, 0].view(np.int64), pairs[:, 1]


def _long_runs(gone: np.ndarray) -> np.ndarray:
    """A block's covered tokens without the ends of runs that only reach into it: all of them, or stretches of RUN or more."""
    if gone.all():
        return gone
    lo, hi = segments(gone)
    return np.repeat(gone[lo] & (hi - lo >= RUN), hi - lo)


def main_text(blocks: list[tuple[int, str]], host: str, boilerplate: np.ndarray) -> str:
    """The main text of a page; boilerplate: the sorted keys told for its group."""
    holds = lambda keys: boilerplate[np.minimum(np.searchsorted(boilerplate, keys), len(boilerplate) - 1)] == keys if len(boilerplate) else np.zeros(len(keys), bool)
    best = OPEN if holds(np.array([_host_key(host) ^ _PAGES])).all() else max((z for z, _ in blocks), default=OPEN)
    tokens = stream_of(blocks)
    cover = np.zeros(len(tokens), bool)
    if len(tokens) >= RUN and len(boilerplate):
        at = np.arange(len(tokens) - RUN + 1)
        step = np.zeros(len(tokens) + 1, np.int64)
        found = at[holds(_runs(np.array([_fingerprint(t) for t in tokens], U64), at, _host_key(host)))]
        np.add.at(step, found, 1)
        np.add.at(step, found + RUN, -1)
        cover = np.cumsum(step[:-1]) > 0
    lines, at = [], 0
    for zone, text in blocks:
        if zone != ARTICLE:
            n = text.count(" ") + 1
            gone = cover[at : at + n]
            at += n + 1
            if gone.any():
                gone = _long_runs(gone)
                text = " ".join(t for t, g in zip(text.split(" "), gone, strict=True) if not g)
        if zone >= best and text:
            lines.append(text)
    return "\n".join(lines)


def main_texts(pages: list[list[tuple[int, str]]], host: str = "", group: int = GROUP) -> list[str]:
    """The main text of each of a host's pages: what extract_text does, in one process."""
    told = [(contents[index], np.full(len(index), k), keys) for k in range(0, len(pages), group) for contents, index, keys in [passages(pages[k : k + group], host)]]
    groups, keys = repeated(*(np.concatenate(x) for x in zip(*told, strict=True))) if told else (np.zeros(0, np.int64), np.zeros(0, U64))
    return [main_text(blocks, host, np.sort(keys[groups == n - n % group])) for n, blocks in enumerate(pages)]


RESULT = [field("text", T.StringType()), field("n_chars", T.LongType())]
_GROUP_BITS = 32


def _read_pages(pages: DataFrame, url_col: str, html_col: str, names: list[str]) -> DataFrame:
    """Adds the host, the blocks' zones and their texts; drops the html."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            hosts = [split_url(u)[0] for u in get(url_col).to_pylist()]
            zones, texts = [], []
            for value in get(html_col):
                blocks = blocks_of(value.as_py() or "")
                zones.append(bytes(z for z, _ in blocks))
                texts.append("\n".join(t for _, t in blocks))
            return [hosts, zones, texts]

        return work

    kinds = (T.StringType(), T.BinaryType(), T.StringType())
    return with_columns(pages, [field(n, k) for n, k in zip(names, kinds, strict=True)], make).drop(html_col)


def _blocks(zones: list[bytes], texts: list[str]) -> list[list[tuple[int, str]]]:
    return [list(zip(z, b.split("\n"), strict=True)) if z else [] for z, b in zip(zones, texts, strict=True)]


def _tell(buckets: int, names: list[str]):
    """Packed passages of each group of a partition sorted by group; names: columns of group, host, zones, blocks."""

    def rows(group: int, host: str, zones: list[bytes], texts: list[str]) -> pa.RecordBatch:
        contents, index, keys = passages(_blocks(zones, texts), host)
        order = np.argsort(index, kind="stable")
        pack = (contents, np.full(len(contents), group, np.uint32), index[order], keys[order], 0)
        return pa.RecordBatch.from_pylist(list(pack_rows(pack, buckets, 8)), ROW_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, zones, texts = None, [], []
        for batch in batches:
            for group, host, z, t in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if now != (group, host):
                    if now:
                        yield rows(*now, zones, texts)
                    now, zones, texts = (group, host), [], []
                zones.append(z)
                texts.append(t)
        if now:
            yield rows(*now, zones, texts)
        give_back()

    return run


def _add_up(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replies to every group about its passages that are boilerplate; a bucket holds a few entries of each group for a passage."""
        bucket, held = None, []

        def replies() -> Iterator[pa.RecordBatch]:
            groups, keys = repeated(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(keys):
                yield found_rows(groups, np.zeros(len(groups), np.uint32), keys, targets)

        for now, _, contents, groups, keys in stream(batches, 8):
            if now != bucket and held:
                yield from replies()
                held.clear()
            bucket = now
            held.append((contents, groups.astype(np.int64), keys))
        if held:
            yield from replies()

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without html, with the main text and its number of characters."""
    n = partitions(pages.sparkSession)
    host, zones, blocks, group, codes, to, large_host, count = unused(pages, "_host", "_zones", "_blocks", "_group", "_codes", "_to", "_large", "_count")
    pages = pages.withColumn(url_col, F.col(url_col).cast("string"))
    hosts = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    large = cut(pages.groupBy(hosts.alias(large_host)).agg(F.count("*").alias(count)).where(F.col(count) > GROUP))
    # A row for each large host; broadcast only if counted to be few, else a shuffled join.
    few = large.count() <= BROADCAST_HOSTS
    read = _read_pages(pages, url_col, html_col, [host, zones, blocks])
    known = read.join(F.broadcast(large) if few else large, F.lower(host) == F.col(large_host), "left")
    # Equal rows of different input partitions go to different groups.
    slots = F.ceil(F.col(count) / GROUP)
    slot = F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)) + F.spark_partition_id(), slots), F.lit(0))
    dealt = known.withColumn(group, F.pmod(F.xxhash64(F.col(host), slot), F.lit(1 << _GROUP_BITS))).drop(large_host, count).repartition(n, group)
    # Both branches read one exchange of the pages, so the first takes all columns too.
    told = dealt.sortWithinPartitions(group, host).mapInArrow(_tell(n, [group, host, zones, blocks]), ROW).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")
    replies = gathered(told.mapInArrow(_add_up(n), FOUND)).select(F.col("id").alias(to), F.col("codes").alias(codes))
    marked = dealt.join(replies.hint("shuffle_hash"), F.col(group) == F.col(to), "left")

    def make():
        def work(batch: pa.RecordBatch) -> list:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            texts, raw, keys = [], None, np.zeros(0, U64)
            for name, page, now in zip(get(host), _blocks(get(zones), get(blocks)), get(codes), strict=True):
                if now != raw:
                    raw, keys = now, np.sort(np.frombuffer(now or b"", U64))
                texts.append(main_text(page, name, keys))
            return [texts, [len(t) for t in texts]]

        return work

    return with_columns(marked, RESULT, make).drop(host, zones, blocks, group, codes, to)
