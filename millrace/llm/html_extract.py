"""Main text of web pages: host suffix arrays and page structure judge each block.

A page is cut into blocks, each in a zone. "main": within <article> or <main> and not within
menus, forms, adverts, comments and the like there. "side": within such containers. "open":
neither. An <article> within such a container, as teasers are, is "main" only where there is
nothing main or open.

Every page enters its host's token streams, word by word, all blocks of it. A suffix array by induced sorting finds
the token runs that repeat on distinct pages of the host: `min_tokens` or more, or shorter blocks as wholes. A
run is boilerplate
- in open blocks, on at least MIN_PAGES pages and MIN_SHARE of the host's;
- in main blocks, where the structure speaks against it, on at least MAIN_PAGES pages and MAIN_SHARE of
  the host's. Less is no evidence there: sites show the same article twice, and articles share sentences.
The text of a page is its main blocks, or where it has none its open blocks, without boilerplate;
unique runs stay. Side blocks never are text, and serve as evidence. Exact copies of a page count
as one.

Scale: a window of `min_tokens` tokens has an anchor, the least-hashed of its GRAM-token grams, and a window on so many
pages has an anchor on as many. So pages first give the hashes of their anchors, which are counted, and only windows
with frequent anchors go on, as contexts (windows in a row that share an anchor, with their tokens). A block that
pages share goes on once, with its number of pages. A window's pages are the sum over its blocks; where
blocks of one page share a window, the page also gives the run with a negative number, so that the sum counts
it once. Contexts are sharded by anchor; those of an anchor with more than HOT contexts are compared window by window,
by the windows' hashes, so a host may fill any number of shards and so may one anchor. Pages are not shuffled:
marks on blocks that could be text are sent to all tasks, up to `max_marks` bytes, and beyond that join the pages
by row number.

Defined results: null and empty html give empty text; a null url is a host of its own; rows
that repeat an id are extracted one by one; unclosed tags end with their container (scripts, styles, titles,
text areas and frames, whose content is no markup, with the page); svg and math may close themselves; a tag
with an unclosed quote ends at its first >, and after QUOTE_FAILURES of them quotes in tags do not count; an
empty table gives an empty result; other columns are left out. Time is linear in the page.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written
from millrace.llm.suffix import suffix_array

MIN_TOKENS, GRAM, SHARD_TOKENS, HOT, QUOTE_FAILURES = 30, 8, 2_000_000, 20_000, 20
#: Bytes of marks that are sent to all tasks, and frequent anchors that are, at the most.
MAX_MARKS, MAX_ANCHORS = 16_000_000, 1_000_000
#: Host boilerplate is on so many distinct pages of its host at least, and on such a share of them.
MIN_PAGES, MIN_SHARE = 3, 0.1
MAIN_PAGES, MAIN_SHARE = 5, 0.5

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_PLAIN = re.compile(r"[^>\"']*+")
#: Elements whose content is no markup (fixed values).
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "iframe")}
_SAME = {name: re.compile(rf"</?{name}\b", re.IGNORECASE) for name in "noscript template svg object select canvas video audio".split()}
_HEAD_END = re.compile(r"(</head\s*>)|<body\b", re.IGNORECASE)
#: Fixed lists of HTML. _SKIPPED elements hold no text of the page.
_SKIPPED = frozenset(_SAME)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_INLINE_HOLDERS = frozenset(["span", "a", "button", "label", "ins"])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELF_CLOSING = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
_SIDE_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id names that tell what is no main text.
_SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager footer masthead cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup "
    "login register share sharing social related recommended comment comments commentlist disqus reply replies widget toolbar search hidden".split()
)
#: Words that go with these in the names of containers, and say nothing alone.
_NEUTRAL_WORDS = frozenset(
    "a all and app apps area article articles at author bar big block blocks body bottom box btn button buttons by card cards center col column columns container content "
    "count cta cover custom entry feed fixed float follow footer for form from global grid group head header heading holder home icon icons image images in info inline inner "
    "input item items large latest layout left like link links list lower main me menu meta mobile modern module more new news now of off on our out outer page pages panel "
    "placeholder popular post posts primary reader readers reading right row rows secondary section sections sign site slot small social sticky stories story tab tabs text "
    "thread title to tool tools top trending under unit up upper us user users v video videos view web wide wrap wrapper x you your zone".split()
)
#: Paragraphs and headings of a main zone go by class only if it is one of these.
_ADVERTS = frozenset("ad ads advert advertisement advertising sponsored".split())
_PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td".split())
#: Words that make a class of a header part of the text.
_BODY_WORDS = frozenset(["article", "content", "entry", "post", "story"])
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _names_side(value: str, prose: bool, in_main: bool) -> bool:
    """Whether a class or id names a side container: one of its names is made of side words and neutral ones."""
    for name in value.split():
        named = {w.lower() for w in _NAME_WORDS.findall(name)}
        if prose:
            if named and named <= _ADVERTS:
                return True
        elif named & _SIDE_WORDS and all(w in _SIDE_WORDS or w in _NEUTRAL_WORDS or w.isdigit() for w in named):
            return True
        elif "header" in named and not in_main and not named & _BODY_WORDS:
            return True
    return False


def _is_side(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _SIDE_TAGS or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "main") or (tag == "article" and "comment" not in attributes):
        return False
    prose = in_main and tag in _PROSE_TAGS
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if _names_side(value, prose, in_main):
                return True
        elif name == "role" and value.lower() in _SIDE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of the page's tags, in one forward scan.

    Comments, declarations and elements that are no text come with their whole extent, and no name, or
    their name with a ! before it.
    """
    last, failures, headless = page.rfind(">"), 0, False
    at = page.find("<")
    while 0 <= at < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = page.find("<", end)
            continue
        m = _NAME.match(page, at)
        if not m:
            if page[at + 1] in "!?/":
                end = page.find(">", at) + 1
                yield at, end, "", False, ""
                at = page.find("<", end)
            else:
                at = page.find("<", at + 1)
            continue
        name, closes = m[1].lower(), page[at + 1] == "/"
        end = -1 if failures >= QUOTE_FAILURES or name in _RAW else _tag_end(page, m.end())
        if end < 0:
            failures += name not in _RAW
            end = page.find(">", m.end())
        attributes, start = page[m.end() : end], at
        end += 1
        if not closes:
            if name in _RAW:
                close = _RAW[name].search(page, end)
                end, name = close.end() if close else len(page), f"!{name}"
            elif name == "head":
                close = None if headless else _HEAD_END.search(page, end)
                headless = close is None
                if close:
                    end, name = close.end() if close[1] else close.start(), "!head"
            elif name in _SKIPPED and not (attributes.endswith("/") and name in ("svg", "math")):
                other = _SAME[name].search(page, end)
                if other and page[other.start() + 1] == "/" and (stop := page.find(">", other.end())) >= 0 and not page[other.end() : stop].strip():
                    end, name = stop + 1, f"!{name}"
        yield start, end, name, closes, attributes
        at = page.find("<", end)
    # no tag ends beyond here; what the page breaks off in is none of its text
    tail = page.rfind("<")
    if tail > last and len(page) > tail + 1 and (page[tail + 1].isalpha() or page[tail + 1] in "!?/"):
        yield tail, len(page), "", False, ""


def _tag_end(page: str, at: int) -> int:
    """Where the tag's > stands, outside quotes; -1 if there is none."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at
        at = page.find(page[at], at + 1) + 1
        if not at:
            return -1


def page_blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the page's blocks in order; text has its references decoded and white space closed up."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, zone within, whether a side container other than a form is around
    depth_of: Counter[str] = Counter()
    zone, parts, seen_main = "open", [], False

    def flush() -> None:
        if parts:
            text = " ".join(html_module.unescape("".join(parts)).split())
            if text and zone != "skip":
                out.append((zone, text))
            parts.clear()

    def push(tag: str, within: str) -> None:
        nonlocal zone
        stack.append((tag, within, (bool(stack) and stack[-1][2]) or (within == "side" and tag != "form")))
        depth_of[tag] += 1
        zone = within

    def pop() -> str:
        nonlocal zone
        tag = stack.pop()[0]
        depth_of[tag] -= 1
        zone = stack[-1][1] if stack else "open"
        return tag

    at = 0
    for start, end, tag, closes, attributes in _tags(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag or tag[0] == "!":
            if tag in ("!textarea", "!select", "!head", "!title"):
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if closes:
            if depth_of[tag]:
                if not block:
                    flush()
                while pop() != tag:
                    pass
            continue
        if tag in _VOID or tag == "head" or attributes.endswith("/"):
            continue
        if tag in _SKIPPED:
            flush()
            push(tag, "skip")
            continue
        if block and stack and stack[-1][0] in _SELF_CLOSING and (stack[-1][0] == tag or stack[-1][0] == "p"):
            pop()
        is_main = tag in ("article", "main") or (attributes and re.search(r"role\s*=\s*[\"']?main", attributes, re.IGNORECASE))
        side = _is_side(tag, attributes, zone == "main")
        if side and (block or tag in _INLINE_HOLDERS):
            if not block:
                flush()
            push(tag, "form" if tag == "form" and zone == "open" else "side")
        elif tag == "article" and zone in ("side", "form", "inner") and not seen_main and stack and stack[-1][2]:
            push(tag, "inner")
        elif is_main and (zone not in ("side", "form", "inner") or not seen_main):
            seen_main = True
            push(tag, "main")
        elif block:
            push(tag, zone)
    if at < len(page):
        parts.append(page[at:])
    flush()
    zones = {z for z, _ in out}
    found = {"inner": "side", "form": "side"}
    if not zones & {"main", "open"}:  # an article within a side container, or else what stands in a form around the page
        found = {"inner": "main", "form": "side" if "inner" in zones else "open"}
    return [(found.get(z, z), t) for z, t in out]


def main_text(page: str | None) -> str:
    """The main zone; where there is none, the open blocks."""
    blocks = page_blocks(page or "")
    main = [t for z, t in blocks if z == "main"]
    return "\n".join(main or [t for z, t in blocks if z == "open"])


def _hash(*parts: str | None) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(p if p is not None else "\1" for p in parts).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


_met: dict[str, int] = {}


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts in a row, each one's text, where each text begins); a worker keeps the hashes of half a million."""
    import xxhash

    if len(_met) > 500_000:
        _met.clear()
    lists = [t.split(" ") for t in texts]
    for t in set().union(*lists):
        if t not in _met:
            _met[t] = xxhash.xxh64_intdigest(t.encode(errors="surrogatepass"))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    hashes = np.fromiter(map(_met.__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    return hashes, np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` tokens in a row, by doubling; the last step overlaps."""
    n = 1
    while n < size and len(h):
        step = min(n, size - n)
        h = _stir(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if len(h) > step else h[:0]
        n += step
    return h


def _shared_runs(blocks: set[str], width: int) -> Iterator[tuple[str, int]]:
    """(run, times too many): runs of token windows that several of a page's blocks hold, each window in one run."""
    lists = [b for b in blocks if b.count(" ") >= width - 1]
    if len(lists) < 2:
        return
    h, of, begin = _tokens(lists)
    grams = _grams(h, width)
    inside = of[: len(grams)] == of[width - 1 :]
    windows = [grams[b : b + n] for b, n in zip(begin.tolist(), np.bincount(of[: len(grams)][inside], minlength=len(lists)).tolist(), strict=True)]
    every, times = np.unique(np.concatenate([np.unique(w) for w in windows]), return_counts=True)
    if times.max() < 2:
        return
    done = np.zeros(len(every), bool)
    for text, own in zip(lists, windows, strict=True):
        which = np.searchsorted(every, own)
        first = np.zeros(len(own), bool)
        first[np.unique(which, return_index=True)[1]] = True
        take = (times[which] > 1) & first & ~done[which]
        done[which] = True
        at = np.flatnonzero(take)
        if not len(at):
            continue
        tokens = text.split(" ")
        for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(times[which[at]]) != 0)) + 1):
            yield " ".join(tokens[run[0] : run[-1] + width]), int(times[which[run[0]]]) - 1


#: Zones of blocks that could be a page's text, and what they weigh as evidence against a run.
_OPEN, _MAIN = 1, 2


def _page_streams(page: str, width: int) -> tuple[list[tuple[str, int, int]], tuple]:
    """(text, times, zones it could be text in) of each of the page's distinct blocks, and of runs that several share, with times below 0; and their tokens."""
    blocks = page_blocks(page)
    main = any(z == "main" for z, _ in blocks)
    zones: dict[str, int] = {}
    for z, t in blocks:
        zones[t] = zones.get(t, 0) | (_MAIN if z == "main" else _OPEN if z == "open" and not main else 0)
    tokens = _tokens(list(zones))
    h, of, _ = tokens
    windows = np.sort(_grams(h, width)[of[: max(0, len(h) - width + 1)] == of[width - 1 :]])
    if (windows[1:] != windows[:-1]).all():  # no window twice, so no run in several blocks
        return [(t, 1, z) for t, z in zones.items()], tokens
    times = Counter(dict.fromkeys(zones, 1))
    for run, n in _shared_runs(set(zones), width):
        times[run] -= n
    streams = [(t, n, zones.get(t, 0)) for t, n in times.items() if n or zones.get(t)]
    return streams, _tokens([t for t, *_ in streams])


def _contexts(tokens: tuple, width: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(block, first window, last window, anchor, tokens) of windows in a row that share their anchor, the leftmost gram of least hash."""
    gram = min(GRAM, width)
    h, of, begin = tokens
    n = len(h) - width + 1
    if n < 1:
        return
    g = _grams(h, gram)
    ranked = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(ranked, width - gram + 1).min(1)
    at = np.flatnonzero(of[:n] == of[width - 1 :])  # windows within one block
    if not len(at):
        return
    new = np.flatnonzero(np.concatenate([[True], (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    anchors = g[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64)
    low = begin[of[first]]
    for k, lo, hi, a, x in zip(of[first].tolist(), (first - low).tolist(), (last - low).tolist(), anchors.tolist(), first.tolist(), strict=True):
        yield k, lo, hi, a, h[x : x + hi - lo + width]


def _within(host: int, anchor: int) -> int:
    """An anchor's name in its host."""
    return (anchor * 0x2545F4914F6CDD1D + host * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)


def _count_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(host, key, copy, times, zones): a page's blocks by hash of host and text, and its anchors, each once."""
        for b in batches:
            rows = []
            for host, page, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of = _hash(host)
                streams, tokens = _page_streams(page, width)
                rows += [(of, _hash(host, t), copy, n, z) for t, n, z in streams]
                seen: dict[int, int] = defaultdict(int)
                for k, _, _, anchor, _ in _contexts(tokens, width):
                    seen[_within(of, anchor)] |= streams[k][2]
                rows += [(of, a, copy, 1, z) for a, z in seen.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "key", "copy", "times", "zones"])

    return run


def _context_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(host, key, block, start, zones, tokens): contexts under their anchors, blocks shorter than a window under themselves."""
        for b in batches:
            rows = []
            for host, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of, (streams, tokens) = _hash(host), _page_streams(page, width)
                names = [_hash(host, t) for t, _, _ in streams]
                rows += [(of, names[k], names[k], 0, z, _tokens([t])[0].tobytes()) for k, (t, _, z) in enumerate(streams) if t.count(" ") < width - 1]
                rows += [(of, _within(of, a), names[k], lo, streams[k][2], h.tobytes()) for k, lo, _, a, h in _contexts(tokens, width)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "key", "block", "start", "zones", "tokens"])

    return run


def repeated_runs(host: np.ndarray, block: np.ndarray, start: np.ndarray, pages: np.ndarray, lists: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, pages) of the token windows of each row, with the pages of their host that they are on."""
    sizes = np.array([len(x) for x in lists])
    string = np.zeros(int(sizes.sum()) + len(lists) + 1, np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    _, names = np.unique(np.concatenate(lists), return_inverse=True)
    inner = np.ones(len(string), bool)
    inner[begin + sizes] = False
    inner[-1] = False
    string[~inner] = 1
    string[inner] = names + 2
    string[-1] = 0
    sa = suffix_array(string)
    of = np.append(np.repeat(np.arange(len(lists)), sizes + 1), 0)
    at = np.arange(len(string)) - begin[of]
    short = sizes < width  # one window, the whole list
    need = np.where(short, sizes, width)
    valid = np.where(short[of], at == 0, at + width <= sizes[of])
    valid[-1] = False
    place = sa[valid[sa]]
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    # permuted common prefixes as far as a window reaches, then the same host
    same = np.ones(len(place), bool)
    same[0] = False
    length = need[of[place]]
    same[1:] &= length[1:] == length[:-1]
    for k in range(width):
        ahead = string[np.minimum(place + k, len(string) - 1)]
        same[1:] &= (ahead[1:] == ahead[:-1]) | (k >= length[1:])
    order = np.lexsort((block[of[place]], host[of[place]], np.cumsum(~same)))
    group, by_host = np.cumsum(~same)[order], host[of[place]][order]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (by_host[1:] != by_host[:-1])])
    cuts = np.flatnonzero(new)
    by_block = block[of[place]][order]
    again = np.concatenate([[False], by_block[1:] == by_block[:-1]]) & ~new  # a block counts once
    on = np.add.reduceat(np.where(again, 0.0, pages[of[place]][order]), cuts)
    c, where = of[place][order], at[place][order]
    begin_ = start[c] + where
    return c, begin_, begin_ + np.where(short[c], sizes[c], width), np.repeat(on, np.diff(np.append(cuts, len(place))))


_MARKS = "block long, start long, end long, main boolean"


def _marked(block: np.ndarray, start: np.ndarray, end: np.ndarray, on: np.ndarray, need: np.ndarray, need_main: np.ndarray, zones: np.ndarray) -> pa.RecordBatch:
    """The runs that are on so many pages as one of their block's zones asks for; main: whether that's enough in main blocks."""
    main = on > need_main - 1e-6
    hit = ((zones & _OPEN > 0) & (on > need - 1e-6)) | ((zones & _MAIN > 0) & main)
    return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (block, start, end, main)], names=["block", "start", "end", "main"])


def _mark_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            lists = [np.frombuffer(x.as_buffer(), np.int64) for x in t["tokens"]]
            host, block, start, pages, need, need_main, zones = (t[c].to_numpy() for c in ("host", "block", "start", "pages", "need", "need_main", "zones"))
            row, begin, end, on = repeated_runs(host, block, start, pages, lists, width)
            return _marked(block[row], begin, end, on, need[row], need_main[row], zones[row])

        held: list[pa.RecordBatch] = []
        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if hi > lo:
                    if held and held[-1].column(0)[0].as_py() != int(shard[lo]):
                        yield marks(held)
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield marks(held)

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts to their windows: the row, the window's place, and its 128-bit hash with the host."""
        for b in batches:
            rows, places, digests = [], [], []
            for i, (host, start, tokens) in enumerate(zip(b.column("host").to_pylist(), b.column("start").to_pylist(), b.column("tokens"), strict=True)):
                data, of = memoryview(tokens.as_buffer()), host.to_bytes(8, "little", signed=True)
                for at in range(max(1, len(data) // 8 - width + 1)):
                    rows.append(i)
                    places.append(start + at)
                    digests.append(hashlib.blake2b(data[8 * at : 8 * (at + width)], digest_size=16, key=of).digest())
            names = ["block", "pages", "need", "need_main", "zones"]
            kept = [b.column(c).take(pa.array(rows, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int64()), pa.array(digests, pa.binary())], names=[*names, "start", "window"])

    return run


def _by_windows(hot: DataFrame, width: int) -> DataFrame:
    """Marks of contexts whose anchor has very many, by the sums over equal windows."""
    each = hot.mapInArrow(_window_rows(width), "block long, pages double, need double, need_main double, zones int, start long, window binary")
    each = written(each, "windows")
    on = each.select("window", "block", "pages").distinct().groupBy("window").agg(F.sum("pages").alias("on"))
    main = F.col("on") > F.col("need_main") - 1e-6
    hit = (F.col("zones").bitwiseAND(_OPEN) > 0) & (F.col("on") > F.col("need") - 1e-6) | (F.col("zones").bitwiseAND(_MAIN) > 0) & main
    return each.join(on, "window").where(hit).select("block", "start", (F.col("start") + width).alias("end"), main.alias("main"))


def host_boilerplate(pages: DataFrame, width: int = MIN_TOKENS, shard_tokens: int = SHARD_TOKENS, hot: int = HOT, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """(block, runs: array of start, end, main): for blocks of (_host, _html) that could be text, by hash of host and text, the token runs their host repeats."""
    pages = pages.select("_host", "_html", F.xxhash64("_host", "_html").alias("_copy"))
    seen = pages.mapInArrow(_count_rows(width), "host long, key long, copy long, times int, zones int")
    # copies of a page have the same blocks, and count once
    once = seen.groupBy("host", "key", "copy").agg(F.first("times").alias("times"), F.first("zones").alias("zones"))
    counted = once.groupBy("host", "key").agg(F.sum("times").cast("double").alias("pages"), F.bit_or("zones").alias("zones"))
    need = lambda n, share: F.greatest(F.lit(float(n)), share * F.count("*"))
    hosts = pages.select("_host", "_copy").mapInArrow(_host_rows, "host long, copy long").distinct().groupBy("host").agg(need(MIN_PAGES, MIN_SHARE).alias("need"), need(MAIN_PAGES, MAIN_SHARE).alias("need_main"))
    hosts = written(hosts, "hosts")
    counted = written(counted, "counts")
    common = counted.where(F.col("pages") > min(MIN_PAGES, MAIN_PAGES) - 0.5).join(hosts, "host")
    enough = (F.col("zones").bitwiseAND(_OPEN) > 0) & (F.col("pages") > F.col("need") - 1e-6) | (F.col("zones").bitwiseAND(_MAIN) > 0) & (F.col("pages") > F.col("need_main") - 1e-6)
    frequent = written(common.where(enough).select("key"), "anchors")
    n = frequent.count()
    if not n:
        return pages.sparkSession.createDataFrame([], "block long, runs array<struct<start:bigint,end:bigint,main:boolean>>")
    met = pages.select("_host", "_html").mapInArrow(_context_rows(width), "host long, key long, block long, start long, zones int, tokens binary")
    met = met.join(F.broadcast(frequent) if n <= max_anchors else frequent, "key", "left_semi")
    alike = met.groupBy("host", "key", "block", "start").agg(F.bit_or("zones").alias("zones"), F.first("tokens").alias("tokens"))
    numbers = counted.select(F.col("key").alias("block"), "pages")
    distinct = written(alike.join(numbers, "block").join(hosts, "host"), "contexts")
    crowded = written(distinct.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot-anchors")
    total = distinct.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    shards = max(1, -(-total // (8 * shard_tokens)))
    columns = ["host", "block", "start", "pages", "need", "need_main", "zones", "tokens"]
    rows = distinct.join(crowded, "key", "left_anti").select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), *columns)
    found = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_mark_rows(width), _MARKS)
    if not crowded.isEmpty():
        found = found.unionByName(_by_windows(distinct.join(crowded, "key", "left_semi").select(columns), width))
    return found.groupBy("block").agg(F.collect_set(F.struct("start", "end", "main")).alias("runs"))


def _host_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's host by its hash, and the page's."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_hash(h) for h in b.column(0).to_pylist()], pa.int64()), b.column(1)], names=["host", "copy"])


def _text(host: str | None, page: str, runs_of: dict[int, list]) -> str:
    """The page's main blocks, or its open ones, without the marked runs."""
    blocks = page_blocks(page)
    zone = "main" if any(z == "main" for z, _ in blocks) else "open"
    out = []
    for z, text in blocks:
        if z != zone:
            continue
        runs = runs_of.get(_hash(host, text)) if runs_of else None
        if runs:
            tokens = text.split(" ")
            for start, end, main in runs:
                if main or zone == "open":
                    tokens[start:end] = [""] * (end - start)
            text = " ".join(t for t in tokens if t)
        if text:
            out.append(text)
    return "\n".join(out)


def _runs(marks: list[dict]) -> dict[int, list]:
    return {m["block"]: [(r["start"], r["end"], r["main"]) for r in m["runs"]] for m in marks}


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", width: int = MIN_TOKENS, max_marks: int = MAX_MARKS) -> DataFrame:
    """(key, url, text) of every row."""
    kind = pages.schema[key].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    whole = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    schema = f"{key} {kind}, {url} string, text string"
    marks = written(host_boilerplate(whole, width), "marks")
    # a run takes 24 bytes, a block 16
    if (marks.agg(F.sum(24 * F.size("runs") + 16)).first()[0] or 0) <= max_marks:
        runs_of = _runs([r.asDict(recursive=True) for r in marks.collect()])

        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [_text(h, x, runs_of) for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=[key, url, "text"])

        return whole.mapInArrow(texts, schema)

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(row, _hash(h, t)) for row, h, x in zip(*(c.to_pylist() for c in b.columns), strict=True) for z, t in page_blocks(x) if z != "side"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["_row", "block"])

    def marked_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_text(h, x, _runs(m or [])) for h, x, m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=[key, url, "text"])

    # row numbers are written down with the rows: another scan might split its input otherwise
    rows = written(whole.withColumn("_row", F.monotonically_increasing_id()), "pages")
    on = rows.select("_row", "_host", "_html").mapInArrow(block_rows, "_row long, block long").distinct().join(marks, "block")
    by_row = on.groupBy("_row").agg(F.collect_list(F.struct("block", "runs")).alias("_marks"))
    return rows.join(by_row, "_row", "left").select("_key", "_url", "_host", "_html", "_marks").mapInArrow(marked_texts, schema)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
