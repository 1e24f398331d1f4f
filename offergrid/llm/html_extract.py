"""HTML extraction: a minimum cut separates main text from boilerplate."""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

#: What a page does not show as text. The annotations of a formula repeat it in another notation.
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video title textarea select".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: What an opening tag ends, as browsers do for tags that authors leave open.
ENDS = {**{t: ("p",) for t in BLOCKS - {"body", "html"}}, "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table div article section body main aside nav footer header form".split())

BAD_TAGS = frozenset("nav footer header aside menu button dialog fieldset label".split())
#: Within a line of text a label is a part of it, and so is a button that stands after other text.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption summary".split())
#: Words that tell of what readers wrote: no word of content beside them, and no length, speaks for such a text.
READERS = frozenset("comment comments disqus discussion discussions reply replies respond".split())
BAD_WORDS = READERS | frozenset("adslot adsense adsbygoogle dfp gpt outbrain taboola revcontent mgid ad ads advert advertisement adverts advertising banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget footer header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations pagination pager toolbar copyright legal disclaimer skip search form tags teaser".split())
GOOD_TAGS = frozenset("article main".split())
GOOD_WORDS = frozenset("article content entry post story body main text".split())
#: A class that begins so tells of a page's layout, not of what the element is.
LAYOUT_WORDS = frozenset("with without has no".split())
INFINITE = 1e9
#: What a boilerplate word in a class, id or role adds to the cost of keeping: in general, and where all candidates
#: for the main text stand under such words. A text of over LONG words with few links pays less.
DOUBT, SLIGHT, LONG = 8.0, 1.0, 80


class Frame:
    """An open block element: what is above it is one shared link, so that deep pages take no more room than long ones."""

    __slots__ = ("depth", "up")

    def __init__(self, up: Frame | None = None):
        self.up, self.depth = up, up.depth + 1 if up else 1


class Block:
    __slots__ = ("bad", "doubt", "form", "frame", "good", "linked", "tag", "text")

    def __init__(self, text: str, linked: int, frame: Frame, bad: bool, good: bool, tag: str, doubt: int = 0, form: bool = False):
        self.text, self.linked, self.frame, self.bad, self.good, self.tag, self.doubt, self.form = text, linked, frame, bad, good, tag, doubt, form


def named(attrs: str) -> tuple[bool, int, bool]:
    """(hidden, called boilerplate: 1, or 2 for readers' comments, called content) by the attributes of a tag.

    A name such as post-share tells of boilerplate; beside a name that only tells of content it doesn't count, unless it
    tells of readers' comments.
    """
    hidden = doubt = good = readers = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            for token in value.lower().split():
                words = [w for w in _SPLIT.split(token) if w]
                if words and words[0] in LAYOUT_WORDS:
                    continue
                if not BAD_WORDS.isdisjoint(words):
                    doubt, readers = True, readers or not READERS.isdisjoint(words)
                elif not GOOD_WORDS.isdisjoint(words):
                    good = True
    return hidden, 2 if readers else int(doubt and not good), good and not readers


class _Open(NamedTuple):
    """An open element; the flags hold for all below it."""

    tag: str
    frame: Frame
    block: bool
    bad: bool
    good: bool
    doubt: int
    form: bool


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with the innermost block element around it."""
    out: list[Block] = []
    outside = _Open("", Frame(), True, False, False, 0, False)
    stack: list[_Open] = []
    tops: list[_Open] = []
    tags: Counter = Counter()
    parts: list[str] = []
    state = {"linked": 0, "at": None}

    def flush() -> None:
        if parts:
            text, own = " ".join(html_lib.unescape("".join(parts)).split()), state["at"]
            if text and own is not None:
                out.append(Block(text, min(state["linked"], len(text)), own.frame, own.bad, own.good, own.tag, own.doubt, own.form))
            parts.clear()
        state["linked"], state["at"] = 0, None

    def add(text: str) -> None:
        if state["at"] is None:
            if not text.strip():
                return
            state["at"] = tops[-1] if tops else outside
        parts.append(text)
        if tags["a"]:
            state["linked"] += len(text.strip())

    def cut(i: int) -> None:
        """The elements from ``i`` on are closed."""
        for x in stack[i:]:
            tags[x.tag] -= 1
            if x.block:
                tops.pop()
        del stack[i:]

    def close(tag: str) -> None:
        if not tags[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                if any(x.block for x in stack[i:]):
                    flush()
                cut(i)
                return
            if tag not in BLOCKS and stack[i].tag in BARRIER:
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close(tag)
            continue
        attrs = m[3] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attrs.rstrip().endswith("/"):
                # A title that is never closed ends where the body begins.
                body = re.compile(r"<body\b", re.I).search(page, at) if tag == "title" and end is None else None
                at = end.end() if end else body.start() if body else len(page)
            continue
        if tag == "head":
            continue  # holds only RAW and VOID elements; any other one, or text, ends it, closed or not
        if tag == "br":
            add(" ") if state["at"] is not None else None
            continue
        within = tag in ("label", "button") and bool(tops) and tops[-1].tag in LINES and (tag == "label" or state["at"] is not None)
        block = (tag in BLOCKS or tag in BAD_TAGS) and not within
        if block:
            flush()
        for ended in ENDS.get(tag, ()):
            for i in range(len(stack) - 1, -1, -1) if tags[ended] else ():
                if stack[i].tag == ended:
                    cut(i)
                    break
                if stack[i].tag in BARRIER:
                    break
        if tag in VOID or attrs.rstrip().endswith("/") and not block:
            continue
        hidden, doubt, praised = named(attrs) if attrs else (False, 0, False)
        if tag in ("body", "html"):
            doubt, praised = 0, False
        under, frame = stack[-1] if stack else outside, tops[-1].frame if tops else None
        bad = under.bad or tag in BAD_TAGS and not within and not (tag == "header" and under.good) or hidden
        new = _Open(tag, Frame(frame) if block else frame or outside.frame, block, bad, under.good or tag in GOOD_TAGS or praised, max(under.doubt, doubt), under.form or tag == "form")
        stack.append(new)
        tags[tag] += 1
        if block:
            tops.append(new)
    flush()
    return out


def costs(block: Block, has_main: bool, clean: bool = True) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content): the classifier's terminal capacities.

    ``clean``: the page has main text that stands under no name of boilerplate.
    """
    if block.bad:
        return 0.0, INFINITE
    n = len(block.text.split())
    keep, drop = 0.5 + min(n, 60) / 20, 0.6
    if block.good:
        keep += 3.0
    elif has_main:
        drop += 4.0
    if re.search(r"[.!?:;,。]", block.text):
        keep += 0.5
    density = block.linked / max(1, len(block.text))
    if density > 0.6:
        drop += 3.0
    if block.doubt:
        drop += (DOUBT if clean or has_main and not block.good else SLIGHT) * (LONG / max(LONG, n) if density < 0.2 and block.doubt == 1 else 1.0)
    if block.tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        keep += 0.5
    if re.match(r"\s*(?:©|copyright\b|all rights reserved)", block.text, re.I):
        drop += 4.0
    return keep, drop


def shared(a: Frame | None, b: Frame | None) -> int:
    """How many elements two frames have in common: up from the deeper one until they meet."""
    while a is not b:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a.depth if a else 0


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(block, block, capacity): each block with the one before it, and with the last one before it in the same element.

    Either edge grows with the share of the elements above them that they have in common, so neighbours in one element hold on to each other
    twice, and paragraphs of one element hold on to each other across what stands between them. Blocks that the markup
    decides take no part.
    """
    edges, last, before = [], {}, None
    for i, b in enumerate(blocks):
        if b.bad:
            continue
        frame = b.frame.up
        for j in (before, last.get(frame)):
            if j is not None and (common := shared(blocks[j].frame, b.frame)):
                edges.append((j, i, common / max(blocks[j].frame.depth, b.frame.depth)))
        before = last[frame] = i
    return edges


def label(blocks: list[Block]) -> list[bool]:
    """True for content: the side of the source in a minimum cut.

    The source's capacity to a block is the cost of dropping it, the block's capacity to the sink that of keeping it;
    ``smoothness`` gives the edges between blocks. What stands in a form is boilerplate, unless it is more than all the rest:
    some pages are one form as a whole.
    """
    plain = [(b.form, len(b.text) - b.linked) for b in blocks if not b.bad]
    if sum(n for form, n in plain if form) <= sum(n for form, n in plain if not form):
        for b in blocks:
            b.bad = b.bad or b.form
    has_main = any(b.good and not b.bad for b in blocks)
    # Without an article the text under no such name counts if it is at least half; else the name is on the page's frame.
    sizes = [(b.doubt, len(b.text) - b.linked) for b in blocks if not b.bad]
    free, whole = sum(n for doubt, n in sizes if not doubt), sum(n for _, n in sizes)
    clean = any(b.good and not b.bad and not b.doubt for b in blocks) if has_main else 2 * free >= whole
    given = [costs(b, has_main, clean) for b in blocks]
    return minimum_cut([keep - drop for keep, drop in given], smoothness(blocks))


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of a minimum cut: ``gain`` is each node's capacity from the source, below 0 to the sink.

    A node that its own capacity decides, whatever its neighbours do, is settled first, and its edges pass into its
    neighbours' capacities; most of a page goes this way. What is left is cut by blocking flows on shortest
    paths. Ties go to the source.
    """
    n = len(gain)
    gain, out = list(gain), [True] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        near[u][v] = near[u].get(v, 0.0) + c
        near[v][u] = near[v].get(u, 0.0) + c
    hold = [sum(e.values()) for e in near]
    open_, todo = [True] * n, list(range(n))
    while todo:
        u = todo.pop()
        if not open_[u] or abs(gain[u]) < hold[u] - 1e-9 or (abs(gain[u]) <= hold[u] + 1e-9 and hold[u] > 0):
            continue
        open_[u], out[u] = False, gain[u] >= 0
        for v, c in near[u].items():
            if open_[v]:
                gain[v] += c if out[u] else -c
                hold[v] -= c
                todo.append(v)
    rest = [u for u in range(n) if open_[u]]
    at = {u: i for i, u in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    head: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    room: list[float] = []

    def arc(u: int, v: int, there: float, back: float) -> None:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for u in rest:
        if gain[u] > 0:
            arc(s, at[u], gain[u], 0.0)
        elif gain[u] < 0:
            arc(at[u], t, -gain[u], 0.0)
        for v, c in near[u].items():
            if open_[v] and u < v:
                arc(at[u], at[v], c, c)
    while True:
        depth = [-1] * (t + 1)
        depth[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > 1e-12 and depth[to[e]] < 0:
                    depth[to[e]] = depth[u] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            break
        seen, path, u = [0] * (t + 1), [], s
        while True:
            if u == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                u = to[path[first] ^ 1]
                del path[first:]
            while seen[u] < len(head[u]):
                e = head[u][seen[u]]
                if room[e] > 1e-12 and depth[to[e]] == depth[u] + 1:
                    break
                seen[u] += 1
            if seen[u] < len(head[u]):
                path.append(head[u][seen[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                seen[u] += 1
            else:
                break
    # What can still reach the sink is boilerplate.
    back, queue = {t}, deque([t])
    while queue:
        v = queue.popleft()
        for e in head[v]:
            if room[e ^ 1] > 1e-12 and to[e] not in back:
                back.add(to[e])
                queue.append(to[e])
    for u in rest:
        out[u] = at[u] not in back
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, blocks, content blocks) of one page."""
    blocks = blocks_of(page or "")
    kept = [b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep]
    return " ".join(kept), len(blocks), len(kept)


def _run(batches):
    for batch in batches:
        rows = [main_text(p) for p in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
            ["page_id", "url", "text", "n_blocks", "n_content"],
        )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks, n_content) of every row: the article without boilerplate.

    A page is cut into text blocks; the classifier's costs become capacities to the terminals, neighbourhood in page
    order and in the tree become edges, and the minimum cut labels all blocks of the page at once. Character
    references are decoded, white space inside a block becomes one space, blocks are joined by one space.

    Null and empty pages give empty text; unclosed tags, comments and cut-off pages are read as far as they go;
    repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    return given.mapInArrow(_run, "page_id long, url string, text string, n_blocks int, n_content int")
