"""HTML extraction: repeated runs of a host's pages, by suffix array, with the page's own structure.

Pages are cut into blocks of text and grouped by host; a host of many pages is dealt over
groups of about `group_pages` or `group_bytes`, so no task holds an unbounded host. The words of a group's
blocks, page after page, form one token stream. A suffix array of the stream, ordered to a
depth of `min_tokens` by prefix doubling, puts equal runs next to each other; runs that two
or more distinct contents have are covered, and a block whose every word is covered is
boilerplate. Blocks with words of their own stay whole. A content is what a page's blocks say,
so a page served at several urls is one content and doesn't erase itself.

The groups of a dealt host also learn which of their runs other groups have. A content that
several groups hold counts in the first of them alone. Each group sends the first bits of the
hashes of its distinct runs, with the number of contents that count for each (0, 1, or 2 for
more), to hash buckets, which answer with a bit for each, set where two contents have it; of
these alone it then sends the whole hashes, and those answered with a set bit are covered as
well. So how a host is dealt changes no result.

Structure then has the last word. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments go, by element, role, class or id, however rare their
text; what stands in the page's article (or main) element stays, however often it repeats,
as pages may share passages. So the runs decide for pages that mark no article.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import saved
from .wordcols import BLANK, Words, pack, unpack, windows

GROUP_PAGES = 256
MIN_TOKENS = 8
BUCKET_BYTES = 4 << 20

# Elements by what they do to the text around and inside them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROPPED = frozenset("aside button datalist dialog footer form head header menu nav noscript object search select template".split())
CONTENT = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# What parts of a class or id say of an element.
# boilerplate wherever it stands in a name, or as the beginning of a part of it
BOILERPLATE = frozenset("ad ads adv breadcrumb breadcrumbs consent cookie cookies disqus footer gdpr menu menus nav navbar navs newsletter pagination popup popups promo promos respond share shares sharing sidebar sidebars signup social sponsor subscribe toolbar".split())
BEGINNINGS = ("advert", "comment", "navig", "newsletter", "sharebar", "sponsored", "subscri")
# boilerplate but for names that speak of the article or its parts: site-header and page-notice, not entry-header
PERHAPS = frozenset("banner header masthead modal notice notices notification notifications related skip widget widgets".split())
OF_ARTICLES = frozenset("article board body caption chapter content copy entry figure hero image main paragraph photo post section story table text title work works".split())
# what turns a name into a label of a subject, or into the state of another element
LABELS = frozenset("cat category commentary format market policy price science security study tag theme topic type".split())
STATES = frozenset("free has have hide hides no non not show shows with without".split())
GROUP_BYTES = 16 << 20

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _name_says(value: str) -> str | None:
    """What a class or id says that its element is: "comments", "other" boilerplate, or nothing.

    Names are read part by part: comment-list, siteHeader and ad_slot_2 are boilerplate;
    no-sidebar, topic-social, entry-header and commentary aren't.
    """
    said = None
    for token in value.split():
        parts = {p.lower() for p in _NAME_PART.findall(token)}
        if not parts or not STATES.isdisjoint(parts) or not LABELS.isdisjoint(parts):
            continue
        if any(p.startswith("comment") for p in parts) or not parts.isdisjoint(("disqus", "respond")):
            return "comments"
        if not BOILERPLATE.isdisjoint(parts) or any(p.startswith(BEGINNINGS) for p in parts) or not PERHAPS.isdisjoint(parts) and OF_ARTICLES.isdisjoint(parts):
            said = "other"
    return said


def _drops(name: str, attrs: str) -> int:
    """4 if the element goes, 2 if it goes as comments by its class or id alone, 1 if as other boilerplate, else 0."""
    if name in DROPPED:
        return 4
    if not attrs or not attrs.strip(" /\n\t\r"):
        return 0
    named = 0
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            if name not in ("html", "body") and (said := _name_says(value)):
                named = max(named, 2 if said == "comments" else 1)
        elif key == "role" and value.strip().lower() in DROPPED_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 4
    return named


def page_blocks(page: str | None, keep_around: bool = False) -> list[tuple[str, bool, bool]]:
    """(text, dropped by structure, inside the article) of each block with text, in page order.

    No class or id drops an article or main element, unless it is inside another or names
    comments. keep_around: nor what is around one, or one of comments, which is so where the
    page would have no article left otherwise. Time is linear in the page, whatever it holds.
    """
    out: list[tuple[str, bool, bool]] = []
    if not page:
        return out
    stack: list[tuple[str, int, bool]] = []  # name, drops, article
    kept: list[str] = []
    lost: list[str] = []
    blocks_at: list[int] = []  # places in the stack of elements that are blocks
    opened: Counter[str] = Counter()
    dropping = inside = named = 0
    was_inside = missed = False

    def flush() -> None:
        for parts, dropped in ((kept, False), (lost, True)):
            if parts:
                text = "".join(parts)
                if "&" in text:
                    text = html.unescape(text)
                text = " ".join(text.split())
                if text:
                    out.append((text, dropped, was_inside))
                parts.clear()

    def close(to: int) -> None:
        nonlocal dropping, inside, named
        while len(stack) > to:
            name, d, c = stack.pop()
            opened[name] -= 1
            dropping -= d > 0
            named -= 0 < d < 4
            inside -= c
        while blocks_at and blocks_at[-1] >= to:
            blocks_at.pop()

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            was_inside = inside > 0
            (lost if dropping else kept).append(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            (lost if dropping else kept).append(" ")
        if m["close"] or m["close2"]:
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in RAW:  # its content is not text of the page
            tail = re.compile(rf"</{re.escape(name)}\s*/?>", re.IGNORECASE).search(page, at)
            at = tail.end() if tail else end
            continue
        if name in VOID:
            continue
        if block:
            # an open paragraph, list item or cell ends where its like (or any block, for p) begins
            ends = ("p",) if name not in ("li", "dd", "dt", "td", "th", "tr", "option") else ("p", name, *(("dd", "dt") if name in ("dd", "dt") else ()), *(("td", "th") if name in ("td", "th", "tr") else ()))
            if blocks_at and stack[blocks_at[-1]][0] in ends:
                close(blocks_at[-1])
        attrs = m["attrs"] or m["attrs2"] or ""
        d, c = _drops(name, attrs), name in CONTENT
        if c:
            if d == 1 and not inside or d == 2 and keep_around:
                d = 0
            if keep_around and named:
                dropping -= named
                named = 0
                stack = [(x[0], x[1] & 4, x[2]) for x in stack]
            missed |= dropping > 0 or d == 2
        if block:
            blocks_at.append(len(stack))
        opened[name] += 1
        stack.append((name, d, c and not dropping and not d))
        dropping += d > 0
        named += 0 < d < 4
        inside += stack[-1][2]
    flush()
    if missed and not keep_around and not any(b[2] and not b[1] for b in out):
        return page_blocks(page, True)
    return out


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, content: np.ndarray, depth: int) -> np.ndarray:
    """True for tokens covered by a run of depth tokens, within a page, that a page of another content also has.

    rank[i] orders the suffixes by their first `reach` tokens; each round doubles the reach,
    the last one only up to depth.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < depth:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        reach += step
    start = np.arange(n - depth + 1)
    start = start[page[start] == page[start + depth - 1]]
    array = start[np.lexsort((content[start], rank[start]))]  # the suffix array, to this depth
    first = np.ones(len(array), bool)
    first[1:] = rank[array[1:]] != rank[array[:-1]]
    run = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(array)) - 1
    several = content[array[heads]] != content[array[tails]] if len(array) else np.zeros(0, bool)
    hits = array[several[run]] if len(array) else array
    return covered_by(hits, n, depth)


def covered_by(starts: np.ndarray, n: int, depth: int) -> np.ndarray:
    """True for those of n tokens that runs of depth tokens from these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth, -1)
    return np.cumsum(edge)[:n] > 0


_PARSED = "page_id {kind}, url string, host string, part int, bits int, buckets int, texts binary, marks binary"
_ASKED = "host string, bucket int, part int, blob binary"
_TOLD = "host string, part int, level int, bucket int, known binary"  # level 0: a content that counts elsewhere
_ROW = "page_id {kind}, url string, text string, n_chars long, n_blocks int, n_repeated int"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their blocks: the texts, compressed, and a byte each, 1 where structure drops it and 2 inside the article."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            blocks = [page_blocks(p) for p in part["html"].to_pylist()]
            texts = pa.array([zlib.compress("\n".join(b[0] for b in p).encode()) for p in blocks], pa.binary())
            marks = pa.array([bytes(b[1] | b[2] << 1 for b in p) for p in blocks], pa.binary())
            names = ["page_id", "url", "host", "part", "bits", "buckets"]
            yield pa.record_batch([*(part[c] for c in names), texts, marks], names=[*names, "texts", "marks"])


def _contents(texts: list[bytes]) -> np.ndarray:
    """A 64-bit hash of what each page says."""
    return np.array([int.from_bytes(blake2b(t, digest_size=8).digest(), "little") for t in texts], np.uint64)


def _held(table: pa.Table) -> pa.Table:
    """The distinct contents of a group of a dealt host."""
    names = np.unique(_contents([zlib.decompress(b) for b in table["texts"].to_pylist()])) if table["bits"][0].as_py() is not None else np.zeros(0, np.uint64)
    one = lambda c, kind: pa.array([table[c][0].as_py()] * len(names), kind)
    return pa.table({"host": one("host", pa.string()), "part": one("part", pa.int32()), "known": pa.array([n.tobytes() for n in names], pa.binary())})


class _Group:
    """The word stream of a group's pages, and its runs of depth words.

    content numbers the distinct contents; counts has 1 for each, or 0 where told says that it counts elsewhere.
    """

    def __init__(self, table: pa.Table, depth: int, told: pa.Table):
        self.depth = depth
        # blocks are never empty and have no line ends
        texts = [zlib.decompress(b) for b in table["texts"].to_pylist()]
        names, number = np.unique(_contents(texts), return_inverse=True)
        elsewhere = [k for level, k in zip(told["level"].to_pylist(), told["known"].to_pylist(), strict=True) if level == 0]
        self.counts = (~np.isin(names, np.frombuffer(b"".join(elsewhere), np.uint64))).astype(np.int64)
        self.texts = [t.decode().split("\n") if t else [] for t in texts]
        self.words = Words(pa.array([t for page in self.texts for t in page], pa.string()), separators=BLANK, lower=False)
        self.hashes = self.words.hashes()
        self.page = np.repeat(np.repeat(np.arange(len(self.texts)), [len(t) for t in self.texts]), self.words.counts)
        self.content = number[self.page]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run within a page."""
        values = windows(self.hashes, self.depth)
        at = np.arange(len(values))
        at = at[self.page[at] == self.page[at + self.depth - 1]]
        return values[at], at

    def distinct(self, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Distinct first bits of the hashes of runs, ascending, and how many contents that count here have each, 2 for more."""
        values, at = self.runs()
        if not len(values):
            return values, np.zeros(0, np.uint8)
        values, content = _coarse(values, bits), self.content[at]
        order = np.lexsort((content, values))
        values, content = values[order], content[order]
        new = np.append(True, values[1:] != values[:-1])
        once = new | np.append(True, content[1:] != content[:-1])  # a content counts once a value
        return values[new], np.minimum(np.add.reduceat(np.where(once, self.counts[content], 0), np.flatnonzero(new)), 2).astype(np.uint8)


def _coarse(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits)


def _asked(table: pa.Table, values: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """A row for each bucket that gets some of the values, which are ascending and of so many bits."""
    n = table["buckets"][0].as_py()
    edges = np.array([(b << bits) // n for b in range(1, n)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
    full = np.flatnonzero(np.diff(cut))
    return pa.table({
        "host": pa.array([table["host"][0].as_py()] * len(full), pa.string()),
        "bucket": pa.array(full, pa.int32()),
        "part": pa.array([table["part"][0].as_py()] * len(full), pa.int32()),
        "blob": pa.array([pack(values[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
    })


_NOTHING = pa.schema([("host", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())]).empty_table()


def _coarse_asked(depth: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or (bits := left["bits"][0].as_py()) is None:
            return _NOTHING
        return _asked(left, *_Group(left, depth, right).distinct(bits), bits)

    return run


def _told(level: int):
    def run(table: pa.Table) -> pa.Table:
        """For each part: a bit for each value it sent, set where two contents of the host or more have it."""
        got = [unpack(b.as_py(), "u8", "u1") for b in table["blob"]]
        cuts = np.cumsum([len(g[0]) for g in got])[:-1]
        _, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        twice = np.split((np.bincount(inverse, weights=np.concatenate([g[1] for g in got])) > 1)[inverse], cuts)
        known = pa.array([zlib.compress(np.packbits(t).tobytes()) + bytes([-len(t) % 8]) for t in twice], pa.binary())
        return pa.table({"host": table["host"], "part": table["part"], "level": pa.array([level] * len(got), pa.int32()), "bucket": table["bucket"], "known": known})

    return run


def _known(told: pa.Table, level: int) -> np.ndarray:
    """The bits told at a level, in the order in which the values were sent."""
    rows = sorted((b, k) for x, b, k in zip(*(told[c].to_pylist() for c in ("level", "bucket", "known")), strict=True) if x == level)
    bits = [np.unpackbits(np.frombuffer(zlib.decompress(k[:-1]), np.uint8)) for _, k in rows]
    return np.concatenate([np.zeros(0, bool), *(b[: len(b) - k[-1]].astype(bool) for b, (_, k) in zip(bits, rows, strict=True))])


def _candidates(group: _Group, told: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs that other contents of the host may have too, and their counts here."""
    values, counts = group.distinct()
    coarse = _coarse(values, bits)
    may = _known(told, 1)[np.searchsorted(np.unique(coarse), coarse)]
    return values[may], counts[may]


def _exact_asked(depth: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or (bits := left["bits"][0].as_py()) is None:
            return _NOTHING
        return _asked(left, *_candidates(_Group(left, depth, right), right, bits), 64)

    return run


def _extracted(depth: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        group = _Group(table, depth, told)
        covered = repeated_tokens(group.hashes, group.page, group.content, depth)
        if (bits := table["bits"][0].as_py()) is not None:
            known = _candidates(group, told, bits)[0][_known(told, 2)]
            values, at = group.runs()
            covered |= covered_by(at[np.isin(values, known)], len(covered), depth)
        total = np.concatenate([[0], np.cumsum(covered)])
        words = group.words
        repeated = total[words.first[1:]] - total[words.first[:-1]] == words.counts
        texts_out, counts, at = [], [], 0
        for texts, marks in zip(group.texts, table["marks"].to_pylist(), strict=True):
            marked = 2 in marks
            texts_out.append("\n".join(t for k, t in enumerate(texts) if not marks[k] & 1 and (marks[k] & 2 if marked else not repeated[at + k])))
            counts.append(int(repeated[at : at + len(texts)].sum()))
            at += len(texts)
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts_out, pa.string()), "n_chars": pa.array([len(t) for t in texts_out], pa.int64()), "n_blocks": pa.array([len(t) for t in group.texts], pa.int32()), "n_repeated": pa.array(counts, pa.int32())})

    return run


def extract_main_text(
    pages: DataFrame,
    *,
    group_pages: int = GROUP_PAGES,
    group_bytes: int = GROUP_BYTES,
    min_tokens: int = MIN_TOKENS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_repeated) for each row of pages(page_id, url, html).

    text      blocks of the main text in page order, joined by one newline; empty if none
    n_chars   its code points; n_blocks: blocks of the page; n_repeated: those that repeat

    Null or empty html has no text. Null urls, and urls without a host, form a host of their
    own. Pages of one host that say the same are one content: they don't make each other
    boilerplate. The key may be null or repeat; other columns are ignored; an empty table
    gives an empty result. group_pages and group_bytes (of html, beyond twice which a host is
    dealt) and bucket_bytes (of html, whose run hashes one task compares; up to 16 times that
    on the largest hosts) change no result.
    """
    ship_package(pages.sparkSession)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")))
    pages = pages.withColumn("host", host)
    counts = pages.groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).filter((F.col("n") > 2 * group_pages) | (F.col("b") > 2 * group_bytes))
    hot = counts.select(
        "host",
        F.greatest(F.ceil(F.col("n") / group_pages), F.ceil(F.col("b") / group_bytes)).cast("int").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.col("b") / F.greatest(F.lit(bucket_bytes), F.least(F.lit(16 * bucket_bytes), F.col("b") / 64)))).cast("int").alias("buckets"),
        # bits that tell most of the host's runs apart
        F.least(F.lit(60), F.greatest(F.lit(16), F.ceil(F.log2(F.col("b") + 1)) + 3)).cast("int").alias("bits"),
    )
    hot = saved(hot, "hot-hosts")  # stored, so Spark knows its size and broadcasts it only below its threshold

    dealt = pages.join(hot, "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(0)).cast("int"))
    dealt = dealt.select("page_id", "url", "host", "part", "bits", "buckets", "html").mapInArrow(_parsed, _PARSED.format(kind=kind))
    groups = dealt.groupBy("host", "part")
    # a content that several parts hold counts in the first
    held = groups.applyInArrow(_held, "host string, part int, known binary")
    homes = held.groupBy("host", "known").agg(F.min("part").alias("home"), F.count("*").alias("n")).filter("n > 1").select("host", "known", "home")
    elsewhere = held.join(homes, ["host", "known"]).filter("part <> home").select("host", "part", F.lit(0).alias("level"), F.lit(0).alias("bucket"), "known")
    first = groups.cogroup(elsewhere.groupBy("host", "part")).applyInArrow(_coarse_asked(min_tokens), _ASKED).groupBy("host", "bucket").applyInArrow(_told(1), _TOLD)
    asked = groups.cogroup(elsewhere.union(first).groupBy("host", "part")).applyInArrow(_exact_asked(min_tokens), _ASKED)
    second = asked.groupBy("host", "bucket").applyInArrow(_told(2), _TOLD)
    return groups.cogroup(first.union(second).groupBy("host", "part")).applyInArrow(_extracted(min_tokens), _ROW.format(kind=kind))
