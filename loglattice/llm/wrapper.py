"""Main text of web pages by wrapper induction: same-host pages are aligned, what stays is template, what varies is content.

A host's wrapper comes from a few of its pages (``seeds``: of each common outline the page with fewest nodes, as a template
has no more nodes than its smallest page). Every page is aligned with its seed by simple tree matching, the order-keeping
matching of children of equal labels that matches most nodes. A text of the seed that nearly all pages repeat where it is
matched is template; a slot that nearly all pages fill with links is a menu. Pages with the same content count once, so
an article that is copied over a host does not become its template. What a wrapper leaves is content, within the
article or main element where there is one, without elements that by HTML or by their names hold menus, notices, adverts,
forms or readers' comments.

Pages are read three times (seeds, evidence, text) and never shuffled whole: seeds and evidence are small rows, added up by host
before they meet. Seeds are broadcast if they are few bytes, else they are joined with the pages by host and salt.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.dom import INLINE, Node, Text, parse
from loglattice.llm.runtime import materialize

#: A text is template if so many pages with different content match it, and such a share of them repeat it.
LEAST_PAGES, SHARE = 5, 0.9
#: A slot is a menu if in such a share of the pages such a share of its characters is in links.
MENU_SHARE, LINK_SHARE = 0.6, 0.6
#: Seeds of a host at most: one for each class of outlines. Pages of other outlines are aligned with the one that fits best.
SEEDS = 4
#: Bytes of seeds that are broadcast; more are joined by host, busy hosts in several parts of so many pages.
BROADCAST_BYTES, PART_PAGES = 16 << 20, 20_000
#: Bytes of candidate seeds, and parsed seeds, that a task holds.
HELD_BYTES, HELD_SEEDS = 16 << 20, 128
#: Pairs of children that are compared one by one; longer lists row by row in arrays, with the same matching.
PAIRS = 1_000_000
#: Pairs of shapes, and weights of shapes with all of a list's, that a matcher remembers.
MEMO, HELD_WEIGHTS = 500_000, 1 << 22

#: Elements that never hold article text.
DROPPED = frozenset("script style noscript template head title svg iframe object embed canvas audio video form button select option optgroup textarea input fieldset label nav footer aside menu dialog datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert hidden form menu menubar toolbar".split())
#: Words in class or id of what is no article text.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner
    breadcrumb breadcrumbs comment comments commentlist respond disqus replies reply cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription paywall signup login share sharing social related recommended
    recommendations widget widgets pagination pager toolbar search copyright disclaimer feedback""".split()
)
FRAME_NAMES = frozenset("nav navbar navigation menu submenu sidebar sidenav rail footer header masthead topbar".split())
CONTENT_NAMES = frozenset("article post entry story content main articlebody page".split())
OUTLINE = frozenset("body div section article main nav aside header footer form ul ol table".split())
SLOTS = frozenset("div section ul ol table tr td center dl".split())


# --- one page ---


def is_dropped(node: Node, inside: bool) -> bool:
    """Whether HTML or its names tell that a node is no article text; ``inside`` an article, headers are the article's."""
    if node.tag in DROPPED:
        return not (node.tag in ("form", "fieldset") and _holds(node, ("article", "main", "h1")))
    if node.role in ROLES:
        return True
    if node.tag == "header" and not inside:
        return not _holds(node, ("article", "main"))
    if not node.names or node.tag in ("html", "body", "article", "main") and not _any(node.names, NAMES):
        return False
    if node.tag in ("html", "body"):
        return False
    if _any(node.names, NAMES):
        return not _holds(node, ("article", "main", "h1")) or node.tag == "article"
    if _any(node.names, FRAME_NAMES):
        if "header" in node.names and (inside or _any(node.names, CONTENT_NAMES)):
            return False
        return not _holds(node, ("article", "main"))
    return False


def _any(names: tuple[str, ...], known: frozenset) -> bool:
    return not known.isdisjoint(names)


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    """Whether one of these elements, not named otherwise itself, stands below."""
    return any(isinstance(k, Node) and ((k.tag in tags and not _any(k.names, NAMES)) or _holds(k, tags)) for k in node.kids)


def _sizes(node: Node, linked: bool = False) -> tuple[int, int, int]:
    """(characters, those in links, links) below a node, raw text of dropped elements left out."""
    chars = links = count = 0
    for k in node.kids:
        if isinstance(k, Text):
            chars += len(k.norm)
            links += len(k.norm) if linked else 0
        elif k.tag not in ("script", "style", "noscript", "template"):
            is_link = k.tag == "a"
            c, n, m = _sizes(k, linked or is_link)
            chars, links, count = chars + c, links + n, count + m + is_link
    return chars, links, count


def regions(root: Node, gone: frozenset = frozenset()) -> list[tuple[Node, bool]]:
    """The parts of a page that hold its article, each with whether it is one by HTML."""
    articles: list[Node] = []
    mains: list[Node] = []
    named: list[Node] = []

    def look(node: Node, inside: bool) -> None:
        for k in node.kids:
            if isinstance(k, Text) or id(k) in gone or is_dropped(k, inside):
                continue
            if k.tag == "article" or k.role in ("article", "articlebody"):
                articles.append(k)
                continue
            if k.tag == "main" or k.role == "main":
                mains.append(k)
            elif k.tag in SLOTS and _any(k.names, CONTENT_NAMES):
                named.append(k)
            look(k, inside or k.tag == "main")

    look(root, False)
    if articles:
        sized = [(_sizes(a), a) for a in articles]
        most = max(s[0] for s, _ in sized)
        return [(a, True) for s, a in sized if 2 * s[0] >= most and (s[0] == most or 2 * s[1] < s[0])]
    if mains:
        return [(max(mains, key=lambda x: _sizes(x)[0]), True)]
    if named:
        every = len(" ".join(blocks([(root, False)], gone)))
        inner = max(named, key=lambda x: len(" ".join(blocks([(x, False)], gone))))
        if 2 * len(" ".join(blocks([(inner, False)], gone))) >= every:
            return [(inner, False)]
    return [(root, False)]


def blocks(parts: list[tuple[Node, bool]], gone: frozenset = frozenset()) -> list[str]:
    """The text of each block in page order, white space as single spaces; nodes in ``gone`` are left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    def walk(node: Node, inside: bool) -> None:
        for k in node.kids:
            if id(k) in gone:
                continue
            if isinstance(k, Text):
                line.append(k.text)
            elif k.tag in ("br", "wbr"):
                line.append(" " if k.tag == "br" else "")
            elif is_dropped(k, inside) or (not inside and k.tag in SLOTS and _is_menu(k)):
                if k.tag not in INLINE:
                    flush()
            elif k.tag in INLINE:
                walk(k, inside)
            else:
                flush()
                walk(k, inside or k.tag in ("article", "main"))
                flush()

    for node, inside in parts:
        walk(node, inside)
        flush()
    return out


def _is_menu(node: Node) -> bool:
    chars, links, count = _sizes(node)
    return count >= 3 and links >= LINK_SHARE * chars


def page_text(root: Node, gone: frozenset = frozenset()) -> str:
    return " ".join(blocks(regions(root, gone), gone))


def outline(root: Node) -> int:
    """A hash of which frames stand where, down to three below the body; how often does not matter."""
    paths: set[str] = set()

    def look(node: Node, path: str, depth: int) -> None:
        for k in node.kids:
            if isinstance(k, Node):
                if k.tag == "html":
                    look(k, path, depth)
                elif k.tag in OUTLINE:
                    here = f"{path}>{k.label}"
                    paths.add(here)
                    if depth < 3:
                        look(k, here, depth + 1)

    look(root, "", 0)
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths))) >> 1


# --- simple tree matching ---


def _kids(node: Node) -> list:
    return [k for k in node.kids if (k.norm if isinstance(k, Text) else k.tag not in ("script", "style", "br", "wbr"))]


@dataclass
class Matcher:
    """Simple tree matching of many pages with one seed: subtrees of equal shape are compared once."""

    shapes: dict = field(default_factory=dict)
    wholes: dict = field(default_factory=dict)
    sizes: list = field(default_factory=lambda: [1])
    memo: dict = field(default_factory=dict)

    def know(self, node) -> None:
        """Number a subtree by its shape (labels alone) and as a whole (texts too)."""
        if isinstance(node, Text):
            node.shape, node.whole = 0, self.wholes.setdefault(node.norm, len(self.wholes))
            return
        kids = _kids(node)
        for k in kids:
            self.know(k)
        key = (node.label, *(k.shape for k in kids))
        shape = self.shapes.get(key)
        if shape is None:
            shape = self.shapes[key] = len(self.sizes)
            self.sizes.append(1 + sum(self.sizes[k.shape] for k in kids))
        node.shape, node.whole = shape, self.wholes.setdefault((node.label, *(k.whole for k in kids)), len(self.wholes))

    def score(self, a, b) -> int:
        """How many nodes of two subtrees match at most."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return self.sizes[a.shape]
        got = self.memo.get((a.shape, b.shape))
        if got is None:
            x, y = _kids(a), _kids(b)
            if len(x) * len(y) > PAIRS:
                got = 1 + self._most(x, y)
            else:
                row = [0] * (len(y) + 1)
                for p in x:
                    above, row = row, [0]
                    for j, q in enumerate(y):
                        w = self.score(p, q)
                        row.append(max(above[j] + w, above[j + 1], row[j]) if w else max(above[j + 1], row[j]))
                got = 1 + row[-1]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[a.shape, b.shape] = got
        return got

    def align(self, a, b) -> Iterator[tuple]:
        """Matched pairs of two subtrees whose roots match; equal texts are preferred among matchings of one size."""
        yield a, b
        if isinstance(a, Text):
            return
        x, y = _kids(a), _kids(b)
        first = 0
        while first < min(len(x), len(y)) and x[first].whole == y[first].whole:
            yield from self.align(x[first], y[first])
            first += 1
        x, y = x[first:], y[first:]
        if not x or not y:
            return
        if len(x) * len(y) > PAIRS:
            for i, j in self._pairs(x, y):
                yield from self.align(x[i], y[j])
            return
        weight = [[w and 2 * w + (p.whole == q.whole) for q in y for w in (self.score(p, q),)] for p in x]
        best = [[0] * (len(y) + 1)]
        for p in range(len(x)):
            above, row, ws = best[-1], [0], weight[p]
            for j, w in enumerate(ws):
                row.append(max(above[j] + w, above[j + 1], row[j]) if w else max(above[j + 1], row[j]))
            best.append(row)
        i, j, pairs = len(x), len(y), []
        while i and j:
            w = weight[i - 1][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        for i, j in reversed(pairs):
            yield from self.align(x[i], y[j])

    def _weigher(self, x: list, y: list, texts: bool):
        """Function from a child of ``x`` to its weights with all of ``y``: matched nodes or, with ``texts``, what ``align`` weighs."""
        first: dict[int, int] = {}
        at = np.array([first.setdefault(q.shape, len(first)) for q in y])
        shapes = {q.shape: q for q in reversed(y)}
        each = [shapes[k] for k in first]
        wholes = np.array([q.whole for q in y])
        held: dict[int, np.ndarray] = {}

        def weights(p) -> np.ndarray:
            got = held.get(p.shape)
            if got is None:
                got = np.array([self.score(p, q) for q in each], np.int32)
                if (len(held) + 1) * len(each) > HELD_WEIGHTS:
                    held.clear()
                held[p.shape] = got
            w = got[at]
            return np.where(w > 0, 2 * w + (wholes == p.whole), 0).astype(np.int32) if texts else w

        return weights

    def _most(self, x: list, y: list) -> int:
        """What ``score`` sums up over two lists of children, in the memory of one row. Equal ends match each other in some best matching."""
        lo = hi = 0
        while lo < min(len(x), len(y)) and x[lo].shape == y[lo].shape:
            lo += 1
        while hi < min(len(x), len(y)) - lo and x[-1 - hi].shape == y[-1 - hi].shape:
            hi += 1
        ends = sum(self.sizes[k.shape] for k in x[:lo]) + sum(self.sizes[k.shape] for k in x[len(x) - hi :])
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if not x or not y:
            return ends
        weights, row = self._weigher(x, y, False), np.zeros(len(y) + 1, np.int32)
        for p in x:
            row = _next_row(row, weights(p))
        return ends + int(row[-1])

    def _pairs(self, x: list, y: list) -> list[tuple[int, int]]:
        """The pairs that ``align`` takes from two lists of children: one row in about sqrt(len(x)) is kept, and those between are made again on the way back."""
        weights, row, kept = self._weigher(x, y, True), np.zeros(len(y) + 1, np.int32), []
        every = math.isqrt(len(x)) + 1
        for i, p in enumerate(x):
            if i % every == 0:
                kept.append(row)
            row = _next_row(row, weights(p))
        j, pairs = len(y), []
        for k in range(len(kept) - 1, -1, -1):
            part, best = x[k * every : (k + 1) * every], [kept.pop()]
            for p in part:
                best.append(_next_row(best[-1], weights(p)))
            i = len(part)
            while i and j:
                w = self.score(part[i - 1], y[j - 1])
                if w and best[i][j] == best[i - 1][j - 1] + 2 * w + (part[i - 1].whole == y[j - 1].whole):
                    i, j = i - 1, j - 1
                    pairs.append((k * every + i, j))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return pairs[::-1]


def _next_row(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights), out=out[1:])
    return out


class Seed:
    """A parsed seed: its nodes numbered in page order, what is known of them, and a matcher of its own."""

    def __init__(self, page: str, outline: int, constant=(), menus=()):
        self.root, self.outline, self.matcher = parse(page), outline, Matcher()
        self.matcher.know(self.root)
        self.nodes: list = []
        self._number(self.root)
        self.constant, self.menus = set(constant or ()), set(menus or ())
        self.page = page

    def _number(self, node) -> None:
        node.number = len(self.nodes)
        self.nodes.append(node)
        for k in _kids(node) if isinstance(node, Node) else ():
            self._number(k)

    def match(self, root: Node) -> list[tuple]:
        if len(self.matcher.wholes) > 200_000:  # what earlier pages left behind
            self.matcher = Matcher()
            self.matcher.know(self.root)
        self.matcher.know(root)
        return list(self.matcher.align(self.root, root))


def fitting(seeds: list[Seed], root: Node) -> tuple[int, Seed]:
    """The seed of the page's own outline, else the one that the page matches best (its share of the seed's nodes)."""
    mine = outline(root)
    for k, seed in enumerate(seeds):
        if seed.outline == mine:
            return k, seed
    if len(seeds) == 1:
        return 0, seeds[0]
    return max(enumerate(seeds), key=lambda s: (len(s[1].match(root)) / len(s[1].nodes), -s[0]))


def evidence(seed: Seed, root: Node) -> tuple[bytes, bytes, bytes]:
    """Bits by node of the seed: matched by the page, repeated by it, filled with links."""
    bits = np.zeros((3, len(seed.nodes)), np.uint8)
    for a, b in seed.match(root):
        bits[0, a.number] = 1
        if isinstance(a, Text):
            bits[1, a.number] = a.norm == b.norm
        elif a.tag in SLOTS:
            chars, links, _ = _sizes(b)
            bits[2, a.number] = chars > 0 and links >= LINK_SHARE * chars
    return tuple(np.packbits(x).tobytes() for x in bits)


def template_nodes(seed: Seed, root: Node) -> frozenset:
    """The nodes of a page (by id) that its wrapper holds for template: repeated texts where they are repeated, and menus outside articles."""
    if not seed.constant and not seed.menus:
        return frozenset()
    gone, inside = set(), set()
    for a, b in seed.match(root):
        if isinstance(a, Text):
            if a.number in seed.constant and a.norm == b.norm:
                gone.add(id(b))
        elif a.tag in ("article", "main") or a.number in inside:
            inside.update(k.number for k in _kids(a) if isinstance(k, Node))
        elif a.number in seed.menus and _sizes(b)[1] > 0 and not _holds(b, ("article", "main", "h1")):
            gone.add(id(b))
    return frozenset(gone)


# --- on Spark ---


def _candidates(rows: DataFrame) -> DataFrame:
    """(host, outline, n, nodes, page_id, html): of each task's pages of a host and outline, how many and the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def out():
            keys = list(held)
            got = list(held.values())
            return pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in keys], pa.string()), "outline": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array([g[0] for g in got], pa.int64()),
                "nodes": pa.array([g[1][0] for g in got], pa.int64()), "page": pa.array([g[1][1] for g in got], pa.string()), "html": pa.array([g[1][2] for g in got], pa.string()),
            })

        for batch in batches:
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parse(text)
                key, mine = (host, outline(root)), (_count(root), page or "", text)
                got = held.get(key)
                if got is None:
                    held[key] = [1, mine]
                    size += len(text)
                else:
                    got[0] += 1
                    if mine < got[1]:
                        size += len(text) - len(got[1][2])
                        got[1] = mine
                if size > HELD_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return rows.select("host", F.col("page").cast("string"), "html").where("host is not null and html is not null").mapInArrow(run, "host string, outline long, n long, nodes long, page string, html string")


def _count(node: Node) -> int:
    return 1 + sum(_count(k) if isinstance(k, Node) else 1 for k in node.kids)


def induce_seeds(rows: DataFrame) -> DataFrame:
    """(host, seed, outline, n, html): of each class of a host's outlines the most common one that two pages share, by its smallest page."""
    each = _candidates(rows).groupBy("host", "outline").agg(F.sum("n").alias("n"), F.min(F.struct("nodes", "page", "html")).alias("s")).where("n > 1")
    return each.groupBy("host", F.pmod("outline", F.lit(SEEDS)).cast("int").alias("seed")).agg(F.max(F.struct("n", "outline", "s.html")).alias("b"), F.sum("n").alias("pages")).select("host", "seed", "b.outline", "pages", "b.html")


def with_seeds(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each page with the seeds of its host (``seeds`` as an array in order; null without)."""
    one = seeds.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*(c for c in seeds.columns if c not in ("host", "pages"))))).alias("seeds"), F.sum("pages").alias("_pages"))
    size = seeds.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).first()["b"]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(one.drop("_pages")), "host", "left")
    parts = one.select("host", F.greatest(F.ceil(F.col("_pages") / PART_PAGES), F.lit(1)).cast("int").alias("_parts"))
    busy = parts.where("_parts > 1")  # at most pages / PART_PAGES hosts
    dealt = rows.join(F.broadcast(busy), "host", "left").withColumn("_part", F.pmod(F.xxhash64("page", "url"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = one.drop("_pages").join(parts, "host").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, ["host", "_part"], "left").drop("_part")


class _Parsed:
    """The parsed seeds of the hosts met last."""

    def __init__(self):
        self.held: OrderedDict[str, list[Seed]] = OrderedDict()

    def of(self, host: str, given: list[dict]) -> list[Seed]:
        got = self.held.get(host)
        if got is None:
            got = self.held[host] = [Seed(x["html"], x["outline"], x.get("constant"), x.get("menus")) for x in given]
            while len(self.held) > HELD_SEEDS // SEEDS:
                self.held.popitem(last=False)
        else:
            self.held.move_to_end(host)
        return got


def induce_wrappers(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds with ``constant`` and ``menus``: numbers of their nodes that are template."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = _Parsed()
        for batch in batches:
            out: list[tuple] = []
            for host, text, column in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                known = parsed.held.get(host)
                all_seeds = parsed.of(host, () if known else column.as_py())
                root = parse(text)
                k, seed = fitting(all_seeds, root)
                if text == seed.page:
                    continue  # the seed itself says nothing
                out.append((host, seed.outline, xxhash.xxh3_64_intdigest(page_text(root)) >> 1, *evidence(seed, root)))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "outline", "content", "matched", "equal", "links"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out():
            for (host, outlined), got in sums.items():
                at = np.flatnonzero(got[0])
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([outlined] * n, pa.int64()), pa.array(at, pa.int32()), *(pa.array(got[k][at], pa.int64()) for k in range(3))], names=["host", "outline", "node", "m", "e", "l"])

        held = 0
        for batch in batches:
            for host, outlined, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(3, -1), axis=1)
                got = sums.get((host, outlined))
                if got is None:
                    sums[host, outlined] = bits.astype(np.int64)
                    held += bits.size * 8
                else:
                    got += bits
                if held > HELD_BYTES:
                    yield from out()
                    sums, held = {}, 0
        yield from out()

    seen = with_seeds(rows, seeds).where("seeds is not null and html is not null").select("host", "html", "seeds").mapInArrow(observe, "host string, outline long, content long, matched binary, equal binary, links binary")
    # One page of each content: copies of an article say nothing of a template.
    once = seen.groupBy("host", "outline", "content").agg(F.min(F.struct("matched", "equal", "links")).alias("b")).select("host", "outline", "b.*")
    sums = once.mapInArrow(add_up, "host string, outline long, node int, m long, e long, l long").groupBy("host", "outline", "node").agg(F.sum("m").alias("m"), F.sum("e").alias("e"), F.sum("l").alias("l"))
    told = sums.where(F.col("m") >= LEAST_PAGES).groupBy("host", "outline").agg(
        F.sort_array(F.collect_list(F.when(F.col("e") >= SHARE * F.col("m"), F.col("node")))).alias("constant"),
        F.sort_array(F.collect_list(F.when(F.col("l") >= MENU_SHARE * F.col("m"), F.col("node")))).alias("menus"),
    )  # both at most the nodes of one page
    return seeds.join(told, ["host", "outline"], "left").select("host", "seed", "outline", "pages", "html", "constant", "menus")


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of each page, one row a row of ``pages``; n_chars in code points.

    Defined cases: a null or empty page has an empty text; without a url that names a host a page has no wrapper, and a host with fewer
    than ``LEAST_PAGES`` different pages none either, so that HTML and names alone decide there; repeated rows and null keys give
    a row each; an empty table gives no rows; other columns are left out, whatever their names.
    """
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn("host", host)
    kind = rows.schema["page"].dataType.simpleString()
    seeds = materialize(induce_seeds(rows), "wrapper-seeds")
    wrappers = materialize(induce_wrappers(rows, seeds), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = _Parsed()
        for batch in batches:
            texts = []
            for host, text, column in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                root = parse(text or "")
                gone: frozenset = frozenset()
                if host is not None and column.is_valid:
                    known = parsed.held.get(host)
                    gone = template_nodes(fitting(parsed.of(host, () if known else column.as_py()), root)[1], root)
                texts.append(page_text(root, gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page", "url", "text", "n_chars"])

    out = with_seeds(rows, wrappers).select("page", "url", "host", "html", "seeds").mapInArrow(run, f"page {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page": key, "url": url})
