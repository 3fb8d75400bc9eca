"""Main text of pages by wrapper induction.

The pages of a host come from a few templates. Each page's tree, with runs of like siblings as one node, is aligned with
trees of its host's layouts by simple tree matching; so the blocks of all pages fall into the slots of few trees. The
layouts are the host's most frequent trees that are unlike each other; a page belongs to the likest one. Blocks of one
element match, those with the same classes by preference. A text that stands in the same slot of most of a layout's
distinct pages, or in the first layout's slot of most of the host's, is template, a slot that varies is content. The
article's place follows from its element or, without one, from the slots that vary; what names itself as menu, header,
footer, sidebar, notice, advert, form or comments is left out; within an article only a name that says nothing else counts.

Defined results: null or empty html, and a page without an article's text, give an empty text; a host with few distinct
pages has no template and is judged by its elements alone; pages without url are a host of their own; copies of a page
count once for the template and are each extracted; whole pages are read, whatever their size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, views, without
from .dom import MUTE, Node, parse

#: A text is template if so many distinct pages of a host have it in one slot, and this share of them.
LEAST_PAGES, SHARE = 5, 0.5
#: Layouts of a host, at most, and the trees from which they are chosen; trees at least so like each other are one layout.
LAYOUTS, CANDIDATES, LIKE = 8, 32, 0.5
#: Templates are broadcast up to so many bytes; beyond, pages meet them by host, each host dealt among salts.
BROADCAST_BYTES, SALTS = 8 << 20, 32

_CHROME_TAGS = frozenset("nav footer aside form dialog menu search".split()) | MUTE
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class or id by which a block says that it isn't the article.
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget widgets related recommended recommendations share sharing social comment comments disqus reply replies respond "
    "footer masthead topbar skip hidden form search".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: Words that say how a block is built or placed, not what it is about.
_BUILD_WORDS = frozenset(
    "area articles article bar block body bottom box btn button buttons card col column container content cta desktop fixed float full global group header heading icon icons inline inner item items js label large "
    "layout left link links list main medium mobile module more news outer page panel placeholder post posts primary read result results right row secondary section site slot small sticky stories story text thread title "
    "top unit wide wrap wrapper zone".split()
)
_WORD = re.compile(r"[A-Za-z]+")


def _names(node: Node) -> frozenset[str]:
    a = node.attributes
    found = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}")) if a else []
    return frozenset(w.lower() for w in found)


def _says_so(node: Node) -> bool:
    """Whether a class, or the id, names chrome and nothing else: share-buttons does, share-price is about something."""
    a = node.attributes
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))}
        if words & _CHROME_WORDS and words <= _CHROME_WORDS | _BUILD_WORDS:
            return True
    return False


def chrome(node: Node, inside: bool) -> bool:
    """Whether a block is no part of an article; inside: it is in one already."""
    a = node.attributes
    if node.name in _CHROME_TAGS or (node.name == "header" and not inside) or (node.name == "article" and inside):
        return True
    if not a:
        return False
    if a.get("role", "").lower() in _CHROME_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if inside:
        return _says_so(node)
    names = _names(node)
    return bool(names & _CHROME_WORDS) or "header" in names


def preorder(node: Node) -> Iterator[Node]:
    """A block and all below, to any depth."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.blocks()))


def sizes(page: Node) -> dict[int, int]:
    """Characters of each block and all below, by the block's id."""
    out: dict[int, int] = {}
    for n in reversed(list(preorder(page))):
        out[id(n)] = sum(len(c) if isinstance(c, str) else out[id(c)] for c in n.children)
    return out


def article(page: Node) -> Node | None:
    """The block that holds the article by its element: the longest outermost one, and if that is a main, the one in it."""
    best, size = None, None
    while True:
        found: list[Node] = []
        stack = page.blocks()[::-1]
        while stack:
            c = stack.pop()
            if (c.name in ("article", "main") or c.attributes.get("role") in ("article", "main") or c.attributes.get("itemprop") == "articleBody") and not _names(c) & _COMMENT_WORDS:
                found.append(c)
            elif c.name not in MUTE:
                stack.extend(reversed(c.blocks()))
        if not found:
            return best
        if len(found) > 1 and size is None:
            size = sizes(page)
        best = max(found, key=lambda c: size[id(c)]) if len(found) > 1 else found[0]
        if best.name != "main" and best.attributes.get("role") != "main":
            return best
        page = best


def outline(page: Node) -> tuple[str, dict[int, int]]:
    """The page's skeleton, with runs of like neighbours as one node, and the place in it of each block (by id).

    A skeleton lists its nodes in preorder: element and classes, whether it is a run, and how many children it has.
    """
    below: list[tuple[Node, list[Node]]] = []
    waiting = [page]
    while waiting:
        n = waiting.pop()
        blocks = [c for c in n.children if not isinstance(c, str)]
        below.append((n, blocks))
        waiting += blocks
    shapes: dict[tuple, int] = {}
    shape: dict[int, int] = {}
    runs: dict[int, tuple[str, list[list]]] = {}
    for n, blocks in reversed(below):
        own: list[list] = []
        last = -1
        for c in blocks:
            if (s := shape[id(c)]) == last:
                own[-1][1] = 1
                own[-1][2].append(c)
            else:
                own.append([s, 0, [c]])
                last = s
        classes = n.attributes.get("class") if n.attributes else None
        key = ".".join([n.name, *sorted(classes.split())]) if classes else n.name
        at = id(n)
        runs[at] = key, own
        shape[at] = shapes.setdefault((key, *[(s, r) for s, r, _ in own]), len(shapes))
    out: list[tuple[str, int, int]] = []
    slots: dict[int, int] = {}
    stack: list[tuple[list[Node], int]] = [([page], 0)]
    while stack:
        blocks, run = stack.pop()
        for c in blocks:
            slots[id(c)] = len(out)
        key, children = runs[id(blocks[0])]
        out.append((key, run, len(children)))
        if len(blocks) == 1:
            stack += [(c, r) for _, r, c in reversed(children)]
        else:
            for i in range(len(children) - 1, -1, -1):
                stack.append(([c for b in blocks for c in runs[id(b)][1][i][2]], children[i][1]))
    return json.dumps(out), slots


def tree(skeleton: str) -> tuple[list[str], list[str], list[list[int]]]:
    """Of each node its key, its element and the places of its children."""
    nodes = json.loads(skeleton)
    children: list[list[int]] = [[] for _ in nodes]
    above: list[list[int]] = []
    for i, (_, _, n) in enumerate(nodes):
        if above:
            children[above[-1][0]].append(i)
            above[-1][1] -= 1
            if not above[-1][1]:
                above.pop()
        if n:
            above.append([i, n])
    return [k for k, _, _ in nodes], [k.split(".", 1)[0] for k, _, _ in nodes], children


#: What two blocks of one element count, with and without the same classes.
SAME, OTHER = 4, 1


@lru_cache(20_000)
def aligned(page: str, reference: str) -> tuple[float, tuple[int, ...]]:
    """Simple tree matching: how like the skeletons are, from 0 to 1, and for each node of the page's the reference's node,
    or -1; both in preorder."""
    (a, a_name, a_below), (b, b_name, b_below) = tree(page), tree(reference)
    #: How well two nodes match, and which children go together.
    best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    stack, seen = [(0, 0)], set()
    while stack:
        x, y = at = stack[-1]
        xs, ys = a_below[x], b_below[y]
        if at not in seen:
            seen.add(at)
            stack += [(i, j) for i in xs for j in ys if a_name[i] == b_name[j]]
            continue
        stack.pop()
        if at in best:
            continue
        m, n = len(xs), len(ys)
        w = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + (best[xs[i], ys[j]][0] if a_name[xs[i]] == b_name[ys[j]] else 0))
        i, j, pairs = m, n, []
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        best[at] = (SAME if a[x] == b[y] else OTHER) + w[m][n], pairs
    out = [-1] * len(a)
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        out[x] = y
        stack += best[x, y][1]
    return 2 * best[0, 0][0] / (SAME * (len(a) + len(b))), tuple(out)


def match(page: str, reference: str) -> tuple[int, ...]:
    return aligned(page, reference)[1]


def layouts(skeletons: list[str]) -> list[str]:
    """Of skeletons, the first to come first, those unlike all before; one without blocks only if there is no other."""
    out: list[str] = []
    for s in [x for x in skeletons if len(json.loads(x)) > 1] or skeletons[:1]:
        if len(out) < LAYOUTS and all(aligned(s, o)[0] < LIKE for o in out):
            out.append(s)
    return out


@lru_cache(20_000)
def layout(page: str, references: tuple[str, ...]) -> int:
    """The likest reference."""
    if page in references:
        return references.index(page)
    return max(range(len(references)), key=lambda k: (aligned(page, references[k])[0], -k))


def alignments(own: str, references: tuple[str, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """The page's layout and its slots there; for a page of another layout than the first also its slots in the first, as -1."""
    k = layout(own, references)
    return [(k, match(own, references[k])), *([(-1, match(own, references[0]))] if k else [])]


def text_hash(text: str) -> int:
    """64 bits that stand for a text of any length."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def slot_texts(page: Node, slots: dict[int, int], places: tuple[int, ...]) -> set[tuple[int, str]]:
    """The texts that stand in the slots of the reference."""
    found = set()
    stack = [page]
    while stack:
        n = stack.pop()
        slot = places[slots[id(n)]]
        for c in n.children:
            if isinstance(c, str):
                if slot >= 0:
                    found.add((slot, c))
            elif c.name not in MUTE:
                stack.append(c)
    return found


def extract(html: str, references: tuple[str, ...] = (), constants: frozenset[tuple[int, int, int]] = frozenset()) -> str:
    """The article's blocks, joined by an empty line. constants: layouts (-1: the first one's slots, for pages of any), slots
    and hashes of texts."""
    page = parse(html)
    fixed: dict[tuple[int, int], set[int]] = {}
    slots: dict[int, int] = {}
    places: list[tuple[int, tuple[int, ...]]] = []
    if references and constants:
        own, slots = outline(page)
        places = alignments(own, references)
        if places[0][0] == 0:
            places.append((-1, places[0][1]))
        for k, slot, h in constants:
            fixed.setdefault((k, slot), set()).add(h)
    root = article(page)
    inside = root is not None
    out: list[str] = []

    def opened(n: Node) -> tuple:
        gone = set().union(*(fixed.get((k, to[slots[id(n)]]), ()) for k, to in places)) if fixed and id(n) in slots else ()
        prose = inside or n.link * 2 < sum(len(c) for c in n.children if isinstance(c, str))
        return iter(n.children), gone, prose

    stack = [opened(root or page)]
    while stack:
        children, gone, prose = stack[-1]
        for c in children:
            if isinstance(c, str):
                if prose and not (gone and text_hash(c) in gone):
                    out.append(c)
            elif not chrome(c, inside):
                stack.append(opened(c))
                break
        else:
            stack.pop()
    return "\n\n".join(out)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """For each host with enough pages: its layouts' skeletons and the hashes of the texts that are constant in their slots.

    Every page counts. Only hashes move between tasks, and the skeletons of at most CANDIDATES pages a host; counts are added
    up before they move.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            s = [text_hash(outline(parse(str(v, "utf-8", "replace")))[0]) for v in views(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page_id"), pa.array(s, pa.int64())], names=["host", "page_id", "shape"])

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            s = [outline(parse(str(v, "utf-8", "replace")))[0] for v in views(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("shape"), b.column("n"), pa.array(s, pa.string())], names=["host", "shape", "n", "skeleton"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [layouts(x) for x in b.column("skeletons").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(own, pa.list_(pa.string()))], names=["host", "references"])

    enough = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host")
    some = pages.filter("html <> ''").select("host", "page_id", "html").mapInArrow(hashes, "host string, page_id long, shape long")
    shapes = some.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("page_id")).join(enough, "host", "left_semi")
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.xxhash64("shape"), "shape"))
    seeds = stored(shapes.withColumn("nth", nth).filter(F.col("nth") <= CANDIDATES).drop("nth"), "shapes")
    few = F.broadcast(seeds) if seeds.count() * 64 <= BROADCAST_BYTES else seeds
    met = pages.filter("html <> ''").select("host", "page_id", "html").join(few, ["host", "page_id"])
    skeletons = met.mapInArrow(outlines, "host string, shape long, n long, skeleton string").dropDuplicates(["host", "skeleton"])
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("shape").alias("lot"), "skeleton")))
    by_host = skeletons.groupBy("host").agg(order.alias("s")).select("host", F.col("s.skeleton").alias("skeletons"))
    references = stored(by_host.mapInArrow(chosen, "host string, references array<string>"), "references")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            rows: list[tuple] = []
            for h, d, r, v in zip(b.column("host").to_pylist(), b.column("digest").to_pylist(), b.column("references").to_pylist(), views(b.column("html")), strict=True):
                page = parse(str(v, "utf-8", "replace"))
                own, slots = outline(page)
                for k, places in alignments(own, tuple(r)):
                    rows += ((h, d, max(k, 0), k >= 0, s, text_hash(t)) for s, t in slot_texts(page, slots, places))
                    rows.append((h, d, max(k, 0), k >= 0, -1, 0))
            types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "digest", "layout", "own", "slot", "h"])

    met = meet(pages.select("host", "page_id", "html", F.xxhash64("html").alias("digest")), references).filter("references IS NOT NULL")
    seen = met.select("host", "digest", "references", "html").mapInArrow(texts, "host string, digest long, layout int, own boolean, slot int, h long").distinct()
    counts = seen.groupBy("host", "layout", "slot", "h").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
    counts = stored(counts.filter(F.col("n") >= LEAST_PAGES), "counts")
    total = counts.filter("slot = -1").select("host", "layout", F.col("n").alias("pages"), F.col("n_own").alias("pages_own"))
    both = counts.filter("slot >= 0").join(total, ["host", "layout"])
    fixed = both.filter((F.col("n_own") >= LEAST_PAGES) & (F.col("n_own") >= F.col("pages_own") * SHARE)).select("host", "layout", "slot", "h")
    fixed = fixed.unionByName(both.filter((F.col("layout") == 0) & (F.col("n") >= F.col("pages") * SHARE)).select("host", F.lit(-1).alias("layout"), "slot", "h"))
    return references.join(fixed.groupBy("host").agg(F.collect_list(F.struct("layout", "slot", "h")).alias("constants")), "host")


def meet(pages: DataFrame, by_host: DataFrame) -> DataFrame:
    """pages with their host's row: broadcast if it is small, else by host and salt."""
    by_host = stored(by_host, "hosts")
    columns = [c for c in by_host.columns if c != "host"]
    total = by_host.agg(F.sum(sum((F.length(F.to_json(F.struct(c))) for c in columns), F.lit(64)))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return pages.join(F.broadcast(by_host), "host", "left")
    salted = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = without(pages, ["host"]).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            out = []
            for v, r, c in zip(views(b.column("html")), b.column("references").to_pylist(), b.column("constants").to_pylist(), strict=True):
                out.append(extract(str(v, "utf-8", "replace"), tuple(r or ()), frozenset((x["layout"], x["slot"], x["h"]) for x in c or ())))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return meet(rows, templates(rows)).select("page_id", "url", "html", "references", "constants").mapInArrow(run, schema)
