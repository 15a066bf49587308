"""Main text of web pages by wrapper induction.

Pages of a host are of one layout if the frames that hold them are the same. Every layout of enough pages
has a seed, a page of its commonest size that has text; pages of rare layouts take the best matching of the
host's first seeds. Every page is parsed and aligned with its seed by simple tree matching: two nodes match if their labels (tag, class, id) are equal, and
an alignment of their children, in order, is worth the most matched nodes, equal texts counting more.
Equal siblings are aligned one by one. Spark then counts, for each node of a seed, on how
many pages it was met and on how many with the seed's own text. Equal pages count
once. Nodes met with the same text throughout
are the host's template; what stands in the other slots is content.

HTML names many parts itself: menus, headers, footers, sidebars, adverts, notices, forms and comments are
no content, unless they wrap the page's article or most of its text. Inside an article names that content
may bear too (notice, share, widget ...) are outvoted by a slot whose text varies from page to page. What
an article holds needs more to be template: the same text on most pages of the host, copies not counted.

A page's blocks are written to the shared folder with the number of the seed's node they were aligned with,
and the template is applied to them by a join on host and layout.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, materialise, shared_folder
from formspark.llm.html_tree import BLOCK, Node, tree

CONSTANT = 0.9          # share of the pages that met a node, from which its text is template
LEAST_PAGES = 3         # pages on which a node must be met to be judged
LEAST_INSIDE = 4        # pages unlike the seed on which a node inside an article must be met to be judged
COMMON = 0.5            # share of all pages unlike the seed that must show the text of such a node
COPY = 0.75             # a page is a copy of the seed if more than this share of its article is the same
FURTHER = 3             # seeds of a host that pages are aligned with whose own layout has none
SAME = 8                # what an equal text adds to the worth of a matched leaf
CELLS = 40_000          # longer lists of siblings are cut at equal members before they are matched
WINDOW = 200
SEED_BYTES = 32 << 20   # seeds up to this size are broadcast, more are joined
NEVER = frozenset("head title script style noscript template iframe object svg canvas math audio video map datalist".split())
SKIPPED = frozenset("nav footer aside form button select option textarea input label dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
MAYBE_ROLES = frozenset("alert status note form".split())
PARTS = frozenset("nav navbar navigation submenu breadcrumb breadcrumbs footer ad ads adv advert adverts advertisement advertising adsense promo sponsor sponsored cookie cookies gdpr related "
                  "recommended comment comments commentlist disqus reply replies respond pagination pager".split())
#: Names that content may bear as well: what a page says under them inside its article is judged by the counts.
MAYBE = frozenset("menu header masthead topbar sidebar aside banner consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing "
                  "widget toolbar skip copyright hidden".split())
PLACES = frozenset("site page main global primary secondary top bottom left right bar box block list links area wrapper container".split())
FRAME = frozenset("div section article main header nav footer aside form table center".split())
STRONG, WEAK = 2, 1
FREE, INSIDE, NAMED = 0, 1, 2
CONTENT = frozenset(("article", "main"))
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """What lies below each element: characters of text, and how many of them in an article or main element."""

    def __init__(self, root: Node) -> None:
        self.root, self.sizes = root, {}
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(k for k in node.kids if isinstance(k, Node) and k.tag not in NEVER)
        for node in reversed(order):
            said = [len(k.strip()) if isinstance(k, str) else self.sizes.get(id(k), (0, 0))[0] for k in node.kids]
            total = sum(said)
            marked = total if node.tag in CONTENT and not named(node, False) else sum(self.sizes.get(id(k), (0, 0))[1] for k in node.kids if isinstance(k, Node))
            self.sizes[id(node)] = total, marked

    def exempt(self, node: Node, inside: bool, name: int) -> bool:
        """Whether a named element wraps what the page is about: most of its articles, or else most of its text."""
        total, marked = self.sizes[id(node)]
        all_said, all_marked = self.sizes[id(self.root)]
        if all_marked:
            return not inside and 0 < all_marked <= 2 * marked or inside and name == WEAK and 2 * total > all_marked
        return name == WEAK and 2 * total > all_said


def words_of(value: str) -> Iterator[set[str]]:
    """The words of each class or id."""
    for token in value.split():
        yield {w.lower() for w in WORD.findall(CAMEL.sub(" ", token))}


def named(node: Node, inside: bool) -> int:
    """Whether HTML itself names the node as no content: ``STRONG``, ``WEAK`` if content may bear the name, or 0.

    A class or id counts as a whole: 'notice', 'cookie-notice' and 'site-footer' are names of parts,
    'has-sidebar' and 'share-prices' are not.
    """
    if node.tag in SKIPPED:
        return WEAK if node.tag == "form" else STRONG
    if node.tag == "header":  # an article's own header may hold its title
        return 0 if inside and has_heading(node) else STRONG if inside else WEAK
    if not node.attributes or not node.attributes.strip() or node.tag in ("html", "body"):
        return 0
    values = node.attribute_values()
    role = values.get("role", "").lower()
    if "hidden" in values or values.get("aria-hidden") == "true" or role in ROLES or "display:none" in values.get("style", "").replace(" ", "").lower():
        return STRONG
    if node.tag in CONTENT:
        return STRONG if any(w & {"comment", "comments", "reply"} for w in words_of(values.get("class", ""))) else 0
    names = [w for w in words_of(f"{values.get('class', '')} {values.get('id', '')}") if w & (PARTS | MAYBE) and w <= PARTS | MAYBE | PLACES]
    if any(w & PARTS for w in names):
        return STRONG
    if names and not (all(w <= {"header", "masthead"} | PLACES for w in names) and inside and has_heading(node)) or role in MAYBE_ROLES:
        return WEAK
    return 0


def below(node: Node) -> Iterator[Node]:
    todo = [k for k in node.kids if isinstance(k, Node)]
    while todo:
        one = todo.pop()
        yield one
        todo.extend(k for k in one.kids if isinstance(k, Node))


def has_heading(node: Node) -> bool:
    return any(k.tag in ("h1", "h2", "h3") for k in below(node))


def text_of(node: Node | str, out: list[str]) -> None:
    """Text of inline content; elements that are never text are left out, blocks are set apart by a space."""
    if isinstance(node, str):
        out.append(node)
        return
    if node.tag in NEVER:
        out.append(" ")
        return
    apart = node.tag in BLOCK
    if apart:
        out.append(" ")
    for kid in node.kids:
        text_of(kid, out)
    if apart:
        out.append(" ")


def plain(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


class Shape:
    """A node for alignment: a label, the hash of what is below it, its children; ``said`` is a leaf's text,
    ``inside`` whether an article or main element is above or here, ``name`` whether a name says that it is
    no content."""

    __slots__ = ("label", "text", "kids", "said", "inside", "name", "number")

    def __init__(self, label: str, inside: bool, name: int = 0) -> None:
        self.label, self.inside, self.name, self.kids, self.said, self.text, self.number = label, inside, name, [], "", 0, -1


def label_of(node: Node | str) -> str:
    if isinstance(node, str):
        return "#text"
    if node.tag in ("html", "body"):  # their classes name the page
        return node.tag
    values = node.attribute_values() if "class" in node.attributes.lower() or "id" in node.attributes.lower() else {}
    named = ".".join(sorted(WORD.findall(values.get("class", ""))))
    own = "".join(WORD.findall(values.get("id", "")))
    return f"{node.tag}{'.' + named if named else ''}{'#' + own if own else ''}"


def is_inline(node: Node | str, inside: bool) -> bool:
    return isinstance(node, str) or node.tag in NEVER or node.tag not in BLOCK and not named(node, inside) and all(is_inline(k, inside) for k in node.kids)


def shape(node: Node, inside: bool = False, page: Page | None = None, name: int = 0) -> Shape:
    """The shape of an element: runs of inline content are one leaf; what holds no text is left out."""
    page = page or Page(node)
    own = Shape(label_of(node), inside or node.tag in CONTENT, name)
    runs: list[list] = []
    for kid in node.kids:
        if is_inline(kid, own.inside):
            if runs and runs[-1][0] == "#text":
                runs[-1][1].append(kid)
            else:
                runs.append(["#text", [kid]])
        else:
            runs.append(["", [kid]])
    for label, kids in runs:
        if label:
            leaf = Shape(label, own.inside, name)
            out: list[str] = []
            for kid in kids:
                text_of(kid, out)
            leaf.said = plain(out)
            if leaf.said:
                leaf.text = zlib.crc32(leaf.said.encode("utf-8", "replace"))
                own.kids.append(leaf)
        elif kids[0].tag not in NEVER:
            is_part = max(name, named(kids[0], own.inside))
            if is_part > name and page.exempt(kids[0], own.inside, is_part):
                is_part = name
            below = shape(kids[0], own.inside, page, is_part)
            if below.kids:
                own.kids.append(below)
    if own.kids:
        own.text = zlib.crc32(repr([(k.label, k.text) for k in own.kids]).encode("utf-8", "replace"))
    return own


def number(own: Shape, at: int = 0) -> int:
    """Number the nodes in document order."""
    own.number = at
    for kid in own.kids:
        at = number(kid, at + 1)
    return at


def packed(own: Shape) -> list:
    return [own.label, own.text, [packed(k) for k in own.kids]]


def unpacked(rows: list) -> Shape:
    own = Shape(rows[0], False)
    own.text, own.kids = rows[1], [unpacked(k) for k in rows[2]]
    return own


@lru_cache(maxsize=256)
def seed_of(text: str) -> Shape:
    own = unpacked(json.loads(text))
    number(own)
    return own


def equal(a: Shape, b: Shape) -> bool:
    return a.text == b.text and a.label == b.label


def between(a: list[Shape], b: list[Shape]) -> list[tuple[list[Shape], list[Shape]]]:
    """Stretches of two lists too long for a whole table, cut at subtrees that are equal and single in both."""
    one = Counter((k.label, k.text) for k in a)
    other = Counter((k.label, k.text) for k in b)
    at = {(k.label, k.text): j for j, k in enumerate(b)}
    ends: list[int] = []
    last: list[int] = []
    spots, back = [(i, at[key]) for i, key in enumerate((k.label, k.text) for k in a) if one[key] == 1 and other[key] == 1], []
    for n, (_, j) in enumerate(spots):  # the longest ascending row
        k = bisect_left(ends, j)
        back.append(last[k - 1] if k else -1)
        ends[k:k + 1], last[k:k + 1] = [j], [n]
    row, n = [], last[-1] if last else -1
    while n >= 0:
        row.append(spots[n])
        n = back[n]
    out, i, j = [], 0, 0
    for x, y in [*row[::-1], (len(a), len(b))]:
        out += [(a[i:x], b[j:y]), (a[x:x + 1], b[y:y + 1])]
        i, j = x + 1, y + 1
    # stretches that are still long meet in place order
    return [piece for u, v in out for piece in ([(u, v)] if len(u) * len(v) <= CELLS else [(u[k:k + WINDOW], v[k:k + WINDOW]) for k in range(0, min(len(u), len(v)), WINDOW)])]


def in_order(a: list[Shape], b: list[Shape], pairs: list[tuple[Shape, Shape]]) -> int:
    """Worth of the best match, in order, of two lists of children; its pairs are added to ``pairs``."""
    size, low, high = 0, 0, 0
    while low < min(len(a), len(b)) and equal(a[low], b[low]):
        size += worth(a[low], b[low], pairs)
        low += 1
    while high < min(len(a), len(b)) - low and equal(a[-1 - high], b[-1 - high]):
        size += worth(a[-1 - high], b[-1 - high], pairs)
        high += 1
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    rows, columns = len(a), len(b)
    if not rows or not columns:
        return size
    if rows * columns > CELLS:
        return size + sum(in_order(u, v, pairs) for u, v in between(a, b))
    below: dict[tuple[int, int], list] = {}
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            top = max(best[i][j + 1], best[i + 1][j])
            if x.label == y.label:
                below[i, j] = []
                top = max(top, best[i][j] + worth(x, y, below[i, j]))
            best[i + 1][j + 1] = top
    i, j, size = rows, columns, size + best[rows][columns]
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.extend(below[i, j])
    return size


def worth(a: Shape, b: Shape, pairs: list[tuple[Shape, Shape]]) -> int:
    """Matched nodes of two trees, texts that are the same counting ``SAME`` more."""
    if a.label != b.label:
        return 0
    pairs.append((a, b))
    if not a.kids or not b.kids:
        return 1 + SAME * (not a.kids and not b.kids and a.text == b.text)
    if len(a.kids) == len(b.kids) == 1:
        return 1 + worth(a.kids[0], b.kids[0], pairs)
    return 1 + in_order(a.kids, b.kids, pairs)


def matched(a: Shape, b: Shape, pairs: list[tuple[Shape, Shape]]) -> int:
    """Simple tree matching: size of the best match of two trees; its pairs are added to ``pairs``.

    Siblings with one label meet one by one; among equally labelled ones, those of the same text do.
    """
    before = len(pairs)
    worth(a, b, pairs)
    return len(pairs) - before


def leaves(own: Shape, marked: bool) -> Iterator[Shape]:
    """Leaves with text, in document order; only those inside article or main if the page has one. What has
    a strong name is left out, and outside of an article what has a weak one."""
    if own.said and (own.inside or not marked) and (not own.name or own.name == WEAK and own.inside):
        yield own
    for kid in own.kids:
        yield from leaves(kid, marked)


def has_content(own: Shape) -> bool:
    return any(x.inside and x.said and x.name < STRONG for x in walk(own))


def layout_of(page: Shape) -> int:
    """A hash of the frames that hold the page, two deep and not within an article."""
    frames = set()

    def enter(own: Shape, path: str, depth: int) -> None:
        for kid in own.kids:
            tag = re.split("[.#]", kid.label)[0]
            if tag in ("html", "body"):
                enter(kid, path, depth)
            elif tag in FRAME:
                frames.add(here := f"{path}/{kid.label}")
                if depth < 2 and not kid.inside:
                    enter(kid, here, depth + 1)

    enter(page, "", 1)
    return zlib.crc32(" ".join(sorted(frames)).encode("utf-8", "replace"))


def read_page(text: str | None, seeds: Callable[[Shape], list]) -> tuple[list, list, int, bool, int | None]:
    """(blocks, met, print, far, layout): ``layout`` of the seed the page matches best, of those that ``seeds`` names; blocks are (number of the seed's node or -1, kind, text), ``met`` has a number
    for each node met that holds node, hash of the text (of named ones), kind, and whether it is the seed's;
    pages of one ``print`` are equal; ``far`` says that the article is not a copy of the seed's.

    The kind is ``FREE``, ``INSIDE`` an article, or ``NAMED`` inside one as if it were no content.
    """
    if not text:
        return [], [], 0, False, None
    page = shape(tree(text))
    offered = seeds(page)
    narrow(page)
    pairs: list[tuple[Shape, Shape]] = []
    which = None
    for layout, seed in offered:
        found: list[tuple[Shape, Shape]] = []
        matched(seed_of(seed), page, found)
        if len(found) > len(pairs):
            pairs, which = found, layout
    aligned = {id(b): a for a, b in pairs}
    blocks: list[list] = []
    met: list[int] = []
    size = [[0, 0], [0, 0]]
    for leaf in leaves(page, has_content(page)):
        node = aligned.get(id(leaf))
        kind = NAMED if leaf.name else INSIDE if leaf.inside else FREE
        at = -1 if node is None else node.number
        same = node is not None and node.text == leaf.text
        if node is not None:
            met.append(at << 35 | leaf.text * (kind == NAMED) << 3 | kind << 1 | same)
        if kind == INSIDE:
            for k in range(1 + same):
                size[k][0] += 1
                size[k][1] += len(leaf.said)
        if blocks and blocks[-1][:2] == [at, kind] == [-1, kind]:
            blocks[-1][2] += f" {leaf.said}"
        else:
            blocks.append([at, kind, leaf.said])
    whole = hashlib.blake2b(repr((blocks, met)).encode("utf-8", "replace"), digest_size=8).digest()
    return blocks, met, int.from_bytes(whole, "big", signed=True), any(part <= COPY * all_ for all_, part in zip(*size, strict=True)), which


def walk(own: Shape) -> Iterator[Shape]:
    yield own
    for kid in own.kids:
        yield from walk(kid)


def is_article(own: Shape) -> bool:
    return re.split("[.#]", own.label)[0] == "article"


def narrow(page: Shape) -> None:
    """Where articles hold the most of what is marked, what main holds beside them is not inside."""
    within: list[Shape] = []
    todo = [page]
    while todo:
        own = todo.pop()
        if is_article(own):
            within += walk(own)
        else:
            todo += own.kids
    if within:
        mine = {id(x) for x in within}
        marked = [x for x in walk(page) if x.inside]
        size = {id(x): len(x.said) for x in marked if x.said} if len(marked) > len(within) else {}
        if sum(size.values()) <= 2 * sum(n for x, n in size.items() if x in mine):
            for x in marked:
                x.inside = id(x) in mine


def induce(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(read, template): every page as blocks with the seed's node they match, and each layout's template nodes.

    ``read`` has page_id, url, host, layout of the seed and blocks (node, kind, text); ``template`` host, layout, its constant nodes outside and
    inside of articles, and the named nodes that vary. ``read`` is
    written to the shared folder. The host is the url's authority in lower case, empty if there is none.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(f"`{url}`"), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    named = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host.alias("host"))
    kind = pages.schema[page_id].dataType.simpleString()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [shape(tree(h or "")) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([layout_of(x) for x in read], pa.int64()), pa.array([sum(1 for y in walk(x) if y.said) for x in read], pa.int64())], names=["page_id", "url", "html", "host", "layout", "leaves"])

    laid = named.mapInArrow(lay_out, f"page_id {kind}, url string, html string, host string, layout bigint, leaves bigint").withColumn("place", F.xxhash64("host", "url", "page_id", "html"))
    # a layout's seed is of its commonest size, the one of least hash
    sized = laid.where("leaves > 0").groupBy("host", "layout", F.floor(F.log2("leaves")).alias("size")).agg(F.count("*").alias("pages"), F.min("place").alias("place"))
    layouts = materialise(sized.groupBy("host", "layout").agg(F.sum("pages").alias("pages"), F.max(F.struct("pages", "size", "place"))["place"].alias("place")))
    enough = layouts.where(F.col("pages") >= LEAST_PAGES).withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "layout")))
    alone = layouts.join(enough.select("host").distinct(), "host", "left_anti").groupBy("host").agg(F.max(F.struct("pages", "layout", "place")).alias("m")).select("host", "m.layout", "m.pages", "m.place", F.lit(1).alias("rank"))
    first = materialise(enough.unionByName(alone).select("host", "layout", "place", "rank"))
    few = first.count() * 64 <= SEED_BYTES
    chosen = named.where("html is not null").withColumn("place", F.xxhash64("host", "url", "page_id", "html")).join(F.broadcast(first) if few else first, ["host", "place"])

    def skeleton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [json.dumps(packed(shape(tree(h)))) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(seeds, pa.string())], names=["host", "layout", "rank", "seed"])

    seeds = materialise(chosen.select("host", "layout", "rank", "html").mapInArrow(skeleton, "host string, layout bigint, rank int, seed string").groupBy("host", "layout", "rank").agg(F.min("seed").alias("seed")))
    small = (seeds.agg(F.sum(F.length("seed") + F.length("host"))).first()[0] or 0) <= SEED_BYTES
    own = seeds.select("host", "layout", "seed")
    further = seeds.where(F.col("rank") <= FURTHER).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "layout", "seed"))).alias("further"))
    if small:  # pages are parsed once, for their layout and for the match
        held = spark.sparkContext.broadcast([{(r["host"], r["layout"]): r["seed"] for r in own.collect()}, {r["host"]: [(x["layout"], x["seed"]) for x in r["further"]] for r in further.collect()}])
        with_seed = named.select("page_id", "url", "host", "html", F.lit(None).cast("array<struct<layout: bigint, seed: string>>").alias("seeds"))
    else:
        held = None
        joined = laid.join(own, ["host", "layout"], "left").join(further, "host", "left")
        with_seed = joined.select("page_id", "url", "host", "html", F.when(F.col("seed").isNotNull(), F.array(F.struct("layout", "seed"))).otherwise(F.transform("further", lambda x: F.struct(x["layout"].alias("layout"), x["seed"].alias("seed")))).alias("seeds"))

    def offer(host: str, seeds: list | None) -> Callable[[Shape], list]:
        def given(page: Shape) -> list:
            if held is None:
                return [(x["layout"], x["seed"]) for x in seeds or []]
            layout = layout_of(page)
            seed = held.value[0].get((host, layout))
            return held.value[1].get(host, []) if seed is None else [(layout, seed)]
        return given

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("node", pa.int32()), ("kind", pa.int8()), ("text", pa.string())]))
        for batch in batches:
            hosts, html, seeds = (batch.column(k).to_pylist() for k in (2, 3, 4))
            read = [read_page(h, offer(host, s)) for host, h, s in zip(hosts, html, seeds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x[4] for x in read], pa.int64()),
                 pa.array([[{"node": n, "kind": k, "text": t} for n, k, t in x[0]] for x in read], block), pa.array([x[1] for x in read], pa.list_(pa.int64())),
                 pa.array([x[2] for x in read], pa.int64()), pa.array([x[3] for x in read], pa.bool_())], names=["page_id", "url", "host", "layout", "blocks", "met", "print", "far"])

    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    schema = f"page_id {kind}, url string, host string, layout bigint, blocks array<struct<node: int, kind: tinyint, text: string>>, met array<bigint>, print bigint, far boolean"
    with_seed.mapInArrow(align, schema).write.option("compression", "zstd").parquet(folder)
    read = spark.read.parquet(folder)
    pages = read.where("size(met) > 0").select("host", "layout", "print", "met", "far").dropDuplicates(["host", "layout", "print"])
    # texts of a node, then nodes: a name is outvoted where nearly every page says something else
    one = pages.select("host", "layout", "far", F.explode("met").alias("m")).select(
        "host", "layout", F.shiftright("m", 35).cast("int").alias("node"), F.shiftright("m", 1).bitwiseAND(3).cast("int").alias("kind"), F.shiftright("m", 3).bitwiseAND(0xFFFFFFFF).alias("said"), (F.col("m") % 2 == 1).alias("same"), "far")
    texts = one.where((F.col("kind") != INSIDE) | F.col("far")).groupBy("host", "layout", "node", "kind", "said").agg(F.count("*").alias("pages"), F.count_if("same").alias("same"))
    counts = texts.groupBy("host", "layout", "node", "kind").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), F.count("*").alias("texts"))
    counts = counts.join(pages.groupBy("host", "layout").agg(F.count_if("far").alias("all_far")), ["host", "layout"])
    same = F.col("same") >= CONSTANT * F.col("pages")
    constant = F.when(F.col("kind") == FREE, same).when(F.col("kind") == NAMED, F.col("texts") >= CONSTANT * F.col("pages")).otherwise(same & (F.col("pages") >= LEAST_INSIDE) & (F.col("same") >= COMMON * F.col("all_far")))
    # a layout has at most as many template nodes as its seed has nodes
    template = materialise(counts.where((F.col("pages") >= LEAST_PAGES) & constant).groupBy("host", "layout").agg(
        *[F.collect_list(F.when(F.col("kind") == k, F.col("node"))).alias(name) for k, name in ((FREE, "nodes"), (INSIDE, "repeated"), (NAMED, "varied"))]))
    return read.drop("met", "print", "far"), template


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    ``text`` is the page's content, blocks in page order joined by one space, white space turned into
    one space and trimmed; character references are decoded. Null, empty and contentless pages have an
    empty text; repeated rows are returned as often as they come; pages without a host form one host.
    Markup may be broken or cut off at any place. Other columns are left out, whatever their names.
    """
    read, template = induce(pages, page_id, url, html)
    small = (template.agg(F.sum(F.size("nodes") * 4 + F.size("repeated") * 4 + F.size("varied") * 4 + F.length("host"))).first()[0] or 0) <= SEED_BYTES
    judged = read.join(F.broadcast(template) if small else template, ["host", "layout"], "left")
    kept = F.filter("blocks", lambda b: F.coalesce(F.when(b["kind"] == FREE, ~F.array_contains("nodes", b["node"])).when(b["kind"] == INSIDE, ~F.array_contains("repeated", b["node"])).otherwise(F.array_contains("varied", b["node"])), b["kind"] != NAMED))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return judged.select(F.col("page_id").alias(page_id), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
