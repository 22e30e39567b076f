"""Main text of web pages by wrapper induction.

Pages of one host are cut from a few wrappers. A wrapper belongs to a layout: pages of a host with the same elements on the first
level that has several. Each page's tree, with all its menus and adverts, is aligned by simple tree matching with the tree of its layout's pivot page.
A node at which texts come back on other pages of the layout is template (a menu, a footer, an advert of a rotation), and so is a
text that nearly all pages have at one node; what varies is content. Pages whose longest texts are the same count once, so copies of an article are one witness.

Hosts of few pages show no wrapper of their own, and large ones may not show all of it. What hosts of one theme share is told from all pages that
have the same tree, node for node with class names, whatever their host; the name of its host is the same text on any page. A block is template
if its host's wrapper or that of its tree says so. Trees of less than ``RICH`` nodes are nobody's theme and have none.

Only what the wrappers leave is looked at further, for what varies and yet is no article: elements that HTML or their class
names mark as menus, forms, comments and the like go, and articles or a main element are preferred where there are some. Class names
never empty a page, and of what the wrapper takes an article that HTML marks is given back where nothing else is left.

Pages go by in skeletons (labels and hashes of blocks) until the last step. Large hosts and layouts are dealt out in salted parts of about ``PART`` pages. Votes are counted in each part
and added up before anything is judged, so a wrapper is the same however pages are dealt and whatever other hosts are there, and a host with a third of all pages needs no task of its own. A part is sent the wrappers
of the layouts and trees that its own pages have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .htmltree import ARTICLE, HARD, MAIN, SOFT, Page, Tree, code_of, match

#: Distinct pages that a wrapper needs; the part of them that must have a text for it to be constant; the part of a node's texts that must come back for it to be template.
PAGES, AGREE, RECUR = 5, 0.9, 0.7
#: Nodes of the least tree that hosts may share.
RICH = 8
#: Pages that one part of a host or layout holds, about, and after which a task passes its counts on.
PART = 256
#: What has less than this part of all pages is one part; so the list of larger ones has at most 1/COLD rows.
COLD = 1e-5
#: Over how many places the wrapper of a tree goes to meet the hosts that have it.
SALTS = 64

Wrapper = tuple[Tree, set[int], set[tuple[int, int]]]
Shared = tuple[set[int], set[tuple[int, int]]]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def kept_blocks(page: Page, template: list[bool], hints: bool = True) -> list[str]:
    """The texts that are content: what the wrapper leaves, less what HTML and marks rule out."""
    rest = [(t, f) for t, f, gone in zip(page.texts, page.flags, template) if not gone]
    if not hints:
        return [t for t, _ in rest]
    for blocks in (rest, [(t, f) for t, f in zip(page.texts, page.flags) if f & (ARTICLE | MAIN)]):
        for out in (HARD | SOFT, HARD):
            open_ = [(t, f) for t, f in blocks if not f & out]
            for scope in (ARTICLE, MAIN):
                if any(f & scope for _, f in open_):
                    open_ = [(t, f) for t, f in open_ if f & scope]
                    break
            if open_:
                return [t for t, _ in open_]
    return []


def codes_of(page: Page, host: str = "") -> list[int]:
    """A hash of each block's text, in which the name of the page's host stands for that of any host."""
    name = host.removeprefix("www.").partition(":")[0]
    return [code_of(t.replace(name, "\0") if "." in name else t) for t in page.texts]


def template_blocks(page: Page, wrapper: Wrapper | None, shared: Shared | None = None, host: str = "") -> list[bool]:
    """For each block whether its host's wrapper or that of its tree has it as template."""
    gone = [False] * len(page.texts)
    if wrapper is None and shared is None:
        return gone
    codes = codes_of(page, host)
    if wrapper is not None:
        pivot, slots, constant = wrapper
        partner = match(pivot, page)[1]
        gone = [(at := partner.get(node)) is not None and (at in slots or (at, c) in constant) for node, c in zip(page.nodes, codes)]
    if shared is not None:
        gone = [g or node in shared[0] or (node, c) in shared[1] for g, node, c in zip(gone, page.nodes, codes)]
    return gone


def main_text(html: str | None, wrapper: Wrapper | None = None, hints: bool = True) -> str:
    page = Page(html)
    return "\n".join(kept_blocks(page, template_blocks(page, wrapper), hints))


_TREE = "labels array<string>, parents array<int>, nodes array<int>, codes array<long>"
_OUTLINE = f"host string, part int, layout long, shape long, ident long, {_TREE}"
_OUTLINE_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_TREE_NAMES = ["labels", "parents", "nodes", "codes"]


def _frame(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page with text as its layout, its shape, a hash of the longest quarter of its texts (three at least), and its skeleton."""
    for batch in batches:
        out = []
        for host, part, html in zip(*(batch[c].to_pylist() for c in ("host", "part", "html"))):
            page = Page(html)
            if page.texts:
                codes = codes_of(page, host)
                longest = sorted(range(len(codes)), key=lambda i: (-len(page.texts[i]), i))[: max(3, len(codes) // 4)]
                out.append((host, part, page.layout(), page.shape(), code_of(" ".join(str(codes[i]) for i in longest)), page.labels, page.parents, page.nodes, codes))
        yield _frame(out, ["host", "part", "layout", "shape", "ident", *_TREE_NAMES], _OUTLINE_KINDS)


def votes(pivot: Tree, pages: Iterator[tuple[Tree, list[int], list[int]]]) -> Counter[tuple[int, int | None]]:
    """How many of some pages have a text at a node of the pivot, by (node, None), and how many have one text there, by (node, code)."""
    out: Counter[tuple[int, int | None]] = Counter()
    for own, nodes, codes in pages:
        partner = match(pivot, own)[1]
        found: set[tuple[int, int | None]] = {(partner[n], c) for n, c in zip(nodes, codes) if n in partner}
        out.update(found | {(n, None) for n, _ in found})
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The votes of each part, from rows sorted by part, the pivot first and then by the hash of the longest texts; parts without a pivot have none."""
    names = ["host", "layout", "dealt", "kind", "ident", *_TREE_NAMES]
    key, pivot, seen = None, None, None
    group: list[tuple[Tree, list[int], list[int]]] = []

    def close() -> pa.RecordBatch:
        rows = [(key[0], key[1], n, c, k) for (n, c), k in votes(pivot, iter(group)).items()]
        group.clear()
        return _frame(rows, ["host", "layout", "node", "code", "pages"], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in names)):
            if row[:3] != key:
                if group:
                    yield close()
                key, pivot, seen = row[:3], None, None
            if row[3] == 0:
                pivot = Tree(row[5], row[6])
            elif pivot and row[4] != seen:
                seen = row[4]
                group.append((Tree(row[5], row[6]), row[7], row[8]))
                if len(group) == PART:
                    yield close()
    if group:
        yield close()


def _parts(pages: DataFrame, *keys: str) -> DataFrame:
    """(h, parts): in how many parts hosts, or what has the same ``keys``, go that are not one; at most 1/COLD rows of two numbers, so it may be broadcast."""
    counted = pages.groupBy(F.xxhash64(*(keys or ("host",))).alias("h")).agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("all")).withColumn("one", F.lit(1))
    large = counted.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").where((F.col("n") > PART) & (F.col("n") >= COLD * F.col("all")))
    return checkpointed(large.select("h", F.ceil(F.col("n") / PART).cast("int").alias("parts")))


def _in_part(rows: DataFrame, parts: DataFrame, by: Column, name: str = "part", keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The rows with the part that ``by`` chooses among those of their keys."""
    own = rows.withColumn("h", F.xxhash64(*keys)).join(F.broadcast(parts), "h", "left").drop("h")
    return own.withColumn(name, F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def _in_each_part(rows: DataFrame, parts: DataFrame, name: str = "part", keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The rows once for each part of their keys."""
    own = rows.withColumn("h", F.xxhash64(*keys)).join(F.broadcast(parts), "h", "left").drop("h")
    return own.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def outlines(pages: DataFrame) -> DataFrame:
    """The skeletons of (host, part, html)."""
    return checkpointed(pages.select("host", "part", "html").mapInArrow(_outlined, _OUTLINE))


def _told(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, slots, c) from the votes (keys, node, code, pages): the nodes that are template, and the (node, code) that are constant."""
    is_text = F.col("code").isNotNull()
    texts = F.sum(F.when(is_text, F.col("pages")).otherwise(0))
    back = F.sum(F.when(is_text & (F.col("pages") > 1), F.col("pages")).otherwise(0))
    nodes = counted.groupBy(*keys, "node").agg(F.sum(F.when(~is_text, F.col("pages"))).alias("seen"), (back >= RECUR * texts).alias("slot")).where(F.col("seen") >= PAGES)
    often = counted.where(is_text & (F.col("pages") >= AGREE * PAGES)).select(*keys, "node", "code", "pages")
    constant = ~F.col("slot") & (F.col("pages") >= AGREE * F.col("seen"))
    return (
        nodes.join(often, [*keys, "node"], "left").where(F.col("slot") | constant).groupBy(*keys)
        .agg(F.collect_set(F.when(F.col("slot"), F.col("node"))).alias("slots"), F.collect_set(F.when(constant, F.struct("node", "code"))).alias("c"))
    )


def own_wrappers(trees: DataFrame) -> DataFrame:
    """(host, layout, main, labels, parents, slots, nodes, codes) of each layout of a host that has a wrapper, from skeletons.

    labels and parents are the pivot's tree, slots its nodes that are template, (nodes, codes) the constant texts. ``main`` marks the commonest layout of the host.
    """
    layouts = checkpointed(trees.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(F.struct("ident", *_TREE_NAMES)).alias("pivot")))
    common = layouts.groupBy("host").agg(F.max(F.struct("n", "layout"))["layout"].alias("common"))
    pivots = checkpointed(layouts.where(F.col("n") >= PAGES).join(common, "host").select("host", "layout", (F.col("layout") == F.col("common")).alias("main"), "pivot.*"))
    keys = ("host", "layout")
    parts = _parts(trees, *keys)
    tree = [*keys, "ident", *_TREE_NAMES]
    pages = trees.join(pivots.select(*keys), [*keys], "left_semi").select(*tree, F.lit(1).alias("kind"))
    both = _in_part(pages, parts, F.col("ident"), "dealt", keys).unionByName(_in_each_part(pivots.select(*tree, F.lit(0).alias("kind")), parts, "dealt", keys))
    dealt = both.repartition(*keys, "dealt").sortWithinPartitions(*keys, "dealt", "kind", "ident")
    said = dealt.mapInArrow(_aligned, "host string, layout long, node int, code long, pages long")
    counted = checkpointed(said.groupBy(*keys, "node", "code").agg(F.sum("pages").alias("pages")))
    told = _told(counted, *keys)
    return checkpointed(pivots.join(told, [*keys]).select(*keys, "main", "labels", "parents", "slots", F.col("c.node").alias("nodes"), F.col("c.code").alias("codes")))


def shared_wrappers(trees: DataFrame) -> DataFrame:
    """(shape, slots, nodes, codes) of each tree that has a wrapper, over all hosts, from skeletons. Equal trees need no alignment: a node is itself."""
    once = trees.where(F.size("labels") >= RICH).groupBy("shape", "ident").agg(F.min(F.struct("nodes", "codes")).alias("t"))
    texts = F.array_distinct(F.arrays_zip(F.col("t.nodes").alias("node"), F.col("t.codes").alias("code")))
    nodes = F.transform(F.array_distinct("t.nodes"), lambda n: F.struct(n.alias("node"), F.lit(None).cast("long").alias("code")))
    counted = checkpointed(once.select("shape", F.explode(F.concat(nodes, texts)).alias("x")).groupBy("shape", "x.node", "x.code").agg(F.count("*").alias("pages")))
    return checkpointed(_told(counted, "shape").select("shape", "slots", F.col("c.node").alias("nodes"), F.col("c.code").alias("codes")))


def wrappers(pages: DataFrame) -> DataFrame:
    """The wrappers of hosts from (host, html) of all pages; see own_wrappers."""
    return own_wrappers(outlines(pages.withColumn("part", F.lit(0))))


def _read(hints: bool):
    """The texts of pages, from rows sorted by part, the wrappers that its pages may need first."""
    names = ["host", "part", "kind", "page_id", "url", "html", "layout", "shape", "main", "labels", "parents", "slots", "nodes", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, common, shared = None, {}, None, {}
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in names)):
                if row[:2] != key:
                    key, own, common, shared = row[:2], {}, None, {}
                if row[2] == 0:
                    told = set(row[11]), set(zip(row[12], row[13]))
                    if row[7] is not None:
                        shared[row[7]] = told
                    else:
                        own[row[6]] = (Tree(row[9], row[10]), *told)
                        common = own[row[6]] if row[8] else common
                    continue
                page = Page(row[5])
                template = template_blocks(page, own.get(page.layout(), common) if own else None, shared.get(page.shape()) if shared else None, row[0])
                text = "\n".join(kept_blocks(page, template, hints))
                out.append((row[3], row[4], text, len(text)))
            yield _frame(out, ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Without ``hints`` the wrappers alone decide.

    A null or empty page gives an empty text, and so does one on which the wrapper leaves nothing. A null or odd url stands for the host without a name. Repeated
    pages count once for the wrapper and stay in the result. Tags may be nested to any depth, cut off or left open; a tag that the page's end
    cuts off is no text. Other columns are ignored; an empty table gives an empty result.
    """
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    parts = _parts(own)
    read = _in_part(own, parts, F.struct("page_id", "url"))
    trees = outlines(read)
    of_host, of_tree = own_wrappers(trees), shared_wrappers(trees)
    salt = F.pmod(F.xxhash64("host", "part"), F.lit(SALTS)).cast("int")
    salted = of_tree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = (
        trees.select("host", "part", "layout").distinct().join(of_host, ["host", "layout"])
        .unionByName(_in_each_part(of_host.where("main"), parts))
        .unionByName(trees.select("host", "part", "shape").distinct().withColumn("salt", salt).join(salted, ["shape", "salt"]).drop("salt"), allowMissingColumns=True)
    )
    both = read.withColumn("kind", F.lit(1)).unionByName(known.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("host", "part").sortWithinPartitions("host", "part", "kind").mapInArrow(_read(hints), "page_id long, url string, text string, n_chars long")
