"""Main text of HTML pages by wrapper induction.

The pages of a host share a template. Each page's tree of block elements is aligned with that of a
reference page of its host by simple tree matching (the largest order-preserving matching of nodes
with equal labels whose parents match). A matched node is a slot; a node that the reference lacks takes
the path of its labels for a slot, so every block of text has one. A text that stands at a slot of
LEAST_PAGES different pages is constant there; where most pages of the host that have the slot show such
texts (one menu, or one of the host's menus), the slot is template, and where texts vary it is content.
Pages count by what they are about (a hash of their longest block, without those that all pages
of the host show), so copies and near copies of one article count once and do not turn its text into
template.

Three things alignment cannot know. Scripts, styles and forms never count. Adverts and reader comments
vary from page to page as an article does, and a host with fewer than LEAST_PAGES different pages has no
template yet: there HTML's own marks decide (nav, footer, aside; a class or id that says so as a whole).
Where a page marks its main part (article, main), only that part counts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces
from .url_filter import split_url

#: A text is constant at a slot if so many different pages of a host show it there; a slot is template
#: if this share of the pages that have it show constant texts.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.8
#: What this share of a host's different pages show says nothing of a page, unless the rest of the page
#: is less than this share of its text.
EVERYWHERE, LEAST_REST = 0.95, 0.2
#: The reference of a host is the page whose length is closest to this.
REFERENCE_SIZE = 3000
#: Nodes deeper than this take their path for a slot instead of being aligned (recursion ends here).
DEPTH = 200

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var rt rp img input wbr br".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = frozenset("ul ol dl table body html article section div main nav aside form footer header select".split())
_NEVER = frozenset("head form button select dialog".split())
_MARKED = frozenset("nav footer aside menu".split())
_MAIN = frozenset(("article", "main"))
#: A class, id or role marks no main text if every part of it (between hyphens) is one of these.
_MARKING = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs complementary contentinfo "
    "footer header masthead comment comments disqus replies respond share sharing social related newsletter subscribe popup modal widget pagination pager toolbar login signup search list box bar area section block".split()
)
#: Of these, parts that say nothing alone.
_FILLING = frozenset("list box bar area section block".split())
_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element: label (tag and words of class, id and role), path (hash of the labels down to it)."""

    __slots__ = ("label", "children", "number", "never", "marked", "main", "dropped", "parent", "depth", "path")

    def __init__(self, label: str, parent: Node | None, number: int, never: bool = False, marked: bool = False, main: bool = False):
        self.label, self.parent, self.number = label, parent, number
        self.never, self.marked, self.main, self.dropped = never, marked, main, False
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.path = xxhash.xxh64_intdigest(label.encode(), parent.path if parent else 0)


def _marks(token: str) -> bool:
    parts = token.split("-")
    return all(p in _MARKING for p in parts) and not all(p in _FILLING for p in parts)


def _settle(nodes: list[Node]) -> None:
    """Which nodes the marks drop, from the page as a whole: what holds its first article is not dropped
    for its own class, whatever that says."""
    safe: set[int] = set()
    for n in nodes:
        tag = n.label.split(" ", 1)[0]
        n.main = n.main or bool(n.parent and n.parent.main)
        inside = n.parent is not None and n.parent.dropped
        tagged = tag in _MARKED or (tag == "header" and not n.main)
        n.dropped = n.never or inside or tagged or n.marked
    first = next((n for n in nodes if n.main and not n.marked and not _shut(n)), None)
    while first is not None:
        safe.add(first.number)
        first = first.parent
    for n in nodes:
        tag = n.label.split(" ", 1)[0]
        inside = n.parent is not None and n.parent.dropped
        tagged = tag in _MARKED or (tag == "header" and not n.main)
        n.dropped = n.never or inside or tagged or (n.marked and n.number not in safe)


def _shut(n: Node | None) -> bool:
    """Whether an element around it never counts, whatever it holds."""
    while n is not None:
        if n.never or n.label.split(" ", 1)[0] in _MARKED:
            return True
        n = n.parent
    return False


def _end_of_tag(page: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Position of the > that ends a tag, len(page) if none; whether quotes may still be trusted."""
    start = at
    while quotes and (m := _STOP.search(page, at)):
        if m[0] == ">":
            return m.start(), True
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    end = page.find(">", start)
    return (end if end >= 0 else len(page)), False


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks of text with their node, in page order."""
    root = Node("#", None, 0)
    nodes = [root]
    stack: list[tuple[str, Node]] = [("#", root)]
    opened: Counter[str] = Counter()  # elements on the stack, to look for none in vain
    count, blocks, held, quotes, at = 1, [], [], True, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append((stack[-1][1], text))

    def close(n: int) -> None:
        """Takes elements off until ``n`` are left."""
        if any(tag not in _INLINE for tag, _ in stack[n:]):
            flush()
        opened.subtract(tag for tag, _ in stack[n:])
        del stack[n:]

    while m := _TAG.search(page, at):
        held.append(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        end, quotes = _end_of_tag(page, m.end(), quotes)
        at = end + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in _SCOPES and tag not in _SCOPES:
                    break
            continue
        if tag == "br":
            held.append(" ")
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if page[end - 1 : end] != "/" else None
            at = end.end() if end else at if page[at - 2 : at - 1] == "/" else len(page)
            continue
        if tag in _INLINE or tag in _VOID:
            if tag not in _INLINE:
                flush()
            elif tag not in _VOID:
                stack.append((tag, stack[-1][1]))
                opened[tag] += 1
            continue
        ends = opened["p"] or any(opened[t] for t in _CLOSES.get(tag, ()))
        for k in range(len(stack) - 1 if ends else 0, 0, -1):  # end tags that may be left out
            open_tag = stack[k][0]
            if open_tag == "p" or open_tag in _CLOSES.get(tag, ()):
                close(k)
                break
            if open_tag in _SCOPES:
                break
        flush()
        parent = stack[-1][1]
        tokens = [x for g in _MARKS.findall(page, m.end(), end) for x in "".join(g).lower().split()]
        label = " ".join([tag, *(w for x in tokens for w in _WORD.findall(x))])
        marked = any(map(_marks, tokens)) and tag not in ("html", "body", "main") and "main" not in tokens
        node = Node(label, parent, count, tag in _NEVER, marked, tag in _MAIN or "main" in tokens)
        nodes.append(node)
        count += 1
        parent.children.append(node)
        stack.append((tag, node))
        opened[tag] += 1
    held.append(page[at:])
    flush()
    _settle(nodes)
    return root, blocks


def align(page: Node, reference: Node) -> dict[int, int]:
    """Simple tree matching: number of a page's node -> number of the reference's node."""
    sizes: dict[tuple[int, int], tuple[int, list[list[int]]]] = {}

    def size(a: Node, b: Node) -> int:
        if a.label != b.label or a.depth > DEPTH:
            return 0
        if not a.children or not b.children:
            return 1
        if (known := sizes.get((a.number, b.number))) is not None:
            return known[0]
        before = [0] * (len(b.children) + 1)
        rows = [before]
        for x in a.children:
            now = [0]
            for j, y in enumerate(b.children, 1):
                best = before[j] if before[j] >= now[j - 1] else now[j - 1]
                if x.label == y.label and (both := before[j - 1] + size(x, y)) > best:
                    best = both
                now.append(best)
            rows.append(now)
            before = now
        sizes[a.number, b.number] = (before[-1] + 1, rows)
        return before[-1] + 1

    size(page, reference)
    pairs, todo = {}, [(page, reference)]
    while todo:
        a, b = todo.pop()
        pairs[a.number] = b.number
        if (known := sizes.get((a.number, b.number))) is None:
            continue
        rows, i, j = known[1], len(a.children), len(b.children)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((a.children[i], b.children[j]))
    return pairs


def skeleton(page: str) -> str:
    """A page's tree without its texts: a line for each node, its depth and label."""
    lines, todo = [], [parse(page)[0]]
    while todo:
        n = todo.pop()
        lines.append(f"{n.depth} {n.label}")
        todo += reversed(n.children)
    return "\n".join(lines)


@lru_cache(maxsize=512)
def _tree(lines: str) -> Node:
    """The tree of a skeleton."""
    last: dict[int, Node] = {}
    for number, line in enumerate(lines.split("\n")):
        depth, label = line.split(" ", 1)
        parent = last.get(int(depth) - 1)
        last[int(depth)] = node = Node(label, parent, number)
        if parent is not None:
            parent.children.append(node)
    return last[0]


def content_blocks(page: str, reference: str | None) -> list[tuple[int | None, str, bool]]:
    """Slot, text, and whether marks drop it, of each block that may count. ``reference``: a skeleton.

    What stands in a marked main part has no slot: it is content, whatever recurs there."""
    root, blocks = parse(page)
    blocks = [(n, t) for n, t in blocks if not n.never]
    main = any(n.main and not n.dropped for n, _ in blocks)
    pairs = align(root, _tree(reference)) if reference and blocks else {}
    seen: Counter[int] = Counter()
    out = []
    for n, t in blocks:
        k = seen[n.number]
        seen[n.number] += 1
        slot = pairs[n.number] * 1024 + min(k, 1023) if n.number in pairs else -1 - (n.path >> 1)
        if n.main and not n.dropped:
            slot = None
        out.append((slot, t, n.dropped or (main and not n.main)))
    return out


def gram(text: str) -> int | None:
    """The least hash of five words in a row, on which near copies mostly agree; None: too few words."""
    words = text.encode().split()
    least = min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(len(words) - 4)), default=None)
    return None if least is None else least - (1 << 63)


_BLOCKS = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string()), ("marked", pa.bool_()), ("gram", pa.int64())]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "host", "version"]
    for batch in pieces(batches, "html"):
        found = [[{"slot": s, "text": t, "marked": d, "gram": None if d else gram(t)} for s, t, d in content_blocks(page or "", reference)] for page, reference in zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, _BLOCKS)], names=[*names, "blocks"])


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([skeleton(h) for h in batch.column("html").to_pylist()], pa.string())], names=["host", "reference"])


def judged(pages: DataFrame) -> DataFrame:
    """page_id, url, and blocks (array of text, marked, template) of every row of ``pages``.

    Pages meet the skeleton of their host's reference, a small table, by a join that Spark broadcasts
    below its size threshold and otherwise splits where a host is hot. Texts at slots are counted by
    their hashes, each once a kind of page, never in whole groups.
    """
    host = split_url(F.col("url"))[0]
    source = pages.select("page_id", "url", host.alias("host"), "html", F.xxhash64("html").alias("version"))
    length = F.octet_length("html")
    closest = source.where(length > 0).groupBy("host").agg(F.min(F.struct(F.abs(length - REFERENCE_SIZE).alias("off"), F.col("version").alias("version"))).alias("x")).select("host", F.col("x.version").alias("version"))
    chosen = source.join(materialise(closest, "closest"), ["host", "version"]).groupBy("host").agg(F.min("html").alias("html"))
    references = materialise(chosen.mapInArrow(_skeletons, "host string, reference string"), "references")
    paired = source.join(references, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    cut = paired.select("page_id", "url", "host", "version", "html", "reference").mapInArrow(_blocks, f"page_id {kind}, url string, host string, version long, blocks array<struct<slot:bigint,text:string,marked:boolean,gram:bigint>>")
    cut = materialise(cut, "blocks")
    versions = cut.select("host", "version").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    plain = cut.withColumn("blocks", F.filter("blocks", lambda b: ~b["marked"]))
    often = _shown(plain, "version").groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    everywhere = often.join(versions, "host").where(F.col("n") >= EVERYWHERE * F.col("pages")).select("host", F.xxhash64("slot", "text").alias("x"))
    told = _with(cut, everywhere, "everywhere")
    shown = _shown(told.withColumn("about", _about()), "about").groupBy("host", "slot", "text").agg(F.count("*").alias("n"))
    slots = shown.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.sum(F.when(F.col("n") >= LEAST_PAGES, F.col("n")).otherwise(0)).alias("constant"))
    template = slots.where((F.col("constant") > 0) & (F.col("constant") >= TEMPLATE_SHARE * F.col("pages"))).select("host", F.col("slot").alias("x"))
    known = _with(cut, template, "template")
    return known.select("page_id", "url", F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["marked"].alias("marked"), F.coalesce(F.array_contains("template", b["slot"]), F.lit(False)).alias("template"))).alias("blocks"))


def _shown(cut: DataFrame, page: str) -> DataFrame:
    """host, slot, text (hash), page: what stands where, once for each page (its version, or what it is about)."""
    each = cut.select("host", F.col(page).alias("page"), F.explode("blocks").alias("b"))
    return each.where("b.slot IS NOT NULL").select("host", "page", F.col("b.slot").alias("slot"), F.xxhash64("b.text").alias("text")).distinct()


def _with(cut: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Adds an array of the x of each host (few: a template has no more slots than its pages)."""
    by_host = materialise(found.groupBy("host").agg(F.collect_list("x").alias(name)), name)
    return cut.join(by_host, "host", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))


def _about() -> Column:
    """What a page is about: the gram of its longest block that may be content."""
    may = F.filter("blocks", lambda b: ~b["marked"])
    own = F.filter(may, lambda b: ~F.array_contains("everywhere", F.xxhash64(b["slot"], F.xxhash64(b["text"]))))

    def size(blocks: Column) -> Column:
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))

    longest = F.when(size(own) >= LEAST_REST * size(may), own).otherwise(may)
    return F.array_max(F.transform(longest, lambda b: F.struct(F.length(b["text"]).alias("n"), F.coalesce(b["gram"], F.xxhash64(b["text"])).alias("gram"))))["gram"]


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null html gives an empty text. Pages without a host (null urls too) share one template. Repeated rows
    and null ids each get a row. Other columns are ignored, whatever their names. An empty table gives
    an empty table. Whole pages are read, however long or deep.
    """
    kept = F.transform(F.filter("blocks", lambda b: ~b["template"] & ~b["marked"]), lambda b: b["text"])
    return judged(pages).select("page_id", "url", F.array_join(kept, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
