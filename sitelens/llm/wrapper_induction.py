"""Main text of pages by wrapper induction.

The DOM trees of all different pages of a host are aligned by simple tree matching and
merged into the host's wrapper, a tree of slots; neighbours of equal shape are one repeated
slot.  A page's own tree is a wrapper of one page; Spark merges wrappers in rounds, and counts over all
pages which places a host's pages share.  Every page is then aligned with its host's wrapper, and Spark sums for
each slot what all pages hold there: text, text of links, text of paragraphs, and the texts that the
different pages have in common.  From these sums the wrapper tells its content: it goes down to the part that holds
the running text, leaves out what stands beside it with little or mostly linked text, and texts
that a slot has on nearly all pages are template.  Words of class and id (menu, advert, comments) and tags that never
hold an article are left out as well, whatever their sums."""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import ceil
from zlib import compress, crc32, decompress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import stored, table
from sitelens.llm.url_rules import host_of

#: Different pages that a host has at least for a wrapper of its own; smaller hosts share the
#: wrapper of their domain.
LEAST = 4
#: Trees that one task merges, about.
FAN = 256
#: A wrapper's slots are the places that at least this share of all its different pages have (labels
#: with an id of their own, as `post-123`, are on one page each); what a page has besides is judged by that page's sums.
SHARED = 0.01
#: Levels below two nodes that say how well they match.
LOOK = 3
#: What stands beside the running text with less than this share of it is not content.
BESIDE = 0.25
#: Share of the different pages, and of all a slot's pages, that have a text of the template.
OFTEN = 0.9

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>="']|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "textarea", "title", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label".split())
#: Elements and words of class, id or role that never hold the article.
_OUT = frozenset("nav header footer aside form script style noscript template iframe textarea title head menu button select svg dialog object canvas".split())
_OUT_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe comment comments reply replies breadcrumb "
    "breadcrumbs share social related widget search login pagination pager complementary contentinfo toolbar skip".split()
)
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


#: Elements that are parts of running text wherever they stand.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd figure".split())


class Node:
    """An element: label (tag and names), its parts in order (texts and elements), the blocks
    below it, and lengths of its text: all, linked, in paragraphs, and outside of blocks."""

    __slots__ = ("tag", "label", "out", "parts", "blocks", "chars", "links", "para", "own", "_hash")
    #: Pages that have it.
    seen = 1

    def __init__(self, tag: str, names: str = "") -> None:
        self.tag, self.label = tag, f"{tag} {names}".rstrip()
        self.out = tag in _OUT or any(x in _OUT_NAMES for x in re.split(r"[^a-z0-9]+", names))
        self.parts: list = []
        self.blocks: list[Node] = []
        self.chars = self.links = self.para = self.own = 0
        self._hash: int | None = None

    def shape(self) -> tuple:
        return self.label, tuple(sorted({b.label for b in self.blocks}))

    def text_hash(self) -> int:
        """Of the text outside of blocks."""
        if self._hash is None:
            held: list[str] = []
            todo = list(reversed(self.parts))
            while todo:
                x = todo.pop()
                if isinstance(x, str):
                    held.append(x)
                elif x.tag in _INLINE and not x.out:
                    todo.extend(reversed(x.parts))
            self._hash = crc32(" ".join("".join(held).split()).encode("utf-8", "replace"))
        return self._hash

    def texts(self) -> Iterable[tuple[int, int]]:
        """Its text, with the pages that have it."""
        return ((self.text_hash(), 1),) if self.own else ()


def parse(page: str | None) -> Node:
    """Tree of a page; missing end tags are supplied, comments and declarations are dropped.

    One pass: an end tag or a closing quote that isn't there is looked for once."""
    root = Node("#page")
    stack, opened = [root], Counter()
    page = page or ""
    at = 0

    def text(raw: str) -> None:
        if raw:
            resolved = entities.unescape(raw)
            stack[-1].parts.append(resolved)
            length = len(resolved.strip())
            stack[-1].chars += length
            stack[-1].own += length

    def close(index: int) -> None:
        while len(stack) > index:
            done, above = stack.pop(), stack[-1]
            opened[done.tag] -= 1
            if done.tag == "a":
                done.links = done.chars
            if done.tag in _TEXTUAL:
                done.para = done.chars
            if done.out:
                continue
            above.chars += done.chars
            above.links += done.links
            above.para += done.para
            if done.tag in _INLINE:
                above.own += done.own
                above.blocks += done.blocks
            else:
                above.blocks.append(done)

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            text(page[at:start])
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _TAG.match(page, start)
        if not m:
            if not re.match(r"[a-zA-Z!?]|/[a-zA-Z]", page[start + 1 : start + 3]):
                # No tag: the sign is text.
                text(page[at : start + 1])
                at = start + 1
                continue
            text(page[at:start])
            end = page.find(">", start) if page[start + 1] in "!?" else -1
            # An unfinished tag at the end is no text.
            at = end + 1 if end >= 0 else len(page)
            continue
        text(page[at:start])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in _CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        if tag in _SAME and any(opened[x] for x in _SAME[tag][0].split()):
            ends, scope = _SAME[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in ends.split():
                    close(k)
                    break
        node = Node(tag, " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).lower() if m[3] and m[3].strip() else "")
        stack[-1].parts.append(node)
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(node)
        opened[tag] += 1
    text(page[at:])
    close(1)
    return root


Run = list["Node | Slot"]


def runs(node: Node | Slot) -> list[Run]:
    """The blocks of a node that may hold content; neighbours of one shape stand together."""
    out: list[Run] = []
    last = None
    for b in node.blocks:
        shape = b.shape()
        if shape == last:
            out[-1].append(b)
        else:
            out.append([b])
        last = shape
    return out


class Slot:
    """A node of a wrapper; one that repeats among its neighbours is one slot."""

    __slots__ = ("label", "children", "number", "seen", "common", "sums", "out", "template", "spine")

    def __init__(self, label: str) -> None:
        self.label = label
        self.children: list[Slot] = []
        #: Its place in the wrapper, and how many different pages have it.
        self.number = self.seen = 0
        #: Texts (hashes) of its nodes, with the different pages that have them.
        self.common: Counter = Counter()
        self.sums = Sums()
        #: Not content; its texts that are template; the child that the running text is in.
        self.out, self.template, self.spine = False, frozenset(), None

    def shape(self) -> tuple:
        return self.label, tuple(sorted({c.label for c in self.children}))

    @property
    def blocks(self) -> list[Slot]:
        return self.children

    def texts(self) -> Iterable[tuple[int, int]]:
        return self.common.items()

    @property
    def textual(self) -> bool:
        return self.label.split(" ", 1)[0] in _TEXTUAL


class Sums:
    """What pages hold in a slot, and on how many of them it has each common text."""

    __slots__ = ("pages", "chars", "links", "para", "own", "texts")

    def __init__(self, pages: int = 0, chars: int = 0, links: int = 0, para: int = 0, own: int = 0) -> None:
        self.pages, self.chars, self.links, self.para, self.own = pages, chars, links, para, own
        self.texts: Counter = Counter()

    def add(self, run: Run, common: Counter) -> None:
        self.pages += 1
        for n in run:
            self.chars += n.chars
            self.links += n.links
            self.para += n.para
            self.own += n.own
        if common:
            self.texts.update({n.text_hash() for n in run if n.own and n.text_hash() in common})

    def running(self) -> float:
        """Length of running text a page: linked text counts against it, paragraphs thrice."""
        return (max(0, self.chars - 2 * self.links) + 2 * max(0, self.para - 2 * self.links)) / max(1, self.pages)

    def row(self) -> tuple:
        return self.pages, self.chars, self.links, self.para, self.own


def _weight(slot: Slot, run: Run, look: int) -> int:
    """Nodes that the two trees have in common, in order: one for the roots and those below."""
    if not look or not slot.children or not run[0].blocks:
        return 1
    return 1 + _table(*_alike(slot.children, runs(run[0])), look - 1)[-1][-1]


def _alike(slots: list[Slot], own: list[Run]) -> tuple[list[Slot], list[Run]]:
    """Those of a label that is on both sides; no other can pair."""
    labels = {s.label for s in slots} & {r[0].label for r in own}
    return [s for s in slots if s.label in labels], [r for r in own if r[0].label in labels]


def _table(slots: list[Slot], own: list[Run], look: int) -> list[list[int]]:
    best = [[0] * (len(own) + 1) for _ in range(len(slots) + 1)]
    for i, s in enumerate(slots, 1):
        above, here = best[i - 1], best[i]
        for j, r in enumerate(own, 1):
            paired = above[j - 1] + _weight(s, r, look) if s.label == r[0].label else 0
            here[j] = max(above[j], here[j - 1], paired)
    return best


def match(slots: list[Slot], own: list[Run]) -> list[tuple[Slot, Run]]:
    """Simple tree matching of siblings: the pairs of equal labels, in order, with the most in common.

    Equal shapes at the beginning pair with each other."""
    k, most = 0, min(len(slots), len(own))
    while k < most and slots[k].shape() == own[k][0].shape():
        k += 1
    head = list(zip(slots[:k], own[:k], strict=True))
    slots, own = _alike(slots[k:], own[k:])
    best = _table(slots, own, LOOK)
    pairs, i, j = [], len(slots), len(own)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((slots[i], own[j]))
    return head + pairs[::-1]


def grow(root: Slot, tree: Node | Slot) -> None:
    """Merge a page, or a wrapper of other pages, into a wrapper: labels that a slot's children lack are added in place."""
    todo: list[tuple[Slot, Run]] = [(root, [tree])]
    texts: dict[int, dict[int, int]] = {}
    while todo:
        slot, nodes = todo.pop()
        if id(slot) not in texts:
            texts[id(slot)] = {}
            slot.seen += nodes[0].seen
        # A slot that is met again adds no page twice.
        held = texts[id(slot)]
        for node in nodes:
            for x, n in node.texts():
                if n > held.get(x, 0):
                    slot.common[x] += n - held.get(x, 0)
                    held[x] = n
        for node in nodes:
            own = runs(node)
            met = {id(r): s for s, r in match(slot.children, own)}
            known = {c.label for c in slot.children}
            place = 0
            for r in own:
                s = met.get(id(r))
                if s is None and r[0].label not in known:
                    s = Slot(r[0].label)
                    slot.children.insert(place, s)
                if s is not None:
                    place = slot.children.index(s) + 1
                    todo.append((s, r))


def numbered(root: Slot) -> list[Slot]:
    out, todo = [], [root]
    while todo:
        slot = todo.pop()
        slot.number = len(out)
        out.append(slot)
        todo.extend(reversed(slot.children))
    return out


def align(root: Slot, tree: Node) -> list[tuple[Slot, Run]]:
    """Every slot that a page has, with its nodes; a slot below a repeated one comes once for each."""
    out: list[tuple[Slot, Run]] = []
    todo: list[tuple[Slot, Run]] = [(root, [tree])]
    while todo:
        slot, nodes = todo.pop()
        out.append((slot, nodes))
        for node in nodes:
            todo.extend(match(slot.children, runs(node)))
    return out


def add_page(sums: dict[int, Sums], root: Slot, tree: Node) -> None:
    """Count a page once for each slot that it has."""
    held: dict[int, Run] = defaultdict(list)
    slots = {}
    for slot, nodes in align(root, tree):
        held[slot.number] += nodes
        slots[slot.number] = slot
    for number, nodes in held.items():
        sums[number].add(nodes, slots[number].common)


def decide(root: Slot) -> None:
    """Find the content and the template of a wrapper from its sums.

    From the root down: the child with the most running text is followed as long as it is no
    part of a text itself, and what stands beside it is left out if it holds mostly links or,
    unless textual, little text.  Ties go to <article> or <main>, then to the first."""
    for slot in numbered(root):
        slot.template = frozenset(x for x, n in slot.sums.texts.items() if n >= OFTEN * slot.sums.pages)
    at = root
    while at.children:
        best = max(at.children, key=lambda c: (c.sums.running(), c.label.split(" ", 1)[0] in ("article", "main")))
        if best.textual or not best.sums.running() or at.sums.own / max(1, at.sums.pages) > best.sums.running():
            return
        whole = True
        for c in at.children:
            if c is best:
                continue
            linked = 2 * c.sums.links > c.sums.chars
            c.out = linked or not c.textual and c.sums.running() < BESIDE * best.sums.running()
            whole &= c.out or c.textual
        at.spine = best
        if not whole:
            return
        at = best


def dumps(root: Slot) -> bytes:
    """Flat, so that any depth can be written."""
    rows, parents = [], {id(root): -1}
    slots = numbered(root)
    for s in slots:
        rows.append((s.label, parents[id(s)], s.seen, dict(s.common), s.sums.row(), s.out, s.template, s.spine.number if s.spine else None))
        for c in s.children:
            parents[id(c)] = s.number
    return compress(pickle.dumps(rows), 1)


def loads(held: bytes) -> list[Slot]:
    """The slots by number; the first is the root."""
    rows = pickle.loads(decompress(held))
    slots = [Slot(r[0]) for r in rows]
    for slot, (_, parent, seen, common, sums, out, template, spine) in zip(slots, rows, strict=True):
        slot.seen, slot.common, slot.sums, slot.out, slot.template = seen, Counter(common), Sums(*sums), out, template
        slot.spine = slots[spine] if spine is not None else None
        if parent >= 0:
            slots[parent].children.append(slot)
    numbered(slots[0])
    return slots


def of_page(tree: Node) -> Slot:
    """A wrapper of one page."""
    root = Slot("#page")
    grow(root, tree)
    return root


def places(root: Slot) -> Iterator[tuple[int, Slot]]:
    """Every slot with a number for the labels on its way from the root."""
    todo = [(0, root)]
    while todo:
        above, slot = todo.pop()
        way = int.from_bytes(blake2b(f"{above} {slot.label}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        yield way, slot
        todo.extend((way, c) for c in slot.children)


def keep(root: Slot, ways: set[int], texts: set[int]) -> None:
    """Leave a wrapper with the slots of these places and with these texts."""
    kept = {id(slot) for way, slot in places(root) if way in ways}
    for slot in numbered(root):
        slot.children = [c for c in slot.children if id(c) in kept]
        slot.common = Counter({x: n for x, n in slot.common.items() if x in texts})


def settle(root: Slot) -> None:
    """Leave the texts that nearly all different pages of a whole wrapper have in common."""
    for slot in numbered(root):
        slot.common = Counter({x: n for x, n in slot.common.items() if root.seen >= LEAST and n >= OFTEN * root.seen})


def alone(tree: Node) -> Slot:
    """A wrapper of one page, decided by what that page holds."""
    root = of_page(tree)
    for slot in numbered(root):
        slot.common = Counter()
    sums: dict[int, Sums] = defaultdict(Sums)
    slots = numbered(root)
    add_page(sums, root, tree)
    for s in slots:
        s.sums = sums[s.number]
    decide(root)
    return root


def _marks(root: Slot, tree: Node) -> tuple[set[int], set[int], bool]:
    """Nodes that are left out whole, nodes whose own text is, and whether the page has the content."""
    out: set[int] = set()
    silent: set[int] = set()
    pairs = align(root, tree)
    had = {s.number for s, _ in pairs}
    aligned = {id(n) for _, nodes in pairs for n in nodes}
    for slot, nodes in pairs:
        if slot.out:
            out.update(map(id, nodes))
        if slot.template:
            silent.update(id(n) for n in nodes if n.own and n.text_hash() in slot.template)
        if slot.spine is None:
            continue
        usual = BESIDE * slot.spine.sums.running()
        for n in nodes:
            if n.own < usual:
                silent.add(id(n))
            for b in n.blocks:
                if id(b) not in aligned and b.tag not in _TEXTUAL:
                    one = Sums()
                    one.add([b], Counter())
                    if one.running() < usual:
                        out.add(id(b))
    at = root
    while at.spine is not None and at.spine.number in had:
        at = at.spine
    return out, silent, at.spine is None


def extract(page: str | None, root: Slot | None) -> str:
    """The blocks that the wrapper calls content, joined by line ends.

    A page that lacks the wrapper's content slot is judged by its own sums."""
    tree = parse(page)
    out, silent, there = _marks(root, tree) if root is not None else (set(), set(), False)
    if not there:
        out, silent, _ = _marks(alone(tree), tree)
    blocks: list[str] = []
    held: list[str] = []

    def flush(node: Node) -> None:
        line = " ".join("".join(held).split())
        if line and id(node) not in silent:
            blocks.append(line)
        held.clear()

    # Each entry: a node, its parts that are still to come, and the block it is in.
    todo = [(tree, iter(tree.parts), tree)]
    while todo:
        node, parts, block = todo[-1]
        part = next(parts, None)
        if part is None:
            todo.pop()
            if node is block:
                flush(node)
        elif isinstance(part, str):
            held.append(part)
        elif part.out or id(part) in out:
            if part.tag not in _INLINE:
                flush(block)
        elif part.tag in _INLINE:
            if part.tag == "br":
                held.append(" ")
            todo.append((part, iter(part.parts), block))
        else:
            flush(block)
            todo.append((part, iter(part.parts), part))
    return "\n".join(blocks)


def _domain(host: Column) -> Column:
    return F.concat(F.lit("*."), F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1))


def grouped(pages: DataFrame) -> DataFrame:
    """``group`` of each page: its host, or the domain of a host with fewer than LEAST different pages.

    The small hosts are written first, so that Spark knows their size before it plans the join: where
    they fit its broadcast threshold the pages are not shuffled."""
    small = pages.select("host", "hash").distinct().groupBy("host").count().where(F.col("count") < LEAST).select("host", F.lit(True).alias("small"))
    return pages.join(stored(small, "small-hosts"), "host", "left").withColumn("group", F.when(F.col("small"), _domain(F.col("host"))).otherwise(F.col("host"))).drop("small")


def merged_trees(pages: DataFrame) -> DataFrame:
    """group and tree (binary) of (group, hash, html): the tree of all different pages of each group.

    The trees of pages are dealt by hash to tasks of about FAN, merged, and the results again until a
    group has one tree; the page with the most text comes first.  A merged tree keeps the places
    that SHARED of the group's pages have and the texts that OFTEN of them have, both counted over all pages,
    so it grows with what pages have in common, not with their number."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            once = batch.drop_duplicates(["group", "hash"])
            read = list(map(parse, once["html"]))
            yield once[["group", "hash"]].assign(chars=[t.chars for t in read], tree=[dumps(of_page(t)) for t in read])

    of_pages = pages.mapInPandas(own, "group string, hash long, chars long, tree binary").dropDuplicates(["group", "hash"])
    of_pages = stored(of_pages, "page-trees")
    sizes = stored(of_pages.groupBy("group").agg(F.count("*").alias("size")), "sizes")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for group, tree in zip(batch["group"], batch["tree"], strict=True):
                held_by = list(places(loads(tree)[0]))
                found.update({(group, False, way) for way, _ in held_by})
                found.update({(group, True, x) for _, slot in held_by for x in slot.common})
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["group", "is_text", "key", "n"])

    counts = of_pages.select("group", "tree").mapInPandas(held, "group string, is_text boolean, key long, n long")
    counts = counts.groupBy("group", "is_text", "key").agg(F.sum("n").alias("n")).join(sizes, "group")
    shared = counts.where(F.when(F.col("is_text"), F.col("n") >= OFTEN * F.col("size")).otherwise(F.col("n") >= SHARED * F.col("size")))
    shared = shared.groupBy("group").agg(
        F.collect_list(F.when(~F.col("is_text"), F.col("key"))).alias("ways"), F.collect_list(F.when(F.col("is_text"), F.col("key"))).alias("texts")
    )
    shared = stored(shared, "shared")

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chars", "hash"], ascending=[False, True])
        root = Slot("#page")
        for tree in rows["tree"]:
            grow(root, loads(tree)[0])
        return pd.DataFrame({"group": [key[0]], "hash": [key[1]], "chars": [rows["chars"].iloc[0]], "tree": [dumps(root)]})

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree, ways, texts in zip(batch["tree"], batch["ways"], batch["texts"], strict=True):
                root = loads(tree)[0]
                keep(root, set(ways), set(texts))
                out.append(dumps(root))
            yield batch[["group", "hash", "chars"]].assign(tree=out)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree in batch["tree"]:
                root = loads(tree)[0]
                settle(root)
                out.append(dumps(root))
            yield pd.DataFrame({"group": batch["group"], "tree": out})

    columns = "group string, hash long, chars long, tree binary"
    dealt = of_pages.join(sizes, "group").withColumn("task", F.pmod("hash", F.ceil(F.col("size") / FAN)))
    trees = dealt.select("group", "hash", "chars", "tree", "task").groupBy("group", "task").applyInPandas(merged, columns)
    trees = trees.join(shared, "group").mapInPandas(bounded, columns)
    most = ceil((sizes.agg(F.max("size")).first()[0] or 0) / FAN)
    while most > 1:
        most = ceil(most / FAN)
        trees = trees.withColumn("task", F.floor(F.col("hash") / FAN)).groupBy("group", "task").applyInPandas(merged, columns)
    return stored(trees.mapInPandas(whole, "group string, tree binary"), "trees")


def wrappers(pages: DataFrame) -> DataFrame:
    """group and wrapper (binary) of (group, hash, html).

    The tree is that of all different pages of a group, the sums are of all its rows, added up in each
    task before they are shuffled: a group may have any share of the rows."""
    trees = merged_trees(pages)
    counted = Sums.__slots__[:5]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Slot] = {}
        for batch in batches:
            found: dict[tuple, Sums] = {}
            for group, rows in batch.groupby("group"):
                root = _held(known, group, rows["tree"].iloc[0])
                of: dict[int, Sums] = defaultdict(Sums)
                for page in rows["html"]:
                    add_page(of, root, parse(page))
                found.update({(group, number): s for number, s in of.items()})
            sums_of = [(*k, None, *s.row()) for k, s in found.items()]
            texts_of = [(*k, x, n, 0, 0, 0, 0) for k, s in found.items() for x, n in s.texts.items()]
            yield pd.DataFrame(sums_of + texts_of, columns=["group", "slot", "text", *counted]).astype({"text": "Int64"})

    columns = "group string, slot int, text long, " + ", ".join(f"{c} long" for c in counted)
    found = pages.join(trees, "group").select("group", "html", "tree").mapInPandas(sums, columns)
    # A row without text has a slot's sums; one with a text, the pages that have it there.
    total = found.groupBy("group", "slot", "text").agg(*(F.sum(c).alias(c) for c in counted))
    # A wrapper's slots are places that its pages share, however many pages the sums are of.
    by_group = total.groupBy("group").agg(F.collect_list(F.struct("slot", "text", *counted)).alias("sums"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = []
            for tree, rows in zip(batch["tree"], batch["sums"], strict=True):
                slots = loads(tree)
                for r in sorted(rows, key=lambda r: r["text"] is not None):
                    if r["text"] is None:
                        slots[r["slot"]].sums = Sums(*(r[c] for c in counted))
                    else:
                        slots[r["slot"]].sums.texts[r["text"]] = r["pages"]
                decide(slots[0])
                held.append(dumps(slots[0]))
            yield pd.DataFrame({"group": batch["group"], "wrapper": held})

    return trees.join(by_group, "group").mapInPandas(judged, "group string, wrapper binary")


def _held(known: dict[str, Slot], group: str, wrapper: bytes) -> Slot:
    if group not in known:
        if len(known) > 1000:
            known.clear()
        known[group] = loads(wrapper)[0]
    return known[group]


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of (page_id, url, html).

    A null html is empty and has an empty text; a null url belongs to the host ''.  A host with
    fewer than LEAST different pages shares its domain's wrapper; a group that is still smaller
    has no template, its content is chosen all the same.  Pages may be nested to any depth and leave
    tags and quotes open.  Repeated rows give equal rows, and each counts in the sums; copies
    count once among the pages that make up a wrapper and say what they have in common.  Ties of running text go to <article> or
    <main>, then to the first.  Other columns are left out."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("hash"))
    rows = grouped(read)
    known = stored(wrappers(rows.where("html is not null").select("group", "hash", "html")), "wrappers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Slot] = {}
        for batch in batches:
            texts = [
                extract(page, _held(held, group, wrapper) if wrapper is not None else None)
                for group, page, wrapper in zip(batch["group"], batch["html"], batch["wrapper"], strict=True)
            ]
            out = pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})
            yield out.assign(n_chars=out["text"].map(len))

    joined = rows.join(known, "group", "left").select("page_id", "url", "html", "group", "wrapper")
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
