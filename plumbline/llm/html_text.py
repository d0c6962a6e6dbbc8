"""Operator 9: HTML extraction by wrapper induction.

Pages become DOM trees whose nodes are block elements, and these slot trees: a slot
is an element, or the elements of one label that hold nothing but text in one
parent. A wrapper is induced for each host and layout (pages with the same elements
down to depth ``SKELETON``) in three steps:

1. A page of the layout, the one with the least hash, gives the wrapper's slots.
   Every other page's slot tree is aligned with it by simple tree matching: equal
   roots, and the heaviest order-preserving matching of their children.
2. Over all pages of the layout, each slot's pages, characters and characters in
   links are summed, and the pages that hold the same text in it are counted.
3. A text that nearly all pages with the slot hold is template. What varies is
   followed from the root to the slot that holds most of the pages' running text:
   the main region. Beside this way, slots that are mostly links, or whose text is
   short against the region's, are template, too; headings and paragraphs aren't,
   nor are siblings of the region's label.

Every page of the layout is aligned with the wrapper and loses what stands in
template slots. Where the alignment can't decide (reader comments are as long and
as various as an article), an element's kind does: its tag or a word of its class,
id or role names it as a menu, header, footer, sidebar, notice, advert, form or
reader comments; and where a page has an article or main element outside of those,
only text inside one is content. In an article, a heading's id says nothing, and a
section's only if it names reader comments or teasers. Layouts with fewer than
``LEAST`` different texts have no wrapper, and only kinds decide.

Pages with the same text don't tell template from content: they count once.

Blocks: block elements begin and end blocks, line breaks are white space. White
space of any kind in a block becomes one space.

Defined results: a null or empty html has an empty text; a url without a host is
one of the host ''. Repeated rows are extracted each; of pages with equal hashes the
one of the least slot tree counts; an empty table gives an empty table; other columns
are ignored. Long pages are taken whole, a few at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, freeing, slices, stored, stored_at

#: Different texts a template takes, and the share of the pages in which its text is the same.
LEAST, CONSTANT = 4, 0.9
#: A page's layout is the set of its elements down to this depth; html is at depth 1, body at 2.
SKELETON = 3
#: A slot with a larger share of its parent's running text is on the way to the main region.
MOST = 0.6
#: Beside that way, slots with a larger share of their text in links, or with less text a page than this share of the region's, are template.
LINKS, SHORT = 0.5, 0.1
#: Deeper elements belong to the slot at this depth; a parent of more slots has one for each label, or else for each tag.
DEPTH, WIDE = 48, 64
#: Up to so many bytes of wrappers are broadcast; more are joined, a layout's pages in so many tasks at least.
WRAPPERS_BROADCAST_BYTES, SALTS = 16_000_000, 16
#: Counts that a task gathers before it passes them on.
GATHERED = 200_000

# HTML's elements by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|object|svg|canvas|textarea|select|math|audio|video"
DROPPED = frozenset("nav footer aside form dialog menu head title button fieldset search".split())
#: Words in an element's class, id or role that mark it as no main text.
NO_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar\w*|aside|footer|header|masthead|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|respond|replies|"
    r"share|sharing|social|related|recommend\w*|widget|toolbar|copyright|complementary|contentinfo|search|skip)(?:$|[\s_-])",
    re.I,
)
#: Those that mark a section of an article as reader comments or teasers by its id, too.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies|related|recommend\w*|newsletter|subscribe|share|sharing|social)(?:$|[\s_-])", re.I)
_CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*/>|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|$)",
    re.S | re.I,
)
_DIGITS = re.compile(r"\d+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text, which are content however short.
PROSE = HEADINGS | frozenset("p pre blockquote figure figcaption dl table".split())
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _names(attrs: str, ids: bool = True) -> list[str]:
    """The values of an element's class, id and role."""
    return ["".join(values) for name, *values in _ATTR.findall(attrs or "") if ids or name.lower() != "id"]


class Node:
    """A block element with its own text before, between and after its children."""

    __slots__ = ("children", "drop", "label", "linked", "main", "parts", "tag")

    def __init__(self, label: str, drop: bool = False, main: bool = False, tag: str = ""):
        self.label, self.drop, self.main, self.tag = label, drop, main, tag
        self.children: list[Node] = []
        self.parts: list[str] = []  # raw text of the block being read
        self.linked = 0  # characters of it in links


def _flush(node: Node) -> None:
    """Makes a leaf of the text read so far."""
    if node.parts:
        text = " ".join(unescape("".join(node.parts)).split())
        linked, node.parts, node.linked = node.linked, [], 0
        if text:
            leaf = Node("#text", node.drop, node.main)
            leaf.parts, leaf.linked = [text], min(linked, len(text))
            node.children.append(leaf)


def parse(html: str) -> Node:
    """The tree of a page's block elements; text leaves hold one block's text each."""
    root = Node("#root")
    stack, tags = [root], ["#root"]
    at = link = 0  # link: how many elements were open where the open link began
    for m in _TOKEN.finditer(html):
        node = stack[-1]
        if m.start() > at:
            node.parts.append(part := html[at : m.start()])
            if len(stack) < link:
                link = 0
            if link:
                node.linked += len(part.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            node.parts.append(" ")
            continue
        if tag == "a":
            link = 0 if m["end"] else len(stack)
            continue
        if tag not in BLOCKS:
            continue
        _flush(node)
        if m["end"]:
            if tag in tags:
                while tags.pop() != tag:
                    _flush(stack.pop())
                _flush(stack.pop())
            continue
        while len(tags) > 1 and tag in _CLOSES.get(tags[-1], ()):
            _flush(stack.pop())
            tags.pop()
        node = stack[-1]
        if tag in VOID:
            continue
        attrs = m["attrs"]
        names = " ".join(_names(attrs))
        marked = names
        if node.main and (tag in HEADINGS or (tag == "section" and not READERS.search(names))):
            marked = " ".join(_names(attrs, False))
        named = tag not in ("html", "body", "article", "main") and NO_MAIN.search(marked)
        drop = node.drop or tag in DROPPED or (tag == "header" and not node.main) or bool(named)
        child = Node(f"{tag}.{names}" if names else tag, drop, node.main or tag in ("article", "main"), tag)
        node.children.append(child)
        stack.append(child)
        tags.append(tag)
    if at < len(html):
        stack[-1].parts.append(html[at:])
    for node in stack:
        _flush(node)
    return root


def leaves(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        if node.label == "#text":
            yield node
        todo.extend(reversed(node.children))


def text_leaves(root: Node, template: set[int] = frozenset()) -> list[Node]:
    """The leaves of the main text; template holds the ids of leaves that are no content."""
    blocks = [x for x in leaves(root) if not x.drop]
    if any(x.main for x in blocks):
        blocks = [x for x in blocks if x.main]
    return [x for x in blocks if id(x) not in template]


def page_text(root: Node, template: set[int] = frozenset()) -> str:
    return "\n".join(x.parts[0] for x in text_leaves(root, template))


class Slot:
    """A place of a page: an element, or its parent's elements of one label that hold text only. The texts (leaves) right in it are those that no inner slot has."""

    __slots__ = ("children", "label", "leaves", "main", "drop", "tag")

    def __init__(self, label: str, tag: str, drop: bool, main: bool):
        self.label, self.tag, self.drop, self.main = label, tag, drop, main
        self.children: list[Slot] = []
        self.leaves: list[Node] = []


def slots_of(root: Node) -> Slot:
    """A page's slot tree. Digits in labels don't tell elements apart."""
    top = Slot("#root", "#root", False, False)
    todo = [(root, top, 0, False)]
    while todo:
        node, slot, depth, many = todo.pop()
        inner = []
        for c in node.children:
            (slot.leaves if c.label == "#text" else inner).append(c)
        if depth == DEPTH:
            todo += [(c, slot, depth, many) for c in inner]
            continue
        many = many or len(inner) > WIDE  # of several elements in one slot, inner ones of one label share a slot, too
        labels = [_DIGITS.sub("", c.label) for c in inner]
        shared = {s.label: s for s in slot.children}
        if many and len(shared.keys() | labels) > WIDE:
            labels = [c.tag for c in inner]
        for c, label in zip(inner, labels, strict=True):
            joins = many or all(g.label == "#text" for g in c.children)
            found = shared.get(label) if joins else None
            if found is None:
                found = Slot(label, c.tag, c.drop, c.main)
                slot.children.append(found)
                if joins:
                    shared[label] = found
            todo.append((c, found, depth + 1, many))
    return top


def numbered_slots(top: Slot) -> list[Slot]:
    """The slots, parents before children, in the order that numbers a wrapper's slots."""
    out, todo = [], [top]
    while todo:
        slot = todo.pop()
        out.append(slot)
        todo.extend(reversed(slot.children))
    return out


class Matcher:
    """Simple tree matching: equal roots, and the heaviest order-preserving matching of their children."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}
        self.choices: dict[tuple[int, int], list[list[int]]] = {}

    def weight(self, a: Slot, b: Slot) -> int:
        if a.label != b.label:
            return 0
        if not a.children or not b.children:
            return 1
        key = (id(a), id(b))
        if key not in self.known:
            rows = [[0] * (len(b.children) + 1)]
            for x in a.children:
                before, now = rows[-1], [0]
                for j, y in enumerate(b.children):
                    best = before[j + 1] if before[j + 1] > now[j] else now[j]
                    if x.label == y.label and (both := before[j] + self.weight(x, y)) > best:
                        best = both
                    now.append(best)
                rows.append(now)
            self.choices[key] = rows
            self.known[key] = rows[-1][-1] + 1
        return self.known[key]

    def pairs(self, a: Slot, b: Slot) -> Iterator[tuple[Slot, Slot]]:
        """The nodes matched with each other."""
        todo = [(a, b)] if self.weight(a, b) else []
        while todo:
            a, b = todo.pop()
            yield a, b
            rows = self.choices.get((id(a), id(b)))
            if rows is None:
                continue
            i, j = len(a.children), len(b.children)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((a.children[i], b.children[j]))


def _hash(data: str | bytes) -> int:
    """52 bits, which JSON keeps."""
    return xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data) >> 12


def layout_of(root: Node) -> int:
    """The hash of the set of paths down to depth SKELETON."""
    paths: set[int] = set()
    todo = [(root, 0, 0)]
    while todo:
        node, above, level = todo.pop()
        if node.label != "#text" and level <= SKELETON:
            path = xxhash.xxh3_64_intdigest(node.label.encode("utf-8", "surrogatepass"), above)
            paths.add(path)
            todo += [(c, path, level + 1) for c in node.children]
    return _hash(b"".join(x.to_bytes(8, "little") for x in sorted(paths)))


def packed_tree(top: Slot, texts: bool) -> str:
    """A slot tree as JSON: [label's hash, tag, is dropped, is main, children], and with ``texts`` also [hash, characters, in links] of each text."""
    made: dict[int, list] = {}
    for slot in reversed(numbered_slots(top)):
        row = [_hash(slot.label), slot.tag, int(slot.drop), int(slot.main), [made.pop(id(c)) for c in slot.children]]
        if texts:
            row.append([[_hash(x.parts[0]), len(x.parts[0]), x.linked] for x in slot.leaves])
        made[id(slot)] = row
    return json.dumps(made[id(top)], separators=(",", ":"))


def unpacked_tree(packed: str) -> tuple[Slot, dict[int, list]]:
    """The slots of a packed tree, whose labels are hashes, and their texts by the slots' ids."""
    texts: dict[int, list] = {}

    def one(row: list) -> Slot:
        slot = Slot(row[0], row[1], bool(row[2]), bool(row[3]))
        slot.children = [one(c) for c in row[4]]
        texts[id(slot)] = row[5] if len(row) > 5 else []
        return slot

    return one(json.loads(packed)), texts


def placed(wrapper: Slot, page: Slot) -> dict[int, int]:
    """For each slot of a page, by its id: the number of the wrapper's slot that it, or else the nearest slot around it, is matched with."""
    number = {id(s): k for k, s in enumerate(numbered_slots(wrapper))}
    matched = {id(b): number[id(a)] for a, b in Matcher().pairs(wrapper, page)}
    out: dict[int, int] = {}
    todo = [(page, 0)]
    while todo:
        slot, around = todo.pop()
        here = out[id(slot)] = matched.get(id(slot), around)
        todo += [(c, here) for c in slot.children]
    return out


def sums_of(wrapper: Slot, page: Slot, texts: dict[int, list]) -> Iterator[tuple[int, int, int, int]]:
    """Per slot of the wrapper that a page has: (slot, 0, characters, in links), and per different text in it: (slot, the text's hash, characters, in links)."""
    at = placed(wrapper, page)
    found: dict[tuple[int, int], list[int]] = {}
    for slot, k in at.items():
        whole = found.setdefault((k, 0), [0, 0])
        for key, chars, linked in texts[slot]:
            whole[0] += chars
            whole[1] += linked
            part = found.setdefault((k, key or 1), [0, 0])
            part[0] += chars
            part[1] += linked
    return ((k, key, c, n) for (k, key), (c, n) in found.items())


def decide(top: Slot, sums: dict[int, tuple[int, int, int]], fixed: dict[int, tuple[int, int]], kinds: bool = True) -> set[int]:
    """The numbers of template slots. sums: by slot (pages, characters, in links); fixed: characters and those in links of the texts that are template."""
    slots = numbered_slots(top)
    number = {id(s): k for k, s in enumerate(slots)}
    mass, chars, linked = [0.0] * len(slots), [0.0] * len(slots), [0.0] * len(slots)
    for k in range(len(slots) - 1, -1, -1):
        _, c, n = sums.get(k, (0, 0, 0))
        fc, fn = fixed.get(k, (0, 0))
        inner = [number[id(x)] for x in slots[k].children]
        chars[k], linked[k] = c - fc + sum(chars[i] for i in inner), n - fn + sum(linked[i] for i in inner)
        mass[k] = chars[k] - linked[k]
    if mass[0] <= 0:
        return set()
    region, beside = 0, []
    while True:
        inner = [number[id(x)] for x in slots[region].children if x.children]
        best = max(inner, key=lambda i: (mass[i], -i), default=None)
        if best is None or mass[best] <= MOST * mass[region] or (kinds and slots[region].tag in ("article", "main")):
            break
        beside += [i for i in (number[id(x)] for x in slots[region].children) if i != best and slots[i].label != slots[best].label]
        region = best
    page = mass[region] / max(1, sums.get(region, (1, 0, 0))[0])
    out: set[int] = set()
    for i in beside:
        pages = max(1, sums.get(i, (1, 0, 0))[0])
        running = slots[i].tag in PROSE
        if (chars[i] > 0 and linked[i] > LINKS * chars[i]) or (not running and mass[i] / pages < SHORT * page):
            out |= {number[id(x)] for x in numbered_slots(slots[i])}
    return out


class Wrapper:
    """A layout's slots, its template slots, and the texts that are template in a slot."""

    def __init__(self, packed: str, kinds: bool = True):
        tree, rows, texts = json.loads(packed)
        self.top, _ = unpacked_tree(tree)
        self.texts = {(k, key) for k, key, _, _ in texts}
        fixed: dict[int, tuple[int, int]] = {}
        for k, _, c, n in texts:
            a, b = fixed.get(k, (0, 0))
            fixed[k] = a + c, b + n
        self.slots = decide(self.top, {k: (p, c, n) for k, p, c, n in rows}, fixed, kinds)

    def template(self, root: Node) -> set[int]:
        """The ids of a page's leaves that are template."""
        page = slots_of(root)
        for slot in numbered_slots(page):
            slot.label = _hash(slot.label)
        at = placed(self.top, page)
        return {id(x) for s in numbered_slots(page) for x in s.leaves if at[id(s)] in self.slots or (at[id(s)], _hash(x.parts[0]) or 1) in self.texts}


def profile(html: str) -> tuple[int, int, str, str]:
    """What a page tells of its host's wrapper: its layout, its text's hash, its slot tree without and with texts' hashes."""
    root = parse(html)
    top = slots_of(root)
    return layout_of(root), _hash(page_text(root)), packed_tree(top, False), packed_tree(top, True)


def induce(pages: list[str]) -> dict[int, str]:
    """The wrappers of same-host pages by layout. templates() does the same for all hosts at once."""
    layouts: dict[int, dict[int, tuple[str, str]]] = {}
    for layout, text, tree, full in map(profile, pages):
        of = layouts.setdefault(layout, {})
        of[text] = min(of.get(text, (tree, full)), (tree, full))
    out = {}
    for layout, of in layouts.items():
        if len(of) < LEAST:
            continue
        tree = min((text, t) for text, (t, _) in of.items())[1]
        top, _ = unpacked_tree(tree)
        sums: dict[tuple[int, int], list[int]] = {}
        for _, full in of.values():
            for k, key, chars, linked in sums_of(top, *unpacked_tree(full)):
                row = sums.setdefault((k, key), [0, 0, 0])
                for i, x in enumerate((1, chars, linked)):
                    row[i] += x
        rows = sorted([k, *x] for (k, key), x in sums.items() if not key)
        held = {k: x[0] for (k, key), x in sums.items() if not key}
        texts = sorted([k, key, x[1], x[2]] for (k, key), x in sums.items() if key and x[0] >= LEAST * CONSTANT and x[0] >= CONSTANT * held[k])
        out[layout] = json.dumps([tree, rows, texts], separators=(",", ":"))
    return out


def text_of(html: str, wrapper_of: Callable[[int], Wrapper | None], kinds: bool = True) -> str:
    """A page's main text; wrapper_of gives a layout's wrapper. Without ``kinds`` nothing but the wrapper decides."""
    root = parse(html)
    wrapper = wrapper_of(layout_of(root))
    template = wrapper.template(root) if wrapper else set()
    if kinds:
        return page_text(root, template)
    return "\n".join(x.parts[0] for x in leaves(root) if id(x) not in template)


def templates(rows: DataFrame) -> DataFrame:
    """(host, layout, wrapper) of the layouts of rows (host, html) that show one."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [profile(html) for html in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["host", "layout", "text", "tree", "full"])

    marked = rows.filter("html is not null").select("host", "html").mapInArrow(freeing(mark), "host string, layout long, text long, tree string, full string")
    pages, pages_at = stored_at(marked.groupBy("host", "layout", "text").agg(F.min(F.struct("tree", "full")).alias("m")).select("host", "layout", "text", "m.*"), "profiles")
    first = pages.groupBy("host", "layout").agg(F.min(F.struct("text", "tree"))["tree"].alias("tree"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).drop("n")
    first, first_at = stored_at(first, "trees")
    held = pages.withColumn("salt", F.pmod("text", F.lit(SALTS)).cast("int")).drop("tree")
    joined = held.join(*_dealt(first, "tree", held))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "layout", "slot", "key", "pages", "chars", "linked"]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        sums: dict[tuple, list[int]] = {}

        def made() -> pa.RecordBatch:
            cols = zip(*((*k, *x) for k, x in sums.items()), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            sums.clear()
            return out

        trees: dict[str, Slot] = {}
        for batch in slices(batches, 256):
            for host, layout, tree, full in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tree not in trees:
                    if len(trees) > 256:
                        trees.clear()
                    trees[tree] = unpacked_tree(tree)[0]
                for k, key, chars, linked in sums_of(trees[tree], *unpacked_tree(full)):
                    row = sums.setdefault((host, layout, k, key), [0, 0, 0])
                    row[0] += 1
                    row[1] += chars
                    row[2] += linked
            if len(sums) > GATHERED:
                yield made()
        if sums:
            yield made()

    counted = joined.select("host", "layout", "tree", "full").mapInArrow(freeing(count), "host string, layout long, slot int, key long, pages long, chars long, linked long")
    counted = counted.groupBy("host", "layout", "slot", "key").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "linked")))
    counted, counted_at = stored_at(counted.filter((F.col("key") == 0) | (F.col("pages") >= LEAST * CONSTANT)), "slots")
    whole = counted.filter("key = 0").drop("key")
    same = ["host", "layout", "slot"]
    texts = counted.filter("key != 0").join(whole.select(*same, F.col("pages").alias("of")), same).filter(F.col("pages") >= CONSTANT * F.col("of"))
    rows_of = whole.groupBy("host", "layout").agg(F.array_sort(F.collect_list(F.array(*(F.col(c).cast("long") for c in ("slot", "pages", "chars", "linked"))))).alias("rows"))  # a row per slot of one page
    texts_of = texts.groupBy("host", "layout").agg(F.array_sort(F.collect_list(F.array(*(F.col(c).cast("long") for c in ("slot", "key", "chars", "linked"))))).alias("texts"))  # at most 1 / CONSTANT texts of one page
    both = first.join(rows_of, ["host", "layout"]).join(texts_of, ["host", "layout"], "left")
    parts = [F.to_json(F.array("tree")), F.to_json("rows"), F.coalesce(F.to_json("texts"), F.lit("[]"))]
    wrapper = F.concat(F.lit("["), F.expr("substring(j, 2, length(j) - 2)"), F.lit(","), parts[1], F.lit(","), parts[2], F.lit("]"))
    out = stored(both.withColumn("j", parts[0]).select("host", "layout", wrapper.alias("wrapper")), "wrappers")
    for path in (pages_at, first_at, counted_at):
        discard(rows.sparkSession, path)
    return out


def _dealt(small: DataFrame, value: str, held: DataFrame) -> tuple:
    """What held (host, layout, salt, ...) is joined with: small (host, layout, value), broadcast if its size is known to be small, or else once
    for each salt, so that no task gets a layout's pages alone."""
    total = small.agg(F.coalesce(F.sum(F.octet_length(value) + F.octet_length("host") + 16), F.lit(0)).alias("b")).first()["b"]
    if total <= WRAPPERS_BROADCAST_BYTES:
        return F.broadcast(small), ["host", "layout"]
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "layout", "salt"]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(ascii_lower(F.regexp_extract(F.col(url_col), "://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    wrappers = templates(rows)
    total = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 16), F.lit(0)).alias("b")).first()["b"]
    known = None
    if total <= WRAPPERS_BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): r["wrapper"] for r in wrappers.toLocalIterator()})
    else:

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 256):
                found = [layout_of(parse(html or "")) for html in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["page_id", "url", "html", "host", "layout"])

        rows = rows.mapInArrow(freeing(lay), f"page_id {kind}, url string, html string, host string, layout long").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int"))
        rows = rows.join(*_dealt(wrappers, "wrapper", rows), "left")
    rows = rows.select("page_id", "url", "html", "host", *([] if known else ["wrapper"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Wrapper] = {}

        def load(packed: str | None) -> Wrapper | None:
            if packed is None:
                return None
            if packed not in loaded:
                if len(loaded) > 256:
                    loaded.clear()
                loaded[packed] = Wrapper(packed)
            return loaded[packed]

        for batch in slices(batches, 256):
            texts = []
            for i, html in enumerate(batch.column(2).to_pylist()):
                if known:
                    name = batch.column(3)[i].as_py()
                    texts.append(text_of(html or "", lambda layout, name=name: load(known.value.get((name, layout)))))
                else:
                    wrapper = batch.column(4)[i].as_py()
                    texts.append(text_of(html or "", lambda _, wrapper=wrapper: load(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(freeing(run), f"page_id {kind}, url string, text string, n_chars long")
