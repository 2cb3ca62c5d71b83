"""Wrapper induction: what the pages of one host have in common is template, what varies is content.

1. Every page with at least one HTML element becomes a tree of elements and text leaves. Equal
   pages of a host are one tree that counts as often as it is there.
2. The pages of a host are dealt into parts of about PAGES by the hash of their texts, and each
   part is folded into a wrapper. A page is aligned with the wrapper by simple tree matching: nodes
   match if they have one name, children keep their order, and the alignment with most matched
   nodes counts. Matched text leaves count their texts; what the wrapper does not have yet is put
   in between.
3. A part hands on the nodes and texts that SHARE of its own pages have. What SHARE of all pages
   have, SHARE of the pages of some part have, so no page, node or text is left out for its number.
   The parts of a host are aligned with each other in the same way, in two rounds of about the
   square root of their number.
4. Every page is aligned with its host's wrapper, and its nodes and texts are counted again. A text
   that SHARE of all pages have in one leaf is a constant node, so template. The texts of the other
   leaves vary: slots, whose content stays. Tree matching looks for most matched nodes, not for the
   right ones: where a template text stands among optional elements of the same names, its pages
   can be spread over several leaves, and it stays.
5. Every page is aligned with the constant nodes of its host and loses the constant texts.

Defined results: null, empty and pages without an element are returned as they are; a host with
fewer than LEAST_PAGES trees has no template; a null host is a host of its own; an empty table
gives no wrappers. The result does not depend on the order of the rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import Scratch

# Element names of the HTML standard, obsolete ones included.
HTML_ELEMENTS = """
a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br
button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed
fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img
input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol
optgroup option output p param picture plaintext pre progress q rp rt ruby s samp script search section select slot
small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title
tr track tt u ul var video wbr xmp
"""
# Tags of wiki text.
WIKI_TAGS = "ref references nowiki gallery syntaxhighlight poem includeonly noinclude onlyinclude"
_NAMES = "|".join(sorted([*HTML_ELEMENTS.split(), *WIKI_TAGS.split()], key=len, reverse=True))
_ATTR = r"""(?:\s+[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*"""
TAG = re.compile(rf"<(/?)({_NAMES})(?=[\s/>])({_ATTR})\s*/?>", re.I)

#: Pages of a host that are folded at a time (all are), and the fewest that show what is constant.
PAGES, LEAST_PAGES = 64, 8
#: Largest tree that ``induce`` takes unless told otherwise; ``wrappers`` takes trees of any size.
LARGEST = 500
#: Elements nested deeper are kept, as children of this level, so that no page is too deep.
DEEPEST = 100
#: Part of the pages that have to share a text in one place.
SHARE = 0.5
#: Children from which a row of an alignment is computed by NumPy, and cells from which only some rows are held.
WIDE, CELLS = 64, 1_000_000
#: Weights that a worker keeps of one wrapper for the next page, entries of all wrappers, and sums before they are sent.
KEPT, KEPT_ALL, SUMS = 5_000, 2_500_000, 100_000
# Elements without content, and elements whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPTIONAL = frozenset("p li dt dd td th tr option".split())
_TEXT, _ROOT = "#text", "#root"


@dataclass
class Node:
    """An element, or a text leaf whose place in the source is ``start`` to ``end``."""

    name: str
    kids: list[Node] = field(default_factory=list)
    text: str = ""
    start: int = 0
    end: int = 0

    @property
    def texts(self) -> tuple[str, ...]:
        return (self.text,) if self.name == _TEXT else ()


@dataclass
class Part:
    """A node of a wrapper: how many pages had it, and for text leaves which texts."""

    name: str
    seen: int
    kids: list[Part] = field(default_factory=list)
    texts: Counter = field(default_factory=Counter)


def tree(text: str) -> Node | None:
    """The page's tree, None without an element. End tags that close nothing are left out."""
    root = Node(_ROOT)
    open_, at, any_ = [root], 0, False

    def leaf(stop: int) -> None:
        if text[at:stop].strip():
            open_[-1].kids.append(Node(_TEXT, text=" ".join(text[at:stop].split()), start=at, end=stop))

    for m in TAG.finditer(text):
        leaf(m.start())
        at, name, any_ = m.end(), m[2].lower(), True
        if m[1]:
            depth = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].name == name), 0)
            if depth:
                del open_[depth:]
            continue
        if name in OPTIONAL and open_[-1].name == name:
            open_.pop()
        node = Node(name)
        open_[-1].kids.append(node)
        if name not in VOID and len(open_) < DEEPEST:
            open_.append(node)
    leaf(len(text))
    return root if any_ else None


def _walk(a: Part) -> Iterator[Part]:
    todo = [a]
    while todo:
        a = todo.pop()
        yield a
        todo += a.kids


class Match:
    """The best alignments of trees with one wrapper.

    Trees that look the same to the wrapper have one shape, a number, and are weighed once: texts
    that it does not have are all alike. To the parts of the wrapper that have none of a tree's
    texts the tree weighs what its ``plain`` shape weighs, which has no texts.
    """

    def __init__(self, wrapper: Part) -> None:
        self.wrapper = wrapper
        self.place = {id(x): i for i, x in enumerate(_walk(wrapper))}
        self.having: dict[str, set[int]] = {}
        self.full: dict[int, int] = {}
        self._have(wrapper, [])
        self.number: dict[tuple, int] = {}
        self.shapes: list[tuple[str, frozenset[str], tuple[int, ...]]] = []
        self.plain: list[int] = []
        self.most: list[int] = []
        self.near: list[set[int]] = []
        self.known: dict[tuple[int, int], int] = {}
        self.below: dict[tuple[int, int], list[tuple[int, str | None]]] = {}

    def _have(self, a: Part, above: list[int]) -> None:
        """``having``: the parts that have a text in or below them; ``full``: the most that a part can weigh, as ``most`` of a shape."""
        above.append(id(a))
        for t in a.texts:
            self.having.setdefault(t, set()).update(above)
        for x in a.kids:
            self._have(x, above)
        above.pop()
        self.full[id(a)] = 1 + bool(a.texts) + sum(self.full[id(x)] for x in a.kids)

    def shape(self, b: Part | Node) -> int:
        return self._number(b.name, frozenset(t for t in b.texts if t in self.having), tuple([self.shape(y) for y in b.kids]))

    def _number(self, *key) -> int:
        if key not in self.number:
            name, texts, kids = key
            bare = (name, frozenset(), tuple([self.plain[y] for y in kids]))
            plain = None if bare == key else self._number(*bare)
            self.number[key] = len(self.shapes)
            self.shapes.append(key)
            self.plain.append(self.number[key] if plain is None else plain)
            self.most.append(1 + bool(texts) + sum(self.most[y] for y in kids))
            self.near.append(set().union(*(self.having[t] for t in texts), *(self.near[y] for y in set(kids))))
        return self.number[key]

    def weigh(self, a: Part, shape: int) -> int:
        """Matched nodes of the best alignment of two trees."""
        name, texts, kids = self.shapes[shape]
        if a.name != name:
            return 0
        if id(a) not in self.near[shape] and self.plain[shape] != shape:
            return self.weigh(a, self.plain[shape])
        key = (id(a), shape)
        if key not in self.known:
            row, ends = [0], 0
            if a.kids and kids:
                lead, tail = self._ends(a.kids, kids) if len(kids) >= WIDE else (0, 0)
                ends = sum(self.most[y] for y in kids[:lead] + kids[len(kids) - tail :])
                for row in self._rows(a.kids[lead : len(a.kids) - tail], kids[lead : len(kids) - tail]):
                    pass
            self.known[key] = 1 + ends + int(row[-1]) + any(t in a.texts for t in texts)
        return self.known[key]

    def _ends(self, parts: list[Part], shapes: tuple[int, ...], first: bool = True) -> tuple[int, int]:
        """How many children match wholly at the first (if asked) and the last end, so that neither can weigh more with another partner."""

        def same(x: Part, y: int) -> bool:
            return self.full[id(x)] == self.most[y] == self.weigh(x, y)

        n, lead, tail = min(len(parts), len(shapes)), 0, 0
        while tail < n and same(parts[-1 - tail], shapes[-1 - tail]):
            tail += 1
        while first and lead < n - tail and same(parts[lead], shapes[lead]):
            lead += 1
        return lead, tail

    def _rows(self, parts: list[Part], shapes: tuple[int, ...], row: list | np.ndarray | None = None) -> Iterator[list | np.ndarray]:
        """Most matched nodes of the first parts with the first shapes: after ``row``, one row for every part."""
        if len(shapes) < WIDE:
            row = [0] * (len(shapes) + 1) if row is None else row
            yield row
            named = [(y, self.shapes[y][0]) for y in shapes]
            for x in parts:
                new, best = [0], 0
                for j, (y, name) in enumerate(named):
                    best = max(best, row[j + 1])
                    if name == x.name:
                        best = max(best, row[j] + self.weigh(x, y))
                    new.append(best)
                row = new
                yield row
            return
        kinds, which = np.unique(np.array([self.plain[y] for y in shapes]), return_inverse=True)
        at: dict[int, list[int]] = {}
        for j, y in enumerate(shapes):
            at.setdefault(y, []).append(j)
        near: dict[int, list[int]] = {id(x): [] for x in parts}
        for y in at:
            for x in near.keys() & self.near[y]:
                near[x].append(y)
        row = np.zeros(len(shapes) + 1, np.int64) if row is None else row
        yield row
        for x in parts:
            w = np.array([self.weigh(x, y) for y in kinds.tolist()], np.int64)[which]
            for y in near[id(x)]:
                w[at[y]] = self.weigh(x, y)
            row = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))])
            yield row

    def pairs(self, a: Part, shapes: tuple[int, ...]) -> list[tuple[int | None, int | None]]:
        """Places of the aligned children in order, None where one side has no partner."""
        _, tail = self._ends(a.kids, shapes, False)
        out = [(len(a.kids) - t, len(shapes) - t) for t in range(1, tail + 1)]
        parts, shapes = a.kids[: len(a.kids) - tail], shapes[: len(shapes) - tail]
        m, n = len(parts), len(shapes)
        step = m + 1 if m * n < CELLS else isqrt(m) + 1  # of a large table every step-th row is held, the others are computed again
        held = [r for i, r in enumerate(self._rows(parts, shapes)) if i % step == 0] if step <= m else [None]
        first, best = -1, []
        while m:
            if first != (m - 1) // step * step:
                first = (m - 1) // step * step
                best = list(self._rows(parts[first : first + step], shapes, held[first // step]))
            above, row = best[m - 1 - first], best[m - first]
            w = self.weigh(parts[m - 1], shapes[n - 1]) if n else 0
            if w and row[n] == above[n - 1] + w:
                m, n = m - 1, n - 1
                out.append((m, n))
            elif n and row[n] == row[n - 1]:
                n -= 1
                out.append((None, n))
            else:
                m -= 1
                out.append((m, None))
        out += [(None, j) for j in range(n - 1, -1, -1)]
        return out[::-1]

    def matched(self, shape: int, a: Part | None = None) -> list[tuple[int, str | None]]:
        """(place in the wrapper, text): once without a text for every matched node, and once for every text that both have."""
        a = a or self.wrapper
        shape = shape if id(a) in self.near[shape] else self.plain[shape]
        key = (id(a), shape)
        if key not in self.below:
            _, texts, kids = self.shapes[shape]
            out = [(self.place[id(a)], t) for t in [None, *(t for t in texts if t in a.texts)]]
            for i, j in self.pairs(a, kids) if a.kids and kids else ():
                if i is not None and j is not None:
                    out += self.matched(kids[j], a.kids[i])
            self.below[key] = out
        return self.below[key]


def _as_part(b: Node, n: int = 1) -> Part:
    return Part(b.name, n, [_as_part(x, n) for x in b.kids], Counter({t: n for t in b.texts}))


def _fold(a: Part, b: Part) -> None:
    """Adds what ``b`` has, which then belongs to ``a``."""
    match = Match(a)
    todo = [(a, b, match.shape(b))]
    while todo:
        a, b, shape = todo.pop()
        a.seen += b.seen
        a.texts.update(b.texts)
        _, _, shapes = match.shapes[shape]
        aligned = match.pairs(a, shapes)
        todo += [(a.kids[i], b.kids[j], shapes[j]) for i, j in aligned if i is not None and j is not None]
        a.kids = [b.kids[j] if i is None else a.kids[i] for i, j in aligned]


def _folded(parts: Iterable[Part]) -> Part | None:
    wrapper = None
    for b in parts:
        if wrapper is None:
            wrapper = b
        else:
            _fold(wrapper, b)
    return wrapper


def induce(pages: list[str], counts: list[int] | None = None, largest: int | None = LARGEST) -> tuple[Part | None, int]:
    """(wrapper, number of trees) of the pages of one host, in a fixed order, each as often as ``counts`` says."""
    some = [(tree(page), n) for page, n in zip(pages, counts or repeat(1))]
    some = [(b, n) for b, n in some if b is not None and (largest is None or _size(b) <= largest)]
    return _folded(_as_part(b, n) for b, n in some), sum(n for _, n in some)


def _constant(a: Part, pages: int) -> tuple[Part | None, int]:
    """The wrapper cut to the nodes that SHARE of the pages have, texts to the constant ones, and their number."""
    if a.seen < SHARE * pages:
        return None, 0
    texts = Counter({t: n for t, n in a.texts.items() if n >= SHARE * pages})
    kids, found = [], len(texts)
    for x in a.kids:
        part, n = _constant(x, pages)
        if part:
            kids.append(part)
            found += n
    return Part(a.name, a.seen, kids, texts), found


def _dump(a: Part) -> list:
    return [a.name, sorted(a.texts), [_dump(x) for x in a.kids]]


def _load(a: list) -> Part:
    return Part(a[0], 1, [_load(x) for x in a[2]], Counter(a[1]))


_LOADED: dict[str, Match] = {}


def _loaded(wrapper: str) -> Match:
    """The alignments with a wrapper, kept from page to page."""
    match = _LOADED.get(wrapper)
    if match is None:
        if sum(KEPT + len(m.place) for m in _LOADED.values()) > KEPT_ALL:
            _LOADED.clear()
        match = _LOADED[wrapper] = Match(_load(json.loads(wrapper)))
    elif len(match.shapes) + len(match.known) + len(match.below) > KEPT:
        match = _LOADED[wrapper] = Match(match.wrapper)
    return match


def without_template(text: str | None, wrapper: str) -> str | None:
    """The page without the texts that its wrapper holds as constant."""
    b = tree(text) if text else None
    if b is None:
        return text
    match = _loaded(wrapper)
    cut, todo = [], [(match.wrapper, b, match.shape(b))]
    while todo:
        a, node, shape = todo.pop()
        if node.name == _TEXT:
            if node.text in a.texts:
                cut.append((node.start, node.end))
            continue
        _, _, shapes = match.shapes[shape]
        todo += [(a.kids[i], node.kids[j], shapes[j]) for i, j in match.pairs(a, shapes) if i is not None and j is not None]
    out, at = [], 0
    for start, end in sorted(cut):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def wrappers(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(q_host, q_pages, q_nodes, q_constant, q_wrapper): one row per host with at least one tree.

    Every page of a host counts. A task folds about PAGES pages at a time, or joins about as many
    wrappers as the square root of the host's parts; the counts of the pages are summed before the shuffle.
    """
    kind = dict(df.dtypes)[host]
    scratch = Scratch(df.sparkSession, "wrappers")
    same = F.col("q_host").eqNullSafe(F.col("q_of"))
    rows = df.where(F.col(text).rlike("<[A-Za-z/]")).select(F.col(host).alias("q_host"), F.col(text).alias("q_text"))
    pages = scratch.save(rows.groupBy("q_host", "q_text").agg(F.count("*").alias("q_n")), "pages")
    parts = pages.groupBy(F.col("q_host").alias("q_of")).agg(F.ceil(F.count("*") / PAGES).alias("q_parts"))
    dealt = pages.join(parts, same).select("q_host", "q_parts", F.xxhash64("q_text").alias("q_h"), "q_text", "q_n")
    dealt = dealt.withColumn("q_part", F.pmod("q_h", "q_parts"))

    def row(t: pa.Table, found: Part | None, pages: int) -> pa.Table:
        out = t.select(["q_host", "q_parts", "q_part"]).slice(0, 1 if found else 0)
        out = out.append_column("q_pages", pa.array([pages] * out.num_rows, pa.int64()))
        return out.append_column("q_wrapper", pa.array([json.dumps(_dump(found)) if found else None] * out.num_rows, pa.string()))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("q_h", "ascending"), ("q_text", "ascending")])
        found, pages = induce(t["q_text"].to_pylist(), t["q_n"].to_pylist(), None)
        return row(t, _constant(found, pages)[0] if found else None, pages)

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("q_part")
        return row(t, _folded(_load(json.loads(w)) for w in t["q_wrapper"].to_pylist()), sum(t["q_pages"].to_pylist()))

    schema = f"q_host {kind}, q_parts bigint, q_part bigint, q_pages bigint, q_wrapper string"
    fitted = dealt.groupBy("q_host", "q_part").applyInArrow(fit, schema)
    some = fitted.groupBy("q_host", F.pmod("q_part", F.ceil(F.sqrt("q_parts"))).alias("q_group")).applyInArrow(join, schema)
    joined = scratch.save(some.groupBy("q_host").applyInArrow(join, schema).select("q_host", "q_pages", "q_wrapper"), "joined")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            hosts, places, texts, n = zip(*((*k, n) for k, n in sums.items())) if sums else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(hosts, like), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["q_host", "q_place", "q_text", "q_n"])

        like = None
        for b in batches:
            like, seen = b.schema.field(0).type, Counter()
            for at, page, n, w in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = tree(page)
                if found is not None:
                    match = _loaded(w)
                    seen[at, match, match.shape(found)] += n
            for (at, match, shape), n in seen.items():
                for place, t in match.matched(shape):
                    sums[at, place, t] += n
            if len(sums) > SUMS:
                yield out()
                sums.clear()
        if sums:
            yield out()

    # a wrapper without texts has no constant ones: each of its leaves has an empty list
    asked = joined.where((F.col("q_pages") >= LEAST_PAGES) & F.col("q_wrapper").contains(f'["{_TEXT}", ["')).select(F.col("q_host").alias("q_of"), "q_wrapper")
    counts = pages.join(asked, same).select("q_host", "q_text", "q_n", "q_wrapper").mapInArrow(count, f"q_host {kind}, q_place bigint, q_text string, q_n bigint")
    counts = counts.groupBy("q_host", "q_place", "q_text").agg(F.sum("q_n").alias("q_n"))

    def finish(t: pa.Table, counts: pa.Table) -> pa.Table:
        out = t.select(["q_host"])
        if not t.num_rows:
            found, pages, size, slim, n = None, 0, 0, None, 0
        else:
            found, pages = _load(json.loads(t["q_wrapper"][0].as_py())), t["q_pages"][0].as_py()
            nodes = list(_walk(found))
            for x in nodes:
                x.seen, x.texts = 0, Counter()
            for place, text_, times in zip(*(counts[c].to_pylist() for c in ("q_place", "q_text", "q_n"))):
                if text_ is None:
                    nodes[place].seen = times
                else:
                    nodes[place].texts[text_] = times
            size, (slim, n) = len(nodes), _constant(found, pages)
        for name, value in (("q_pages", pages), ("q_nodes", size), ("q_constant", n)):
            out = out.append_column(name, pa.array([value] * out.num_rows, pa.int32()))
        return out.append_column("q_wrapper", pa.array([json.dumps(_dump(slim)) if slim else None] * out.num_rows, pa.string()))

    return joined.groupBy("q_host").cogroup(counts.groupBy("q_host")).applyInArrow(finish, f"q_host {kind}, q_pages int, q_nodes int, q_constant int, q_wrapper string")


def _size(a: Part | Node) -> int:
    return 1 + sum(_size(x) for x in a.kids)
