"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import ship
from waymark.llm.common import staged
from waymark.llm.url_filter import host_and_path

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp)\b(?:[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
CONTENT = frozenset("article main".split())
#: Elements that are never text of the page, and those that a varying slot may be named by.
NEVER = frozenset("button select option datalist head svg canvas object audio video map math".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
#: Words of class, id and role attributes that name what isn't the article.
MARKED = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar
    navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies disqus discussion cookie cookies consent gdpr notice
    notices notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommended widget toolbar
    pagination pager login signin signup search skip contentinfo complementary""".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks of running text: they part it, but aren't slots.
FLOW = frozenset("html body p h1 h2 h3 h4 h5 h6 hgroup li dt dd pre address figcaption caption summary center hr legend".split())
#: Slots that belong to running text whatever their size.
SOFT = frozenset("ul ol dl blockquote figure table thead tbody tfoot tr td th details".split())
#: Slots of which neighbours count as one.
ALIKE = SOFT | CONTENT | {"section"}
#: An opening tag of the first kind ends an open element of the second kind.
ENDS = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "tr": frozenset(["p", "td", "th", "tr"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "body": frozenset(["head"])}
#: Elements across which an implied end doesn't reach.
SCOPES = frozenset("html body table ul ol dl div article section main td th blockquote nav aside header footer form".split())
#: Children of two nodes are compared all with all up to so many pairs, and so many in a page; beyond, by name and number.
PAIRS, ALL_PAIRS = 400, 20_000
#: A slot with this share of its parent's text is the parent's content; one with less than LIGHT at its edge is none.
HEAVY, LIGHT, LINKED = 0.8, 0.15, 0.6


class Block:
    """A stretch of text without a block boundary in it."""

    __slots__ = ("hash", "links", "tag", "text", "words")

    def __init__(self, text: str, links: int, tag: str):
        self.text, self.tag, self.words = text, tag, text.count(" ") + 1
        self.links, self.hash = min(links, self.words), xxhash.xxh3_64_intdigest(text) >> 1


class Box:
    """A slot of the page: its name, whether the name says that it isn't the article, and its blocks and boxes in order."""

    __slots__ = ("items", "links", "named", "names", "never", "pieces", "plain", "slot", "tag", "title", "words")

    def __init__(self, tag: str, names: tuple[str, ...], named: bool, never: bool):
        self.tag, self.names, self.named, self.never = tag, names, named, never
        self.items, self.pieces, self.slot = [], [], -1
        self.words = self.links = 0
        self.title, self.plain = False, tag == "div" and not names and not named and not never


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


class Reader:
    """Makes a page's tree of boxes in one pass, with a stack in place of recursion."""

    def __init__(self):
        self.root = Box("#", (), False, False)
        self.stack: list[tuple[str, Box, bool]] = [("#", self.root, False)]
        self.open: Counter = Counter()
        self.link = False

    def flush(self) -> None:
        tag, box, _ = self.stack[-1]
        if box.pieces:
            text = clean([p for p, _ in box.pieces])
            if text and not box.never:
                box.items.append(Block(text, sum(len(p.split()) for p, linked in box.pieces if linked), tag))
            box.pieces.clear()

    def shut(self, k: int) -> None:
        """Closes the open elements from place k of the stack on."""
        while len(self.stack) > k:
            if self.stack[-1][1].tag != "#inline":
                self.flush()
            tag, box, is_box = self.stack.pop()
            self.open[tag] -= 1
            if is_box and not box.plain:
                self.stack[-1][1].plain = False

    def read(self, page: str) -> Box:
        for m in TOKEN.finditer(page):
            if (text := m["text"]) is not None:
                self.stack[-1][1].pieces.append((text, self.link))
            elif m["tag"] is not None:
                (self.end if m["close"] else self.start)(m["tag"].lower(), m["rest"])
        self.shut(1)
        self.flush()
        return self.root

    def end(self, tag: str, _: str) -> None:
        if tag == "a":
            self.link = False
        if self.open[tag] <= 0:
            return
        if tag not in INLINE:
            self.link = False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.shut(k)
                return

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.stack[-1][1].pieces.append((" ", False))
            return
        hidden = bool(rest and HIDDEN.search(rest))
        if tag in INLINE and not hidden:
            self.link = self.link or tag == "a"
            return
        if tag in INLINE:
            if tag not in VOID:
                self.stack.append((tag, Box("#inline", (), True, True), False))
                self.open[tag] += 1
            return
        ends = ENDS.get(tag, ())
        if any(self.open[t] > 0 for t in ends):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in ends:
                    self.shut(k)
                    if self.stack[-1][0] in ends:
                        continue
                    break
                if self.stack[k][0] in SCOPES:
                    break
        self.flush()
        if tag in VOID:
            return
        tokens = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(rest)).lower().split() if rest and "=" in rest else []
        named = tag in CHROME or any(is_marked(t) for t in tokens)
        if tag in ("html", "body"):
            named = hidden = False
        parent = self.stack[-1][1]
        if tag in FLOW and not named and not hidden:
            self.stack.append((tag, parent, False))
        else:
            box = Box(tag, tuple(sorted(set(tokens))), named, hidden or tag in NEVER or parent.never)
            parent.items.append(box)
            self.stack.append((tag, box, True))
        self.open[tag] += 1


def is_marked(token: str) -> bool:
    """Whether a class, id or role names what isn't the article: by its first or last word, unless it says with, no or has."""
    if token in MARKED:
        return True
    parts = re.findall(r"[a-z]+", token)
    return bool(parts) and not {"with", "no", "has", "without", "post", "page", "article", "content", "main", "results"} & set(parts) and (parts[0] in MARKED or parts[-1] in MARKED)


def parse(page: str) -> Box:
    """The tree of a page's slots. Never fails: unknown, open and stray tags are taken as browsers do, roughly; depth and
    width don't count, as nothing recurses."""
    root = Reader().read(page)
    order, at = [root], 0
    while at < len(order):
        todo, items = order[at].items[::-1], []
        while todo:
            x = todo.pop()
            if isinstance(x, Box) and x.plain:  # a division without a name and without slots of its own is a paragraph
                todo.extend(reversed(x.items))
            else:
                items.append(x)
        order[at].items = items
        order.extend(x for x in items if isinstance(x, Box))
        at += 1
    for box in reversed(order):
        for x in box.items:
            box.words += x.words
            box.links += x.links
            box.title = box.title or (x.title if isinstance(x, Box) else x.tag == "h1")
    return root


class Outline:
    """A page's slots in preorder: like neighbours are one slot, so that pages of different length have like outlines."""

    def __init__(self, root: Box | None = None):
        self.parents: list[int] = []
        self.tags: list[str] = []
        self.names: list[str] = []
        self.blocks: list[list[list[int]]] = []
        todo: list[tuple[list[Box], int]] = [([root], -1)] if root is not None else []
        while todo:
            boxes, parent = todo.pop()
            slot = len(self.tags)
            self.parents.append(parent)
            self.tags.append(boxes[0].tag)
            self.names.append(" ".join(boxes[0].names))
            own: dict[int, list[int]] = {}
            runs: list[list[Box]] = []
            for b in boxes:
                b.slot = slot
                for x in b.items:
                    if isinstance(x, Block):
                        one = own.setdefault(x.hash, [x.hash, 0, 0])
                        one[1] += x.words
                        one[2] += x.links
                    elif runs and x.tag == runs[-1][0].tag and x.names == runs[-1][0].names and (x.names or x.tag in ALIKE):
                        runs[-1].append(x)
                    else:
                        runs.append([x])
            self.blocks.append(list(own.values()))
            todo.extend((r, slot) for r in reversed(runs))

    def text(self) -> str:
        return json.dumps([self.parents, self.tags, self.names, self.blocks], separators=(",", ":"))

    def shape(self) -> str:
        return xxhash.xxh3_64_hexdigest(json.dumps([self.parents, self.tags]))

    @classmethod
    def of(cls, text: str) -> Outline:
        out = cls()
        out.parents, out.tags, out.names, out.blocks = json.loads(text)
        return out

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.tags]
        for k, p in enumerate(self.parents):
            if p >= 0:
                out[p].append(k)
        return out


def by_number(xs: list[int], ys: list[int], x: Outline, y: Outline) -> list[tuple[int, int]]:
    """Children paired by name and number (the k-th of a name with the k-th of it), the longest increasing run of pairs."""
    where: dict[tuple, int] = {}
    seen: Counter = Counter()
    for place, a in enumerate(xs):
        key = (x.tags[a], x.names[a])
        where[key, seen[key]] = place
        seen[key] += 1
    seen.clear()
    found = []
    for b in ys:
        key = (y.tags[b], y.names[b])
        if (place := where.get((key, seen[key]))) is not None:
            found.append((place, b))
        seen[key] += 1
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(found)
    for k, (place, _) in enumerate(found):
        at = bisect_left(tails, place)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [place]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append((xs[found[k][0]], found[k][1]))
        k = before[k]
    return out[::-1]


def tree_match(x: Outline, y: Outline) -> dict[int, int]:
    """Simple tree matching: slots of y by the slots of x that they match, top-down and in order, so that most slots match;
    equal names count like one slot more. Where two slots have too many children to compare all with all, these are
    paired by name and number."""
    down_x, down_y = x.children(), y.children()
    pairs: list[tuple[int, int]] = [(0, 0)]
    below: list[tuple[bool, list[int]]] = []  # whether to choose, and the places in pairs of the children's pairs
    spent = 0
    at = 0
    while at < len(pairs):
        xs, ys = down_x[pairs[at][0]], down_y[pairs[at][1]]
        cross = len(xs) * len(ys)
        choose = cross <= PAIRS and spent + cross <= ALL_PAIRS
        if choose:
            spent += cross
            new = [(a, b) for a in xs for b in ys if x.tags[a] == y.tags[b]]
        else:
            new = by_number(xs, ys, x, y)
        below.append((choose, list(range(len(pairs), len(pairs) + len(new)))))
        pairs += new
        at += 1
    weight = [0] * len(pairs)
    chosen: list[list[int]] = [[] for _ in pairs]
    for k in range(len(pairs) - 1, -1, -1):
        a, b = pairs[k]
        choose, kids = below[k]
        if choose and kids:
            xs, ys = down_x[a], down_y[b]
            row, column = {v: i for i, v in enumerate(xs, 1)}, {v: j for j, v in enumerate(ys, 1)}
            cell = {(row[pairs[c][0]], column[pairs[c][1]]): c for c in kids}
            table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for i in range(1, len(xs) + 1):
                for j in range(1, len(ys) + 1):
                    c = cell.get((i, j))
                    table[i][j] = max(table[i][j - 1], table[i - 1][j], table[i - 1][j - 1] + weight[c] if c is not None else 0)
            total, i, j = table[-1][-1], len(xs), len(ys)
            while i and j:
                c = cell.get((i, j))
                if c is not None and table[i][j] == table[i - 1][j - 1] + weight[c]:
                    chosen[k].append(c)
                    i, j = i - 1, j - 1
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        else:
            chosen[k], total = kids, sum(weight[c] for c in kids)
        weight[k] = 1 + (x.names[a] == y.names[b]) + total
    out, todo = {}, [0]
    while todo:
        k = todo.pop()
        out[pairs[k][1]] = pairs[k][0]
        todo.extend(chosen[k])
    return out


class Wrapper:
    """What the aligned pages of a group show: constant blocks of the template, the text that each slot holds on average, and
    the slot that holds the varying text."""

    def __init__(self, outline: Outline, text: dict[int, float], constant: dict[int, set[int]], is_own: bool = False):
        self.outline, self.constant, self.is_own = outline, constant, is_own
        self.mass = [text.get(k, 0.0) for k in range(len(outline.tags))]
        for k in range(len(outline.tags) - 1, 0, -1):
            self.mass[outline.parents[k]] += self.mass[k]
        down, slot = outline.children(), 0
        while down[slot]:
            heaviest = max(down[slot], key=lambda k: (self.mass[k], -k))
            if self.mass[heaviest] <= 0 or self.mass[heaviest] < HEAVY * self.mass[slot] or (outline.tags[heaviest] in SOFT and outline.tags[heaviest] != "table" and not down[heaviest]):
                break
            slot = heaviest
        while outline.tags[slot] in SOFT and outline.parents[slot] >= 0 and not any(outline.tags[k] not in SOFT for k in down[slot]) and outline.tags[slot] not in ("td", "th"):
            slot = outline.parents[slot]
        self.content = slot

    @classmethod
    def of_page(cls, outline: Outline) -> Wrapper:
        """For a page without others to align it with: its own masses."""
        return cls(outline, {k: float(sum(w - n for _, w, n in own)) for k, own in enumerate(outline.blocks)}, {}, True)


def main_text(root: Box, wrapper: Wrapper | None = None) -> str:
    """The page's varying text: that of the slots which match the wrapper's content slot, in page order.

    Of boxes in it go: constant ones; those that are mostly links; those whose name says so, unless they hold most of the
    text; and at its edges light ones without a title. Without a wrapper, article and main elements are the content, else
    the page's own masses decide.
    """
    page = Outline(root)
    if wrapper is None:
        wrapper = Wrapper.of_page(page)
    match = {k: k for k in range(len(page.tags))} if wrapper.is_own else tree_match(wrapper.outline, page)
    tops: list[Box] = []
    todo: list[Box] = [root]
    while todo:
        b = todo.pop()
        if b.never:
            continue
        if (b.tag in CONTENT) if wrapper.is_own else (match.get(b.slot) == wrapper.content):
            tops.append(b)
        else:
            todo.extend(x for x in reversed(b.items) if isinstance(x, Box))
    if not tops and wrapper.is_own:
        todo = [root]
        while todo:
            b = todo.pop()
            if b.slot == wrapper.content:
                tops.append(b)
            else:
                todo.extend(x for x in reversed(b.items) if isinstance(x, Box))
    whole = wrapper.mass[wrapper.content]
    out: list[str] = []

    def goes(b: Box, total: int) -> bool:
        text = b.words - b.links
        if b.never or b.words == 0:
            return True
        if b.named and text < 0.5 * total:
            return True
        return b.links >= LINKED * b.words and b.words > 2 and b.tag not in ("td", "th", "tr", "tbody")

    def constant_of(b: Box) -> set[int]:
        return wrapper.constant.get(match.get(b.slot, -1), set())

    for top in tops:
        total = top.words - top.links
        inside = [k for k, x in enumerate(top.items) if isinstance(x, Block) and x.hash not in constant_of(top) or isinstance(x, Box) and x.tag in SOFT and not goes(x, total)]
        first, last = (inside[0], inside[-1]) if inside else (len(top.items), -1)
        walk: list[tuple[Block | Box, Box]] = []
        for k, x in enumerate(top.items):
            if isinstance(x, Box):
                if goes(x, total):
                    continue
                known = match.get(x.slot)
                share = wrapper.mass[known] / whole if known is not None and whole > 0 else (x.words - x.links) / max(total, 1)
                inner = first < k < last and (top.tag in CONTENT or share >= LIGHT or not x.named)
                if x.tag not in SOFT and share < LIGHT and not inner and not x.title:
                    continue
            walk.append((x, top))
        walk.reverse()
        while walk:
            x, owner = walk.pop()
            if isinstance(x, Block):
                if x.hash not in constant_of(owner):
                    out.append(x.text)
            elif owner is top or not goes(x, total):
                walk.extend((y, x) for y in reversed(x.items))
    if not out and not wrapper.is_own:
        return main_text(root, Wrapper.of_page(page))
    return "\n".join(out)


def extract(
    pages: DataFrame, least_pages: int = 5, share: float = 0.8, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Rows page_id, url, text, n_chars, template: every page's main text, its blocks joined by line feeds.

    Pages of a host are aligned by simple tree matching with a reference page, one of the host's most common outline (slots
    are elements that hold more than running text; like neighbours are one slot). Blocks of a slot that stand on ``share``
    of the host's pages are constant: template. What varies is content: the wrapper descends to the slot that holds nearly
    all varying text that isn't links, and light slots at its edges (adverts, footers) stay out, whatever they are called.
    Names (elements like nav, words of class, id and role) only settle slots that hold less than half of that text.

    template tells whose pages a page was aligned with: those of its host, where that has ``least_pages`` different pages;
    else of the domain's other such hosts (the last two labels of the name); else none, and the page's own masses and
    names decide. A page that has nothing in the wrapper's content slot is judged by itself too.

    Character references are decoded, white space in a block becomes one space, empty blocks go. Null, empty and
    text-free html: the empty text. Null URLs share the empty host. Very deep and very wide pages cost time in proportion
    to their length. Repeated rows get equal rows; a null id stays null; other columns are ignored; an empty table gives no
    rows. A host with a third of all pages makes a skewed join, which Spark's adaptive execution splits.
    """
    ship(pages.sparkSession)
    host, _ = host_and_path(pages[url_col])
    rows = pages.select(
        pages[id_col].alias("page_id"),
        pages[url_col].alias("url"),
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.coalesce(pages[html_col], F.lit("")).alias("html"),
    )

    def mapped(source: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    out = list(work(batch.slice(start, 256).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

        return source.mapInArrow(run, schema)

    def outlined(batch: list[dict]) -> Iterator[tuple]:
        for r in batch:
            page = Outline(parse(r["html"]))
            yield r["host"], r["domain"], xxhash.xxh3_64_hexdigest(r["html"]), page.shape(), page.text()

    outlines = staged(mapped(rows.select("host", "domain", "html"), "host string, domain string, page string, shape string, outline string", outlined).dropDuplicates(["host", "page"]))
    is_large = F.count("*") >= least_pages
    # staged, so that the planner knows how small they are: pages are then shuffled only where they are too large to broadcast
    hosts = staged(outlines.groupBy("host").agg(F.when(is_large, F.col("host")).otherwise(F.concat(F.lit("//"), F.min("domain"))).alias("group")))
    members = outlines.join(hosts, "host")
    shapes = members.groupBy("group", "shape").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    usual = shapes.groupBy("group").agg(F.max(F.struct("n", "page")).alias("x"), F.sum("n").alias("n")).filter(F.col("n") >= least_pages).select("group", F.col("x.page").alias("page"), "n")
    references = staged(members.join(usual, ["group", "page"]).select("group", F.col("outline").alias("reference"), "n").dropDuplicates(["group"]))

    def aligned(batch: list[dict]) -> Iterator[tuple]:
        last: tuple = (None, None)
        for r in batch:
            if r["reference"] != last[0]:
                last = (r["reference"], Outline.of(r["reference"]))
            page = Outline.of(r["outline"])
            seen: dict[tuple[int, int], list[int]] = {}
            for slot, known in tree_match(last[1], page).items():
                for h, words, links in page.blocks[slot]:
                    one = seen.setdefault((known, h), [0, 0])
                    one[0] += words
                    one[1] += links
            yield from ((r["group"], slot, h, words - links) for (slot, h), (words, links) in seen.items())

    meet = members.join(references, "group").select("group", "reference", "outline")
    blocks = mapped(meet, "group string, slot int, hash long, words long", aligned).groupBy("group", "slot", "hash").agg(F.count("*").alias("times"), F.sum("words").alias("words"))
    is_constant = F.col("times") >= F.col("n") * share
    slots = blocks.join(references.select("group", "n"), "group").groupBy("group", "slot").agg(
        F.sum(F.when(is_constant, 0).otherwise(F.col("words")) / F.col("n")).alias("text"), F.collect_list(F.when(is_constant, F.col("hash"))).alias("constant")
    )
    wrappers = staged(slots.groupBy("group").agg(F.collect_list(F.struct("slot", "text", "constant")).alias("slots")).join(references, "group").select("group", "reference", "slots"))

    def content(batch: list[dict]) -> Iterator[tuple]:
        last: tuple = (None, None)
        for r in batch:
            if r["group"] != last[0] and r["reference"] is not None:
                last = (r["group"], Wrapper(Outline.of(r["reference"]), {s["slot"]: s["text"] for s in r["slots"]}, {s["slot"]: set(s["constant"]) for s in r["slots"]}))
            text = main_text(parse(r["html"]), last[1] if r["reference"] is not None else None)
            yield r["page_id"], r["url"], text, len(text), "none" if r["reference"] is None else "domain" if r["group"].startswith("//") else "host"

    with_wrapper = rows.join(hosts, "host", "left").join(wrappers, "group", "left").select("page_id", "url", "html", "group", "reference", "slots")
    kind = dict(pages.select(pages[id_col].alias("page_id")).dtypes)["page_id"]
    return mapped(with_wrapper, f"page_id {kind}, url string, text string, n_chars long, template string", content)
