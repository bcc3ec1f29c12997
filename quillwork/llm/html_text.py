"""Main text of web pages by wrapper induction over the pages of a host.

1. A page is read once, into blocks of text and the tree of its block elements, in
   which siblings of one label (tag and class; a bare tag also by what is in it) are
   one node: a repeated record. The commonest such tree of a host is its exemplar.
2. Each page's tree is aligned with the exemplar by simple tree matching. Grouped
   sums over a host's pages then say of every node how its texts vary: those that
   most pages have there are template; what varies is content.
3. The wrapper of a host is the smallest part of the exemplar that holds nearly all
   varying text; an article is taken whole. The varying first heading above it and the
   parts of the article beside it belong to it; stock texts that rotate, and lists of
   links outside of articles, do not. What lies outside goes: menus, adverts and
   footers, however they vary.
4. Element names, roles and words in class names then decide what the wrapper can't:
   hosts with few pages, hidden elements, and what varies as articles do (comments).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, text_or_empty, written

# Element names of HTML by role.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg object".split())
NEVER = set("nav footer aside form button select menu dialog head script style noscript template iframe textarea title svg object".split())
MAIN = {"article", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
#: Elements that are text, or structure within a text, and no region of a page.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li td th dd dt ul ol dl table thead tbody tr blockquote pre figure figcaption address".split())
# Words of class and id names that mark what is not main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|alert\w*|popup|modal|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer|masthead|comment\w*|repl(?:y|ies)|disqus|share|sharing|social|related|newsletter|subscribe|login)(?:$|[\s_-])",
    re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TELLING = re.compile(r"class|id|hidden|style", re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
# Possessive, so that a tag that never closes is gone through once.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")

#: Hosts with fewer pages have no wrapper. A text is template where this share of a host's pages has it at a node.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 5
#: A wrapper holds this share of the varying text; a node is a list of links when so much of its text is in links.
REGION_SHARE, LINK_SHARE = 0.8, 0.7
#: A text that is drawn from fewer than this many stock texts rotates.
STOCK = 200
#: Beside a region, a part of the article has so many characters a block at least, and so many blocks a page at most.
LEAST_TEXT, PARTS = 60, 4
#: Bytes of wrappers (trees of hosts) that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST = 16_000_000

IN_MAIN, OUT = 1, 2


class Page:
    """Blocks of a page in order, each with its node in the condensed tree.

    ``labels`` and ``parents`` are the tree, parents before children; a block is
    ``(node, text, flags, characters in links)``.
    """

    def __init__(self, source: str):
        self._tags, self._above = ["#"], [-1]
        self.blocks: list[tuple[int, str, int, int]] = []
        self._read(source)
        self._condense()

    def _read(self, source: str) -> None:
        stack = [("#", 0, 0)]  # tag, node, flags
        opened: Counter = Counter()
        held: list[str] = []
        linked, links = 0, 0  # open links, characters in them
        skipped, depth = "", 0  # an inline element that is left out
        at = 0

        def flush() -> None:
            nonlocal links
            text = "".join(held)
            held.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                _, node, flags = stack[-1]
                self.blocks.append((node, text, flags, min(links, len(text))))
            links = 0

        def text(piece: str) -> None:
            nonlocal links
            if piece and not skipped:
                held.append(piece)
                if linked:
                    links += len(piece)

        while True:
            here = source.find("<", at)
            if here < 0:
                text(source[at:])
                break
            text(source[at:here])
            m = NAME.match(source, here)
            if not m:
                if source.startswith("<!--", here):
                    end = source.find("-->", here + 4)
                    at = end + 3
                elif source.startswith(("<!", "<?", "</"), here):
                    end = source.find(">", here)
                    at = end + 1
                else:
                    text("<")
                    end, at = here, here + 1
                if end < 0:  # a comment that never ends
                    break
                continue
            rest = REST.match(source, m.end())
            if not rest:  # no tag after all
                text(source[here:])
                break
            at, slash, name, rest = rest.end(), source[here + 1] == "/", m.group(1).lower(), rest.group()[:-1]
            if name in INLINE:
                if name in ("br", "wbr", "img"):
                    text(" ")
                    continue
                if skipped:
                    depth += (-1 if slash else 1) if name == skipped else 0
                    skipped = skipped if depth else ""
                elif not slash and TELLING.search(rest) and self._left_out(self._values(rest)):
                    skipped, depth = name, 1
                if name == "a":
                    linked = 0 if slash else 1
                continue
            flush()
            skipped, linked = "", 0
            if slash:
                if opened[name]:
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == name:
                            break
                continue
            for closing in ("p",), CLOSES.get(name, ()):
                for _ in closing:
                    if stack[-1][0] in closing:
                        opened[stack.pop()[0]] -= 1
            _, parent, flags = stack[-1]
            values = self._values(rest) if rest.strip() else {}
            if name in MAIN or values.get("role") == "main" or values.get("itemprop") == "articleBody":
                flags |= IN_MAIN
            if name in NEVER or (name == "header" and not flags & IN_MAIN) or values.get("role") in ROLES or self._left_out(values, name in MAIN or name in ("html", "body")):
                flags |= OUT
            if name in VOID or rest.endswith("/") and name in RAW:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                end = source.find(">", end.end()) if end else -1
                if end < 0:
                    break
                at = end + 1
                continue
            kind = re.sub(r"\d+", "0", " ".join(values.get("class", "").split()))
            self._tags.append(f"{name}.{kind}" if kind else name)
            self._above.append(parent)
            stack.append((name, len(self._tags) - 1, flags))
            opened[name] += 1
        flush()

    @staticmethod
    def _values(rest: str) -> dict[str, str]:
        values: dict[str, str] = {}
        for name, *found in ATTRIBUTE.findall(rest):
            values.setdefault(name.lower(), found[0] or found[1] or found[2])
        return values

    @staticmethod
    def _left_out(values: dict[str, str], trusted: bool = False) -> bool:
        """Hidden, or named as something other than main text (which a trusted element is not by its name)."""
        if not values:
            return False
        return "hidden" in values or bool(HIDDEN.search(values.get("style", ""))) or not trusted and bool(MARKS.search(f"{values.get('class', '')} {values.get('id', '')}"))

    def _condense(self) -> None:
        """Siblings of one label become one node; those without a class only if their insides are alike."""
        tags, above = self._tags, self._above
        inside: list[dict] = [{} for _ in tags]
        known: dict[tuple, int] = {}
        kinds = [0] * len(tags)
        for i in range(len(tags) - 1, -1, -1):
            own = tags[i] if "." in tags[i] else (tags[i], *reversed(inside[i]))
            kinds[i] = known.setdefault(own, len(known))
            if i:
                inside[above[i]].setdefault(kinds[i])
        self.labels, self.parents = ["#"], [-1]
        place, nodes = {}, [0] * len(tags)
        for i in range(1, len(tags)):
            key = (nodes[above[i]], kinds[i])
            if key not in place:
                place[key] = len(self.labels)
                self.labels.append(tags[i])
                self.parents.append(key[0])
            nodes[i] = place[key]
        self.blocks = [(nodes[b[0]], *b[1:]) for b in self.blocks]

    def shape(self) -> str:
        """The tree as text: a parent and a label for each node."""
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels, strict=True))


def plain(source: str) -> str:
    """The text of a page by itself: what its element names, roles and class names leave."""
    blocks = [b for b in Page(source).blocks if not b[2] & OUT]
    if any(b[2] & IN_MAIN for b in blocks):
        blocks = [b for b in blocks if b[2] & IN_MAIN]
    return "\n\n".join(b[1] for b in blocks)


def _tree(shape: str) -> tuple[list[str], list[int], list[list[int]]]:
    pairs = [line.split(" ", 1) for line in shape.split("\n")]
    parents = [int(p) for p, _ in pairs]
    children: list[list[int]] = [[] for _ in pairs]
    for node, parent in enumerate(parents):
        if parent >= 0:
            children[parent].append(node)
    return [x for _, x in pairs], parents, children


def _paths(labels: list[str], parents: list[int], known: dict[tuple, int]) -> list[int]:
    """A number for the labels from the root to each node; only such nodes can be matched."""
    out = [0] * len(labels)
    for i in range(1, len(labels)):
        out[i] = known.setdefault((out[parents[i]], labels[i]), len(known) + 1)
    return out


def align(shape: str, exemplar: str) -> dict[int, int]:
    """Simple tree matching: nodes of ``shape`` to nodes of ``exemplar``, as many as order and labels allow."""
    if shape == exemplar:
        return {i: i for i in range(shape.count("\n") + 1)}
    (la, pa_, ca), (lb, pb, cb) = _tree(shape), _tree(exemplar)
    known: dict[tuple, int] = {}
    a, b = _paths(la, pa_, known), _paths(lb, pb, known)
    partners: dict[int, list[int]] = {}
    for j, path in enumerate(b):
        partners.setdefault(path, []).append(j)
    here = set(a)
    tables: dict[tuple[int, int], tuple[np.ndarray, list[int], list[int]]] = {}
    weight: dict[tuple[int, int], int] = {}
    # Children come after their parents, so going backwards meets them first.
    for i in range(len(la) - 1, -1, -1):
        us = [u for u in ca[i] if a[u] in partners]
        for j in partners.get(a[i], ()):
            vs = [v for v in cb[j] if b[v] in here]
            m = np.zeros((len(us) + 1, len(vs) + 1), np.int32)
            for x, u in enumerate(us, 1):
                row = m[x - 1].copy()
                for y, v in enumerate(vs, 1):
                    w = weight.get((u, v))
                    if w and m[x - 1, y - 1] + w > row[y]:
                        row[y] = m[x - 1, y - 1] + w
                m[x] = np.maximum.accumulate(row)
            tables[i, j], weight[i, j] = (m, us, vs), int(m[-1, -1]) + 1
    pairs, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        pairs[i] = j
        m, us, vs = tables[i, j]
        x, y = len(us), len(vs)
        while x and y:
            if m[x, y] == m[x - 1, y]:
                x -= 1
            elif m[x, y] == m[x, y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((us[x], vs[y]))
    return pairs


class _Aligner:
    """Places of a tree's nodes in an exemplar, -1 where there is none; trees seen before are remembered."""

    def __init__(self):
        self.known: dict[tuple[str, str], np.ndarray] = {}

    def __call__(self, shape: str, exemplar: str) -> np.ndarray:
        key = (shape, exemplar)
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            out = np.full(shape.count("\n") + 1, -1)
            for i, j in align(shape, exemplar).items():
                out[i] = j
            self.known[key] = out
        return self.known[key]


def induce(exemplar: str, slots: list[dict]) -> tuple[list[bool], list[int]]:
    """The wrapper of a host: for each node of the exemplar whether it is inside; and nodes inside that hold no main text.

    A slot is ``node, blocks, chars, links, varying, again``: a node's blocks, their
    characters, those in links, those of texts that are not template, and in how
    many pairs of its blocks, from pages with different articles, the texts are equal.
    """
    labels, parents, children = _tree(exemplar)
    tag = [x.split(".", 1)[0] for x in labels]
    linked = {s["node"] for s in slots if s["links"] >= LINK_SHARE * s["chars"] > 0}
    rotating = {s["node"] for s in slots if s["again"] >= 3 and s["blocks"] * (s["blocks"] - 1) / 2 < STOCK * s["again"]}
    mass = [0] * len(labels)
    for s in slots:
        if s["node"] not in linked:
            mass[s["node"]] = s["varying"]
    varies = [m > 0 for m in mass]
    if not any(varies):  # links are all there is
        linked = set()
        for s in slots:
            mass[s["node"]] = s["varying"]
    for i in range(len(labels) - 1, 0, -1):
        mass[parents[i]] += mass[i]
    region = 0
    while tag[region] != "article":
        # An article is taken whole; of what is named as the main part only an article in it can be more to the point.
        fits = [c for c in children[region] if mass[c] >= REGION_SHARE * mass[0] > 0 and tag[c] not in TEXTUAL and (tag[region] != "main" or tag[c] == "article")]
        if not fits:
            break
        region = fits[0]
    inside = [False] * len(labels)
    for i in range(len(labels)):
        inside[i] = i == region or i > 0 and inside[parents[i]]
    above, i = [], region
    while i >= 0:
        above.append(i)
        i = parents[i]
    # Links stay within what is named as an article or holds the title of one, unless they rotate as menus do.
    trusted = [i for i in above if tag[i] in MAIN][:1]
    headings = {i for i in range(len(labels)) if tag[i] == "h1" and varies[i]}
    if headings and not any(inside[i] for i in headings):
        if not trusted:
            trusted = _beside(region, above, headings, tag, parents, children, slots, linked | rotating, inside)
        for i in headings:
            inside[i] = inside[i] or parents[i] in above
    held = [False] * len(labels)
    for i in range(len(labels)):
        held[i] = i in trusted or i > 0 and held[parents[i]]
    dropped = {n for n in linked if not held[n] or n in rotating} | {n for n in rotating if tag[n] not in TEXTUAL}
    return inside, sorted(n for n in dropped if inside[n])


def _beside(region: int, above: list[int], headings: set[int], tag: list[str], parents: list[int], children: list[list[int]], slots: list[dict], no_text: set[int], inside: list[bool]) -> list[int]:
    """Parts of an article that lie beside its region, where the title does too: between them, or after them and written as text is.

    Marks them as inside; returns the element that holds them all, if it is smaller than a page.
    """
    own = {s["node"]: s for s in slots}
    for at, holder in zip(above, above[1:]):
        if tag[holder] in ("#", "html", "body"):
            return []
        under: dict[int, list[int]] = {c: [] for c in children[holder]}
        top = [-1] * len(tag)  # the child of the holder that each node is under; parents come first
        for n in range(holder + 1, len(tag)):
            top[n] = n if parents[n] == holder else top[parents[n]]
            if top[n] >= 0:
                under[top[n]].append(n)
        titles = sorted(top[h] for h in headings if top[h] >= 0)
        if not titles:
            continue
        per_page = max(own[h]["blocks"] for h in headings if h in own)
        for c, nodes in under.items():
            varying = [own[n] for n in nodes if n in own and n not in no_text and own[n]["varying"] > 0]
            blocks = sum(s["blocks"] for s in varying)
            # What repeats many times on a page, as comments do, is no part of the article by this rule.
            written_out = blocks <= PARTS * per_page and sum(s["chars"] for s in varying) >= LEAST_TEXT * blocks
            if varying and (titles[0] < c < at or c > at and written_out):
                for n in nodes:
                    inside[n] = True
        return [holder]
    return []


def _name(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


READ = "page_id long, url string, host string, shape string, article long, nodes array<int>, names array<long>, lengths array<int>, links array<int>, flags array<int>, texts array<string>"


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [Page(source) for source in batch.column(3).to_pylist()]
        blocks = [p.blocks for p in pages]
        names = [[_name(b[1]) for b in own] for own in blocks]
        longest = [names[i][max(range(len(own)), key=lambda k: (len(own[k][1]), -k))] if own else 0 for i, own in enumerate(blocks)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(3)), pa.array([p.shape() for p in pages], pa.string()), pa.array(longest, pa.int64()),
                pa.array([[b[0] for b in own] for own in blocks], pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64())), pa.array([[len(b[1]) for b in own] for own in blocks], pa.list_(pa.int32())),
                pa.array([[b[3] for b in own] for own in blocks], pa.list_(pa.int32())), pa.array([[b[2] for b in own] for own in blocks], pa.list_(pa.int32())), pa.array([[b[1] for b in own] for own in blocks], pa.list_(pa.string())),
            ],
            [c.split(" ")[0] for c in READ.split(", ")],
        )


def _texts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch by host, node, text and article: pages, blocks, characters, characters in links."""
    aligned = _Aligner()
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for host, shape, exemplar, article, nodes, names, lengths, links in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            place = aligned(shape, exemplar)
            own = set()
            for node, name, length, link in zip(nodes, names, lengths, links, strict=True):
                if place[node] < 0:
                    continue
                key = (host, int(place[node]), name, article)
                sums = seen.setdefault(key, [0, 0, 0, 0])
                sums[0] += key not in own
                own.add(key)
                sums[1] += 1
                sums[2] += length
                sums[3] += link
        keys, sums = list(seen), np.array(list(seen.values()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([k[3] for k in keys], pa.int64()), *(pa.array(sums[:, c]) for c in range(4))],
            ["host", "node", "name", "article", "pages", "blocks", "chars", "links"],
        )


def _induce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [induce(e, s or []) for e, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.bool_())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["host", "exemplar", "inside", "dropped"])


def _extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligned = _Aligner()
    for batch in batches:
        texts, by_wrapper, by_marks = [], [], []
        for shape, nodes, names, flags, own, exemplar, inside, dropped, constant in zip(*(batch.column(i).to_pylist() for i in range(2, 11)), strict=True):
            kept = list(range(len(nodes)))
            if exemplar is not None:
                place = aligned(shape, exemplar)
                parents = [int(line.split(" ", 1)[0]) for line in shape.split("\n")]
                near = place.copy()  # a node without a place is where its parent is
                for i in range(1, len(near)):
                    near[i] = near[i] if near[i] >= 0 else near[parents[i]]
                template, gone = {(c["node"], c["name"]) for c in constant or ()}, set(dropped)
                kept = [k for k in kept if inside[near[nodes[k]]] and near[nodes[k]] not in gone and (place[nodes[k]], names[k]) not in template]
            by_wrapper.append(len(nodes) - len(kept))
            held = [k for k in kept if not flags[k] & OUT]
            if any(flags[k] & IN_MAIN for k in held):
                held = [k for k in held if flags[k] & IN_MAIN]
            by_marks.append(len(kept) - len(held))
            texts.append("\n\n".join(own[k] for k in held))
        counts = ([len(t) for t in texts], by_wrapper, by_marks)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["page_id", "url", "text", "n_chars", "n_by_wrapper", "n_by_marks"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = TEMPLATE_SHARE, least_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars, n_by_wrapper, n_by_marks`` for each input row; the last two count the blocks that were removed.

    Null or empty html gives an empty text; pages without a host form a group of
    their own. Character references are decoded, white space within a block
    (non-breaking spaces too) becomes one space, blocks are joined by two line
    feeds. Malformed markup is read as it comes, in one pass: an unclosed paragraph
    ends where a block begins, an unclosed script or comment runs to the end, a tag
    that never closes is text. Hidden elements are left out. Hosts with fewer than
    ``least_pages`` pages have no wrapper. Of a host, counts by node and text are
    all that is gathered, added up before they are shuffled; a page whose longest
    block equals another's counts as its copy.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 200)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), text_or_empty(html_col).alias("html"))
    read = written(rows.mapInArrow(_read_task, READ), "read")
    shapes = read.groupBy("host", "shape").agg(F.count("*").alias("n"))
    hosts = written(shapes.groupBy("host").agg(F.max(F.struct("n", "shape"))["shape"].alias("exemplar"), F.sum("n").alias("host_pages")).where(F.col("host_pages") >= least_pages), "hosts")
    held = hosts.agg(F.count("*").alias("n"), F.sum(F.length("exemplar")).alias("chars")).first()
    side = lambda df, small: F.broadcast(df) if small else df
    few = 100 * held["n"] + (held["chars"] or 0) <= BROADCAST
    counted = (
        read.join(side(hosts.select("host", "exemplar"), few), "host").select("host", "shape", "exemplar", "article", "nodes", "names", "lengths", "links")
        .mapInArrow(_texts_task, "host string, node int, name long, article long, pages long, blocks long, chars long, links long")
        .groupBy("host", "node", "name", "article").agg(*(F.sum(c).alias(c) for c in ("pages", "blocks", "chars", "links")))
        .groupBy("host", "node", "name").agg(F.count("*").alias("articles"), *(F.sum(c).alias(c) for c in ("pages", "blocks", "chars", "links")))
    )
    counted = counted.join(side(hosts.select("host", "host_pages"), few), "host").withColumn("constant", (F.col("pages") >= share * F.col("host_pages")) & (F.col("pages") >= least_pages))
    counted = written(counted, "counted")
    slots = counted.groupBy("host", "node").agg(
        F.sum("blocks").alias("blocks"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(F.when(F.col("constant"), 0).otherwise(F.col("chars"))).alias("varying"),
        F.sum((F.col("articles") * (F.col("articles") - 1) / 2).cast("long")).alias("again"),
    )
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("node", "blocks", "chars", "links", "varying", "again")).alias("slots"))
    induced = hosts.join(slots, "host", "left").select("host", "exemplar", "slots").mapInArrow(_induce_task, "host string, exemplar string, inside array<boolean>, dropped array<int>")
    constants = counted.where("constant").groupBy("host").agg(F.collect_list(F.struct("node", "name")).alias("constant"))
    wrappers = written(induced.join(constants, "host", "left"), "wrappers")
    size = wrappers.agg(F.sum(F.length("exemplar") + F.size("inside") + 16 * F.coalesce(F.size("constant"), F.lit(0)))).first()[0] or 0
    return (
        read.join(side(wrappers, 100 * held["n"] + size <= BROADCAST), "host", "left").select("page_id", "url", "shape", "nodes", "names", "flags", "texts", "exemplar", "inside", "dropped", "constant")
        .mapInArrow(_extract_task, "page_id long, url string, text string, n_chars long, n_by_wrapper long, n_by_marks long")
    )


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
