"""Main text of web pages by wrapper induction over pages of the same host."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html import unescape
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm._frames import saved
from rollcall.llm._text import trimmed

#: Different articles beside which a slot must hold the same text to count as template; cells in which articles are told apart; the largest table of wrappers that is broadcast, in bytes.
LEAST_PAGES, ARTICLE_BITS, BROADCAST_BYTES = 3, 62, 8 << 20
#: Element names by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "head", "math", "canvas", "audio", "video"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "center",
}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "address", "fieldset"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead"}, "body": {"head"},
}
NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar\w*|side|aside|widget\w*|"
    r"comments?|commentlist|disqus\w*|replies|respond|reader-?comments?|cookies?\w*|consent|notice\w*|gdpr|newsletter|subscribe|signup|login|popup|modal|overlay|"
    r"share|sharing|social|related|recommended|more-stories|pagination|pager|toolbar|search|skip\w*|legal|copyright|disclaimer|alert)(?:[-_ ]|$)", re.I)
SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
QUOTES, LONG_NUMBER = re.compile("[>\"']"), re.compile("&#([0-9]{9,})")
#: Bytes that a task's forms and slots may take before they are handed on.
HELD_BYTES = 64 << 20
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACES = re.compile(r"\s+")


class Tags:
    """The tags of a page, one after the other, in time linear in its length whatever quotes and brackets are left open.

    A tag ends at the first > outside quotes; where there is none, at the first >; where there is none either, it is text.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.marks: list[int] | None = None
        self.known: dict[int, int] = {}
        self.missing: set[str] = set()

    def end(self, at: int) -> int:
        """The first > from at on that is outside quotes, or -1; each mark is followed once."""
        if self.marks is None:
            self.marks = [m.start() for m in QUOTES.finditer(self.html)]
        way, found = [], -1
        while (k := bisect_left(self.marks, at)) < len(self.marks):
            q = self.marks[k]
            if q in self.known:
                found = self.known[q]
                break
            way.append(q)
            if self.html[q] == ">":
                found = q
                break
            close = self.html.find(self.html[q], q + 1)
            if close < 0:
                break
            at = close + 1
        for q in way:
            self.known[q] = found
        return found

    def at(self, i: int) -> tuple[int, str, bool, str] | None:
        """What follows the tag at the < at i, its name ('' for a comment and the like), whether it closes, and the rest; None: no tag."""
        html = self.html
        m = SIMPLE.match(html, i)
        if m is None:
            for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(start, i):
                    e = html.find(stop, i + len(start))
                    return (e + len(stop) if e >= 0 else len(html)), "", False, ""
            if i > self.last:
                return None
            if html.startswith(("<!", "<?"), i):
                return html.find(">", i) + 1, "", False, ""
            m = NAME.match(html, i)
            if m is None:
                return None
            e = self.end(m.end())
            e = e if e >= 0 else html.find(">", m.end())
            return e + 1, m[2].lower(), bool(m[1]), html[m.end() : e]
        return m.end(), m[2].lower(), bool(m[1]), m[3]

    def after(self, name: str, at: int) -> int:
        """What follows the closing tag of that name, or -1."""
        if name not in self.missing:
            m = re.compile(rf"</{name}\b", re.I).search(self.html, at, self.last + 1)
            if m:
                return self.html.find(">", m.end()) + 1
            self.missing.add(name)
        return -1


class Page:
    """A page's blocks and its tree, in which neighbouring siblings with the same label are one node.

    labels[i] and parents[i]: node i's label and parent (-1 for the root).  blocks: (node,
    text, characters inside links).
    """

    def __init__(self, html: str):
        self.labels, self.parents = ["#"], [-1]
        self.blocks: list[tuple[int, str, int]] = []
        last: dict[int, int] = {}
        stack: list[tuple[str, int]] = [("#", 0)]
        parts: list[str] = []
        state = {"link": 0, "in": 0}

        def flush() -> None:
            if parts:
                text = "".join(parts)
                parts.clear()
                if "&" in text:  # numbers of any length: what is too large stays so
                    text = unescape(LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), text))
                text = SPACES.sub(" ", text).strip()
                if text:
                    self.blocks.append((stack[-1][1], text, min(len(text), state["link"])))
            state["link"] = 0

        at, n, tags = 0, len(html), Tags(html)
        opened: Counter[str] = Counter()
        while at < n:
            i = html.find("<", at)
            found = tags.at(i) if i >= 0 else None
            stop = n if i < 0 else i if found else i + 1
            if stop > at:
                parts.append(html[at:stop])
                if state["in"]:
                    state["link"] += stop - at
            if found is None:
                at = stop
                continue
            at, name, closing, rest = found
            if not name:
                continue
            if name in RAW:
                if not closing and name != "head" and not rest.endswith("/"):
                    end = tags.after(name, at)
                    at = end if end >= 0 else (n if name in ("script", "style") else at)
                continue
            if name in VOID:
                parts.append(" ")
                continue
            if name in INLINE:
                if name == "a":
                    state["in"] = 0 if closing else 1
                continue
            flush()
            if closing:
                gone = None if opened[name] else name
                while gone != name:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                continue
            closes = CLOSES.get(name, ())
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in closes):
                opened[stack.pop()[0]] -= 1
            label = name.replace(";", " ")
            if rest:
                found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
                if "hidden" in found and "aria-hidden" not in found or found.get("aria-hidden") == "true":
                    label += "!hidden"
                label += "".join(f".{'role-' * (k == 'role')}{re.sub(r'[\s\d;/]+', ' ', found[k]).strip()}" for k in ("class", "id", "role") if found.get(k))
            parent = stack[-1][1]
            node = last.get(parent)
            if node is None or self.labels[node] != label:
                node = len(self.labels)
                self.labels.append(label)
                self.parents.append(parent)
                last[parent] = node
            if not rest.endswith("/"):
                stack.append((name, node))
                opened[name] += 1
        flush()

    def skeleton(self) -> str:
        return ";".join(f"{p}/{x}" for p, x in zip(self.parents, self.labels, strict=True))


def read_skeleton(skeleton: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Labels, children and parents of a skeleton's nodes."""
    labels, children, parents = [], [], []
    for i, x in enumerate(skeleton.split(";")):
        p, label = x.split("/", 1)
        labels.append(label)
        parents.append(int(p))
        children.append([])
        if int(p) >= 0:
            children[int(p)].append(i)
    return labels, children, parents


class Subtrees:
    """The different subtrees of some trees, numbered so that parts come before wholes; equal ones have one number."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.label: list[str] = []
        self.size: list[int] = []

    def add(self, labels: list[str], children: list[list[int]]) -> list[int]:
        """The number of each node's subtree."""
        of = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            kids = tuple(of[c] for c in children[i])
            number = self.numbers.setdefault((labels[i], kids), len(self.kids))
            if number == len(self.kids):
                self.kids.append(kids)
                self.label.append(labels[i])
                self.size.append(1 + sum(self.size[k] for k in kids))
            of[i] = number
        return of


def _ends(xs: Sequence[int], ys: Sequence[int]) -> tuple[int, int]:
    """How many items the sequences share at the start, and then at the end."""
    n = min(len(xs), len(ys))
    head = next((k for k in range(n) if xs[k] != ys[k]), n)
    tail = next((k for k in range(n - head) if xs[-1 - k] != ys[-1 - k]), n - head)
    return head, tail


def _rows(xs: Sequence[int], ys: Sequence[int], weight: Callable[[int, int], int], row: np.ndarray) -> Iterator[np.ndarray]:
    """The next rows of the table of best weights of order-keeping mappings, from the row before xs on."""
    kinds, where = np.unique(np.asarray(ys, np.int64), return_inverse=True)
    known: dict[int, np.ndarray] = {}
    for x in xs:
        if x not in known:
            known[x] = np.array([weight(x, int(y)) for y in kinds], np.int32)
        after = row.copy()
        np.maximum(row[1:], row[:-1] + known[x][where], out=after[1:])
        row = np.maximum.accumulate(after)
        yield row


def align(xs: Sequence[int], ys: Sequence[int], weight: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """The heaviest order-keeping mapping of places of xs to places of ys; what doesn't map weighs 0.

    Equal subtrees at either end map to each other, which no mapping beats.  Of the table between only every k-th row is kept, k the
    root of their number, and the rows between are made again on the way back.
    """
    head, tail = _ends(xs, ys)
    ends = [(len(xs) - 1 - k, len(ys) - 1 - k) for k in range(tail)]
    xs, ys, out = xs[head : len(xs) - tail], ys[head : len(ys) - tail], [(k, k) for k in range(head)] + ends
    if not len(xs) or not len(ys):
        return out
    step = isqrt(len(xs)) + 1
    kept = [np.zeros(len(ys) + 1, np.int32)]
    for i, row in enumerate(_rows(xs, ys, weight, kept[0]), 1):
        if i % step == 0:
            kept.append(row)
    i, j = len(xs), len(ys)
    for block in range((len(xs) - 1) // step, -1, -1):
        lo = block * step
        table = [kept[block], *_rows(xs[lo:i], ys, weight, kept[block])]
        while i > lo and j:
            here, w = table[i - lo][j], weight(xs[i - 1], ys[j - 1])
            if w and here == table[i - lo - 1][j - 1] + w:
                out.append((head + i - 1, head + j - 1))
                i, j = i - 1, j - 1
            elif here == table[i - lo - 1][j]:
                i -= 1
            else:
                j -= 1
        i = lo
    return out


def match(a: str, b: str) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping mapping of equal labels whose parents are mapped too.

    Pairs of *different subtrees* are weighed, parts before wholes, each once however often it occurs; tables are not kept.
    """
    if a == b:
        return {i: i for i in range(a.count(";") + 1)}
    (la, ca, _), (lb, cb, _) = read_skeleton(a), read_skeleton(b)
    trees = Subtrees()
    na, nb = trees.add(la, ca), trees.add(lb, cb)
    seen, todo = {(na[0], nb[0])}, [(na[0], nb[0])]
    while todo:
        x, y = todo.pop()
        by: dict[str, set[int]] = {}
        for k in trees.kids[y]:
            by.setdefault(trees.label[k], set()).add(k)
        new = {(p, q) for p in set(trees.kids[x]) for q in by.get(trees.label[p], ()) if p != q} - seen
        seen |= new
        todo += new
    weights: dict[tuple[int, int], int] = {}
    weight = lambda x, y: trees.size[x] if x == y else weights.get((x, y), 0)
    for x, y in sorted(seen):
        xs, ys = trees.kids[x], trees.kids[y]
        head, tail = _ends(xs, ys)
        total = 1 + sum(trees.size[k] for k in xs[:head] + xs[len(xs) - tail :])
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if xs and ys:
            for row in _rows(xs, ys, weight, np.zeros(len(ys) + 1, np.int32)):
                pass
            total += int(row[-1])
        weights[x, y] = total
    out, nodes = {}, [(0, 0)]
    while nodes:
        x, y = nodes.pop()
        out[x] = y
        pairs = align([na[c] for c in ca[x]], [nb[c] for c in cb[y]], weight)
        nodes += [(ca[x][i], cb[y][j]) for i, j in pairs]
    return out


def content_nodes(skeleton: str, constant: dict[int, bool], chars: dict[int, float], links: dict[int, float], elements: bool = True) -> list[int]:
    """The nodes whose blocks are the page's main text.

    1. Template slots are out; only varying slots go on (all of them, if none varies).
    2. Of these, slots inside menus, headers, footers, forms and the like, by element or by name, vary but are no article.
    3. The region is the smallest element that holds most of the remaining text outside links, by what its slots hold
       over the host's pages, or the outermost article or main element around it.
    4. Slots outside an article or main element, where the page has one with text, are out; where it has none, so are lists
       of links, and a varying h1 before the region is its title.

    chars and links: mean characters of a slot's text, and of those inside links.  Without elements, article and main
    elements mean nothing.
    """
    labels, children, parents = read_skeleton(skeleton)
    n = len(labels)
    tags = [re.split(r"[.!]", x, maxsplit=1)[0] for x in labels]
    holds = [elements and (tags[i] in ("article", "main") or ".role-main" in labels[i]) for i in range(n)]
    bounds = [-1] * n  # the outermost such element around a node, itself included
    for i in range(n):
        bounds[i] = bounds[parents[i]] if i and bounds[parents[i]] >= 0 else i if holds[i] else -1
    for i in range(n - 1, 0, -1):  # from here on: or holds such an element
        holds[parents[i]] |= holds[i]
    varying = [i for i in chars if not constant.get(i)] or list(chars)

    def usable(by_name: bool, by_tag: bool) -> list[int]:
        aside = [False] * n
        for i in range(1, n):
            inner = bounds[parents[i]] >= 0
            names = labels[i][len(tags[i]) :]
            own = by_tag and (names.startswith("!hidden") or tags[i] in ASIDE and not (tags[i] == "header" and inner))
            named = NAMES.search(names.replace(".", " ")) if by_name and tags[i] not in ("html", "body", "article", "main") else None
            # A wrapper may be named after its parts, and an article's head is the article's.
            own = own or bool(named) and not holds[i] and not (inner and "head" in named[0].lower())
            aside[i] = own or aside[parents[i]]
        return sorted(i for i in varying if not aside[i])

    slots = usable(True, True) or usable(False, True) or usable(False, False)
    weight = [0.0] * n
    for i in slots:
        weight[i] = max(0.0, chars[i] - links.get(i, 0))
    for i in range(n - 1, 0, -1):
        weight[parents[i]] += weight[i]
    top = 0
    while (best := max(children[top], key=weight.__getitem__, default=None)) is not None and weight[best] >= 0.7 * weight[top] > 0:
        if not children[best] or not any(weight[c] for c in children[best]):
            break
        top = best
    top = bounds[top] if bounds[top] >= 0 else top
    inside = [False] * n
    for i in range(n):
        inside[i] = i == top or (parents[i] >= 0 and inside[parents[i]])
    region = [i for i in slots if inside[i]]
    if any(bounds[i] >= 0 and chars[i] for i in slots):
        return [i for i in region if bounds[i] >= 0] or [i for i in slots if bounds[i] >= 0]
    text = [i for i in region if links.get(i, 0) < 0.7 * max(1, chars[i])]
    title = [i for i in slots if tags[i] == "h1" and i < top and not inside[i] and links.get(i, 0) < 0.7 * max(1, chars[i])]
    return title + text if text else region or slots


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - 2**63


def _hosts(rows: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return rows.withColumn("host", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, form and the numbers of the content nodes, for each form (hash of a page's tree) of each host.

    Every page is parsed and counted: for each form and node, whether all texts are equal, how long they are, and which
    articles they stand beside.  A host's most frequent form is the reference with which its other forms, not pages, are
    aligned by simple tree matching; a slot is template if it holds the same text on all pages of the host, beside
    LEAST_PAGES different articles at least (a page's longest block stands for its article), so copies of one page under
    several addresses make no template.  What a slot holds is measured over all pages of the host as well.
    """

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}
        held = 0
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                skeleton = page.skeleton()
                entry = seen.setdefault((host, _hash(skeleton)), [skeleton, 0, {}])
                held -= 300 * len(entry[2]) - len(skeleton) * (entry[1] == 0)
                entry[1] += 1
                texts: dict[int, list] = {}
                longest = max((text for _, text, _ in page.blocks), key=len, default="")
                article = 1 << (_hash(longest) % ARTICLE_BITS)
                for node, text, link in page.blocks:
                    t = texts.setdefault(node, [[], 0, 0])
                    t[0].append(text)
                    t[1] += len(text)
                    t[2] += link
                for node, (text, chars, link) in texts.items():
                    h = _hash("\n\n".join(text))
                    s = entry[2].setdefault(node, [h, h, 0, 0, 0, 0])
                    s[:] = min(s[0], h), max(s[1], h), s[2] + 1, s[3] + chars, s[4] + link, s[5] | article
                held += 300 * len(entry[2])
                if held > HELD_BYTES:
                    yield _counted(seen)
                    seen, held = {}, 0
        if seen:
            yield _counted(seen)

    counted = _hosts(pages).select("host", "html").mapInArrow(
        count, "host string, form long, skeleton string, node int, low long, high long, pages long, chars long, links long, articles long")
    sums = [F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.bit_or("articles").alias("articles")]
    slots = saved(counted.groupBy("host", "form", "skeleton", "node").agg(*sums), "slots")
    forms = slots.filter("node = -1").select("host", "form", "skeleton", "pages")
    reference = forms.groupBy("host").agg(F.max_by("skeleton", F.struct("pages", "form")).alias("reference"))

    def align_forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                m = match(r.skeleton, r.reference)
                yield pd.DataFrame({"host": r.host, "form": r.form, "node": np.array(list(m), np.int32), "slot": np.array(list(m.values()), np.int32)})

    aligned = forms.join(reference, "host").select("host", "form", "skeleton", "reference").mapInPandas(align_forms, "host string, form long, node int, slot int")
    placed = slots.filter("node >= 0").drop("skeleton").join(aligned, ["host", "form", "node"], "left")
    # A slot that the reference lacks is a slot of its form alone.
    own = F.when(F.col("slot").isNull(), F.concat_ws("/", "form", "node")).otherwise(F.col("slot").cast("string"))
    placed = placed.withColumn("slot", own)
    held = placed.groupBy("host", "slot").agg(*sums)
    held = held.select(
        "host", "slot", ((F.col("low") == F.col("high")) & (F.bit_count("articles") >= LEAST_PAGES)).alias("constant"),
        (F.col("chars") / F.col("pages")).alias("chars"), (F.col("links") / F.col("pages")).alias("links"))
    kinds = placed.select("host", "form", "node", "slot").join(held, ["host", "slot"]).groupBy("host", "form").agg(
        F.collect_list(F.struct("node", "constant", "chars", "links")).alias("slots"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [
                content_nodes(r.skeleton, {s["node"]: s["constant"] for s in r.slots}, {s["node"]: s["chars"] for s in r.slots}, {s["node"]: s["links"] for s in r.slots})
                for r in f.itertuples()]
            yield pd.DataFrame({"host": f["host"], "form": f["form"], "keep": keep})

    return forms.join(kinds, ["host", "form"]).select("host", "form", "skeleton", "slots").mapInPandas(choose, "host string, form long, keep array<int>")


def _counted(seen: dict) -> pa.RecordBatch:
    rows = []
    for (host, form), (skeleton, pages, nodes) in seen.items():
        rows.append((host, form, skeleton, -1, 0, 0, pages, 0, 0, 0))
        rows += [(host, form, skeleton, node, *s) for node, s in nodes.items()]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 6]
    names = ["host", "form", "skeleton", "node", "low", "high", "pages", "chars", "links", "articles"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page: the article's blocks in page order, joined by two line ends.

    Character references are decoded and white space inside a block becomes one space.  A null or empty page, or one
    without a block, has the text ''; a page of a host with fewer than LEAST_PAGES pages has no template slots and is
    judged by its elements alone; a null url is a host of its own; repeated rows are extracted one by one; an
    empty table gives no rows; other columns are not read.  Pages of any length, with quotes, comments and elements left open, are
    read in linear time; two forms are aligned in the product of their numbers of siblings that differ.
    """
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    found = saved(wrappers(rows), "wrappers")
    size = found.agg(F.sum(F.length("host") + 4 * F.size("keep") + 40)).first()[0] or 0

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                read = [Page(x or "") for x in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), pa.array([_hash(p.skeleton()) for p in read], pa.int64()),
                     pa.array([[b[0] for b in p.blocks] for p in read], pa.list_(pa.int32())), pa.array([[b[1] for b in p.blocks] for p in read], pa.list_(pa.string()))],
                    names=["key", "url", "host", "form", "nodes", "texts"])

    source = _hosts(rows).select("key", "url", "host", "html")
    blocks = source.mapInArrow(cut, f"key {source.schema['key'].dataType.simpleString()}, url string, host string, form long, nodes array<int>, texts array<string>")
    joined = blocks.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["host", "form"], "left")
    kept = F.filter(F.arrays_zip("nodes", "texts"), lambda b: F.array_contains("keep", b["nodes"]))
    text = F.coalesce(F.array_join(F.transform(kept, lambda b: b["texts"]), "\n\n"), F.lit(""))
    return joined.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
