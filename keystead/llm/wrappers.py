"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of tags and texts and folded: siblings of equal structure
become one.  Pages of one host are aligned level by level: what both have is matched,
what one lacks becomes optional, neighbours with one label become a repeated group,
and texts that differ become slots.  The result is the host's wrapper, a regular
expression without alternatives.  The wrapper decides which parts are the article;
every page is aligned with it, and the texts of those parts are its main text.

A host may have several templates.  Pages with a marked article, pages with a main
element only and other pages have wrappers of their own, and a page that lacks the part
that holds most of the varying text gets the part that holds most of the rest.

Structures are counted in each task and by (host, structure) before any are aligned,
a host's structures are aligned in ranges and the ranges then with each other, so a
host with a third of the pages is no task's burden.  The pages themselves move only
if the wrappers are too many for Catalyst to broadcast.

Nulls: null html is empty and has an empty text; pages without a usable url share the
host ''.  Repeated rows are read one by one.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.session import stage

# Fixed values of HTML: elements without content, with raw content, that are blocks,
# and what an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe template".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}

# Elements and words of class, id and role that are not the article.
NOT_MAIN = set("head nav footer aside form script style noscript template textarea select button svg iframe object title dialog menu xmp".split())
NOISE = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs"
    " sidebar side aside header masthead footer cookie cookies consent notice notices alert newsletter subscribe subscription signup login"
    " share sharing social related recommended popular trending comment comments disqus respond reply replies widget popup modal search"
    " pagination pager tags toolbar copyright".split()
)
NOISE_PARTS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo breadcrumb breadcrumbs sidebar cookie cookies newsletter share sharing"
    " social related recommended comment comments disqus pagination".split()
)
SAYS_WITH = {"has", "is", "no", "not", "with", "without"}
PART = re.compile(r"[^a-z0-9]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
MAIN = {"main", "articlebody"}
PAGE = {"html", "body", "main", "article"}  # class and id say nothing against these

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

SALTS = 16
TABLE = 1 << 14  # cells up to which an alignment is worked out in a table
DEPTH = 200  # elements nested deeper lie side by side in the last of these
SLOT = "#"


def label(tag: str, attributes: str) -> str:
    """The tag, with the words of its attributes that speak for or against the article."""
    if not attributes or attributes.isspace():
        return tag
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true" or name.lower() == "style" and UNSEEN.search(value):
            words.add("hidden")
        elif name.lower() in ("aria-hidden", "style"):
            continue
        elif name.lower() in ("role", "itemprop"):
            words |= {w for w in (value,) if w in MAIN or w in ("navigation", "banner", "search", "complementary", "contentinfo")}
        else:
            if tag in PAGE:
                continue
            # has-sidebar is no sidebar, and section-header may be a heading: only some words count as part of a name
            words |= NOISE.intersection(value.split())
            if tag not in HEADINGS:
                parts = (set(PART.split(n)) for n in value.split())
                words |= {w for p in parts if SAYS_WITH.isdisjoint(p) for w in p & NOISE_PARTS}
    return f"{tag}.{'.'.join(sorted(words))}" if words else tag


class Node:
    __slots__ = ("tag", "label", "children", "sig", "folded")

    def __init__(self, tag: str, name: str):
        self.tag, self.label, self.children = tag, name, []


def parse(page: str) -> Node:
    """The page as a tree; missing end tags are implied as HTML has it."""
    root = Node("#root", "#root")
    stack, at, raw = [root], 0, None

    def text(value: str) -> None:
        if value and not value.isspace():
            stack[-1].children.append(value)
        elif value and stack[-1].children and isinstance(stack[-1].children[-1], (str, Node)):
            stack[-1].children.append(" ")

    while at <= len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(page, at)
            stack[-1].children.append(page[at : end.start() if end else len(page)])
            stack.pop()
            at, raw = (end.end() if end else len(page)), None
        m = TAG.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # an inline end tag closes nothing beyond its block
            if depth and (tag in BLOCK or not any(n.tag in BLOCK for n in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if tag in CLOSES_P and any(n.tag == "p" for n in stack):
            depth = max(i for i, n in enumerate(stack) if n.tag == "p")
            if not any(n.tag in ("td", "th", "table") for n in stack[depth + 1 :]):
                del stack[depth:]
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in HOLDS.get(tag, ()):
                    break
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
        node = Node(tag, label(tag, m[3]))
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
            raw = tag if tag in RAW else None
    return root


def fold(node: Node) -> int:
    """Structure of a node as a number; children of equal structure side by side count once.

    folded lists the kept children: (structure, what holds it); texts side by side are one slot.
    """
    kept: list[tuple[int, object]] = []
    for child in node.children:
        sig = 0 if isinstance(child, str) else fold(child)
        if not kept or kept[-1][0] != sig:
            if child != " ":
                kept.append((sig, child))
    node.folded = kept
    node.sig = xxhash.xxh64_intdigest(node.label + "".join(f",{s}" for s, _ in kept)) >> 2 | 1
    return node.sig


def skeleton(node: Node) -> list:
    """[label, occurrence, children]; a text slot is [SLOT, occurrence, [first, varies, chars]]."""
    out = []
    for sig, child in node.folded:
        if sig:
            out.append(skeleton(child))
        else:
            out.append([SLOT, "1", [xxhash.xxh32_intdigest(child.strip()), 0, len(child)]])
    return [node.label, "1", out]


def slots(node: Node) -> list[tuple[int, int]]:
    """Hash and length of the first text of every slot."""
    out = []
    for sig, child in node.folded:
        if sig:
            out.extend(slots(child))
        else:
            out.append((xxhash.xxh32_intdigest(child.strip()), len(child)))
    return out


# --- inference ---------------------------------------------------------------

def _occurrence(a: str, b: str) -> str:
    optional, many = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return ("*" if optional else "+") if many else ("?" if optional else "1")


def merge_items(a: list, b: list) -> list:
    """One expression for both; they have the same label."""
    if a[0] == SLOT:
        x, y = a[2], b[2]
        return [SLOT, _occurrence(a[1], b[1]), [x[0], int(x[1] or y[1] or x[0] != y[0]), x[2] + y[2]]]
    return [a[0], _occurrence(a[1], b[1]), repeated(align(a[2], b[2]))]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of a with every beginning of b, in bits of one number."""
    places: dict[str, np.ndarray] = {}
    for name in set(a).intersection(b):
        hit = np.fromiter((x == name for x in b), dtype=np.uint8, count=len(b))
        places[name] = int.from_bytes(np.packbits(hit, bitorder="little").tobytes(), "little")
    whole = (1 << len(b)) - 1
    row = whole
    for name in a:
        if met := row & places.get(name, 0):
            row = (row + met | row - met) & whole
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(zeros, dtype=np.int64)))


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in space that grows with a and b only."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, m, j, n = waiting.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= TABLE or m - i == 1:
            out += [(i + x, j + y) for x, y in _by_table(a[i:m], b[j:n])]
            continue
        # the middle of a meets b where both halves have most in common
        half = (i + m) // 2
        split = j + int(np.argmax(_lengths(a[i:half], b[j:n]) + _lengths(a[half:m][::-1], b[j:n][::-1])[::-1]))
        waiting += [(i, half, j, split), (half, m, split, n)]
    return sorted(out)


def _by_table(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """Matched items are merged, the others become optional."""
    out, i, j = [], 0, 0
    for x, y in [*common([k[0] for k in a], [k[0] for k in b]), (len(a), len(b))]:
        out += [[k[0], _occurrence(k[1], "?"), k[2]] for k in a[i:x] + b[j:y]]
        if x < len(a):
            out.append(merge_items(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def repeated(items: list) -> list:
    """Neighbours of one label become one repeated item."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            one = merge_items(out[-1], item)
            out[-1] = [one[0], "*" if out[-1][1] in "?*" and item[1] in "?*" else "+", one[2]]
        else:
            out.append([item[0], item[1], item[2] if item[0] == SLOT else repeated(item[2])])
    return out


def merge_wrappers(wrappers: list[list]) -> list:
    whole = repeated(wrappers[:1])[0]
    for other in wrappers[1:]:
        whole = merge_items(whole, repeated([other])[0])
    return whole


# --- the article of a wrapper ---------------------------------------------------

def _noise(item: list, spared: Container[int] = ()) -> bool:
    """Whether an element is not the article, by its tag or, unless spared, by its words."""
    tag, *words = item[0].split(".")
    return tag in NOT_MAIN or any(w not in MAIN and not (w in NOISE and id(item) in spared) for w in words)


def _spared(wrapper: list) -> tuple[set[int], set[int]]:
    """Elements that class and id say nothing against: those with most of the varying text, and these with those that hold an article or main element."""
    sums: dict[int, int] = {}
    holders: set[int] = set()

    def walk(item: list, in_link: bool) -> tuple[int, bool]:
        if item[0] == SLOT:
            return (item[2][2] if item[2][1] and not in_link else 0), False
        tag, *words = item[0].split(".")
        if tag in NOT_MAIN or "hidden" in words:
            return 0, False
        below = [walk(k, in_link or tag == "a") for k in item[2]]
        sums[id(item)] = sum(n for n, _ in below)
        if any(x for _, x in below):
            holders.add(id(item))
        return sums[id(item)], any(x for _, x in below) or tag in PAGE - {"html", "body"} or not MAIN.isdisjoint(words)

    whole, _ = walk(wrapper, False)
    most = {i for i, n in sums.items() if 2 * n > whole}
    return most, most | holders


def _variable(item: list, spared: Container[int], taken: Container[int] = (), in_link: bool = False) -> int:
    """Characters in slots that differ from page to page, outside links, noise and what is taken."""
    if item[0] == SLOT:
        return item[2][2] if item[2][1] and not in_link else 0
    if id(item) in taken or _noise(item, spared):
        return 0
    return sum(_variable(k, spared, taken, in_link or item[0] == "a") for k in item[2])


def _find(item: list, wanted, spared: Container[int] = ()) -> list[list]:
    if item[0] == SLOT or _noise(item, spared):
        return []
    return [item] if wanted(item) else [x for k in item[2] for x in _find(k, wanted, spared)]


def _known(item: list, spared: Container[int]) -> tuple[str, list[list]]:
    """What the article is known by, and its parts: a marked article, else a main element; in noise only if nowhere else."""
    for inside in ((), spared):
        if found := _find(item, lambda k: k[0].split(".")[0] == "article" or "articlebody" in k[0].split("."), inside):
            return ("article in noise" if inside else "article"), found
        if found := _find(item, lambda k: k[0].split(".")[0] == "main" or "main" in k[0].split("."), inside):
            return ("main in noise" if inside else "main"), found
    return "varying", []


def kind(item: list) -> str:
    """What the article of a structure is known by; structures of one kind have one wrapper."""
    return _known(item, _spared(item)[1])[0]


def choose(wrapper: list) -> list:
    """The wrapper with a fourth field on every item: a bit for each choice that it is part of.

    The article is what is marked as such; else the least element that holds most of
    the text that differs from page to page, then the one that holds most of the rest,
    and so on: the lowest bit of a page is its article.
    """
    most, spared = _spared(wrapper)
    name, found = _known(wrapper, spared)
    spared = spared if name.endswith("in noise") else most
    choices = [found] if found else []
    taken: set[int] = set()
    while not found:
        whole, best = _variable(wrapper, spared, taken), wrapper
        while whole:
            larger = [k for k in best[2] if k[0] != SLOT and _variable(k, spared, taken) > 0.8 * whole]
            if not larger or larger[0][0].split(".")[0] in ("p", "span", "b", "i", "a", "li"):
                break
            best = larger[0]
        if not whole:
            choices.append(_find(wrapper, lambda k: k[0].split(".")[0] == "body", spared) or [wrapper])
            break
        choices.append([best])
        taken.add(id(best))
    bits: dict[int, int] = {}
    for n, chosen in enumerate(choices):
        for k in chosen:
            bits[id(k)] = bits.get(id(k), 0) | 1 << n

    def mark(item: list, inside: int) -> list:
        inside |= bits.get(id(item), 0)
        if item[0] == SLOT:
            return [SLOT, item[1], item[2], inside]
        inside = 0 if _noise(item, spared) else inside
        return [item[0], item[1], [mark(k, inside) for k in item[2]], inside]

    return mark(wrapper, 0)


# --- applying ------------------------------------------------------------------

def plan(node: Node, wrapper: list | None) -> list:
    """For each kept child of a page's node: its choices for texts, a plan for elements."""
    if wrapper is None:
        return [0 if not sig else plan(child, None) for sig, child in node.folded]
    items = wrapper[2]
    names = [SLOT if not sig else child.label for sig, child in node.folded]
    # a repeated item takes all neighbours of its label
    runs = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    place = {runs[x]: y for x, y in common([names[i] for i in runs], [k[0] for k in items])}
    starts = set(runs)
    out, item = [], None
    for i, (sig, child) in enumerate(node.folded):
        if i in starts:
            item = items[place[i]] if i in place else None
        if not sig:
            out.append(item[3] if item else wrapper[3])
        else:
            out.append(plan(child, item))
    return out


def _choices(how: list) -> int:
    out = 0
    for own in how:
        out |= _choices(own) if isinstance(own, list) else own
    return out


def settled(how: list) -> list:
    """The plan with 1 for the texts of the first choice that the page has, 0 for others."""
    first = (found := _choices(how)) & -found

    def walk(own: list) -> list:
        return [walk(k) if isinstance(k, list) else int(bool(k & first)) for k in own]

    return walk(how)


def main_text(root: Node, how: list) -> str:
    """Texts of the article, block by block."""
    blocks: list[list[str]] = [[]]

    def walk(node: Node, how: list) -> None:
        at, last = -1, None
        for child in node.children:
            sig = 0 if isinstance(child, str) else child.sig
            if child == " " and last is None:
                continue
            if last is None or sig != last:
                if child != " ":
                    at, last = at + 1, sig
            own = how[at] if 0 <= at < len(how) else 0
            if isinstance(child, str):
                if child == " " and last != 0 or own == 1:
                    blocks[-1].append(child)
                continue
            if child.tag in BLOCK:
                blocks.append([])
            walk(child, own if isinstance(own, list) else [])
            if child.tag in BLOCK:
                blocks.append([])

    walk(root, how)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return " ".join(x for x in lines if x)


def structures(pages: DataFrame) -> DataFrame:
    """(host, sig, skeleton, n): the distinct structures of each host, with what their texts have in common."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, s, json.dumps(_filled(k, v)), n) for (h, s), (k, v, n) in seen.items()]
            seen.clear()
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["host", "sig", "skeleton", "n"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(page)
                fold(root)
                own = slots(root)
                if (known := seen.get((host, root.sig))) is None:
                    seen[host, root.sig] = [skeleton(root), [[h, 0, n] for h, n in own], 1]
                else:
                    for stat, (h, n) in zip(known[1], own):
                        stat[1] |= stat[0] != h
                        stat[2] += n
                    known[2] += 1
            if len(seen) > 5_000:
                yield out()
        yield out()

    def join(group: pa.Table) -> pa.Table:
        whole = json.loads(group.column("skeleton")[0].as_py())
        for other in group.column("skeleton").to_pylist()[1:]:
            whole = merge_items(whole, json.loads(other))
        return pa.table({k: pa.array(v, t) for k, v, t in (
            ("host", [group.column("host")[0].as_py()], pa.string()), ("sig", [group.column("sig")[0].as_py()], pa.int64()),
            ("skeleton", [json.dumps(whole)], pa.string()), ("n", [sum(group.column("n").to_pylist())], pa.int64()))})

    kind = "host string, sig long, skeleton string, n long"
    return _hosts(pages).select("host", "html").mapInArrow(work, kind).groupBy("host", "sig").applyInArrow(join, kind)


def _filled(item: list, stats: list) -> list:
    """The skeleton with the slots' statistics, in order."""
    left = iter(stats)

    def walk(k: list) -> list:
        return [SLOT, k[1], next(left)] if k[0] == SLOT else [k[0], k[1], [walk(c) for c in k[2]]]

    return walk(item)


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrappers of each host by kind of page as JSON, their articles marked."""

    def merge(last: bool):
        def work(group: pa.Table) -> pa.Table:
            rows = sorted(zip(group.column("sig").to_pylist(), group.column("skeleton").to_pylist()))
            kinds: dict[str, list[tuple[int, list]]] = {}
            for sig, text in rows:
                one = json.loads(text)
                kinds.setdefault(kind(one), []).append((sig, one))
            host = group.column("host")[0].as_py()
            wholes = {k: merge_wrappers([w for _, w in own]) for k, own in kinds.items()}
            if last:
                return pa.table({"host": pa.array([host], pa.string()), "wrapper": pa.array([json.dumps({k: choose(w) for k, w in wholes.items()})], pa.string())})
            return pa.table({
                "host": pa.array([host] * len(wholes), pa.string()), "sig": pa.array([own[0][0] for own in kinds.values()], pa.int64()),
                "skeleton": pa.array([json.dumps(w) for w in wholes.values()], pa.string())})
        return work

    parts = structures(pages).withColumn("salt", F.pmod("sig", F.lit(SALTS)))
    parts = parts.groupBy("host", "salt").applyInArrow(merge(False), "host string, sig long, skeleton string")
    return parts.groupBy("host").applyInArrow(merge(True), "host string, wrapper string")


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html)."""
    wrappers = stage(infer(pages) if wrappers is None else wrappers, "wrappers").select(F.col("host").alias("w_host"), "wrapper")
    rows = _hosts(pages)
    joined = rows.join(wrappers, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "wrapper")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict[str, list]] = {}
        plans: dict[tuple[str, int], list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                root = parse(page)
                fold(root)
                key = (wrapper, root.sig)
                if key not in plans:
                    if len(plans) > 20_000:
                        plans.clear()
                        read.clear()
                    if wrapper not in read:
                        read[wrapper] = json.loads(wrapper) if wrapper else {}
                    own = skeleton(root)
                    how = read[wrapper].get(kind(own)) or choose(merge_wrappers([own]))
                    plans[key] = settled(plan(root, how))
                texts.append(main_text(root, plans[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return joined.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
