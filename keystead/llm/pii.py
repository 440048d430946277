"""Personal data: fixed patterns, and what a character tagger finds beyond them.

The patterns give the base spans; they also label the windows that a bidirectional
LSTM with CRF transitions is trained on, some of them altered as people alter numbers
(no country code, other separators).  Every stretch of text around a digit or an @,
without which none of the four kinds can be, is cut into overlapping windows; their
emissions are blended, each sign counting most where it lies central, and one path is
decoded over the whole stretch.  Spans that overlap no base span and of which the
model is sure are added.

Bounds: WINDOWS training windows, drawn by hash from all documents, bound the model and
not what it is applied to.

Nulls: a null text is empty.  Rows that repeat a doc_id are read one by one.  Without
training windows nothing is added.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import slices, text_or_empty
from keystead.llm.tagger import Tagger, codes

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SIGNAL = re.compile(r"[0-9@]")
PAD = 32  # signs around a signal that belong to its stretch
WIDTH, STRIDE = 96, 48  # of windows
LONG, MARGIN = 2048, 128  # signs of a piece that is decoded, and of its ends that only lend context
CELLS = 1 << 16  # signs that are decoded at a time
WINDOWS = 3_000  # training windows
EPOCHS = 4
SURE = 0.97  # least mean marginal of an added span
LEAST = {"email": 6, "ip": 7, "card": 16, "phone": 8}  # least signs of an added span
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # place in KINDS, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap for each kind; linear in the text."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = re.sub(r"[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within PAD signs of a digit or an @."""
    out: list[tuple[int, int]] = []
    for m in SIGNAL.finditer(text):
        a, b = max(0, m.start() - PAD), min(len(text), m.end() + PAD)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _tags(n: int, spans: list[Span], start: int) -> np.ndarray:
    y = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        if a >= start and b <= start + n:
            y[a - start : b - start] = 2 * kind + 2
            y[a - start] = 2 * kind + 1
    return y


def altered(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The window with its first phone or card written in another way; the choice follows the text."""
    pick = xxhash.xxh32_intdigest(text)
    for kind, a, b in spans:
        own = text[a:b]
        if kind == 3:
            own = re.sub(r"^\+[0-9]+[ .-]*", "", own)
            own = (own, re.sub(r"[()]", "", own), re.sub(r"[() .-]+", ".", own).strip("."), own.replace(") ", "-").lstrip("("))[pick % 4]
        elif kind == 2:
            digits = re.sub(r"[ -]", "", own)
            own = (".", "/", "_")[pick % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            continue
        if len(own) >= LEAST[KINDS[kind]]:
            moved = len(own) - (b - a)
            rest = [(k, s + moved * (s >= b), e + moved * (e >= b)) for k, s, e in spans if (k, s, e) != (kind, a, b)]
            return text[:a] + own + text[b:], sorted([*rest, (kind, a, a + len(own))], key=lambda x: x[1])
    return text, spans


def training_windows(docs: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """(text, spans) of up to `windows` stretches of all documents, by their hash; those with spans come first by half."""
    half = windows // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                parts = stretches(text)
                if not parts:
                    continue
                spans = base_spans(text)
                for a, b in parts:
                    middle = a + (xxhash.xxh32_intdigest(text[a:b]) % max(1, b - a - WIDTH + 1) if b - a > WIDTH else 0)
                    part = text[middle : middle + WIDTH]
                    own = [[k, s - middle, e - middle] for k, s, e in spans if s >= middle and e <= middle + len(part)]
                    cut = any(s < middle + len(part) and e > middle and [k, s - middle, e - middle] not in own for k, s, e in spans)
                    if not cut:
                        rows.append((part, own))
            columns = list(zip(*rows)) or [(), ()]
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], kind)], names=["part", "spans"])

    found = docs.select(text_or_empty().alias("text")).mapInArrow(work, "part string, spans array<array<int>>").withColumn("order", F.xxhash64("part"))
    some = found.where("size(spans) > 0").orderBy("order", "part").limit(half)
    none = found.where("size(spans) = 0").orderBy("order", "part").limit(half)
    return some.unionByName(none).select("part", "spans")


def train(docs: DataFrame, windows: int = WINDOWS, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger trained on the bounded sample and on altered copies of it."""
    rows = training_windows(docs, windows).collect()  # `windows` short texts at most
    examples = [(r["part"], [tuple(s) for s in r["spans"]]) for r in rows]
    if not any(s for _, s in examples):
        return None
    examples += [x for x in (altered(*e) for e in examples if e[1]) if x not in examples]
    examples.sort()
    x, y = np.full((len(examples), WIDTH), 99, dtype=np.int64), np.zeros((len(examples), WIDTH), dtype=np.int64)
    for i, (text, spans) in enumerate(examples):
        part = text[:WIDTH]
        x[i, : len(part)] = codes(part)
        y[i, : len(part)] = _tags(len(part), spans, 0)
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.fit(x, y, epochs)
    return tagger


def blended(tagger: Tagger, parts: list[str]) -> list[np.ndarray]:
    """Emissions of each stretch, blended from its overlapping windows."""
    cuts = [(n, at) for n, part in enumerate(parts) for at in range(0, max(1, len(part) - WIDTH + STRIDE), STRIDE)]
    shape = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1))[:, None].astype(float)
    sums = [np.zeros((len(p), tagger.tags)) for p in parts]
    weights = [np.zeros((len(p), 1)) for p in parts]
    signs = [codes(p) for p in parts]
    for begin in range(0, len(cuts), 512):
        batch = cuts[begin : begin + 512]
        x = np.full((WIDTH, len(batch)), 99, dtype=np.int64)
        for c, (n, at) in enumerate(batch):
            own = signs[n][at : at + WIDTH]
            x[: len(own), c] = own
        e = tagger.emissions(x)
        for c, (n, at) in enumerate(batch):
            size = min(WIDTH, len(parts[n]) - at)
            sums[n][at : at + size] += e[:size, c] * shape[:size]
            weights[n][at : at + size] += shape[:size]
    return [s / w for s, w in zip(sums, weights)]


def _cut(parts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(part, start, stop, lo, hi): pieces of LONG signs at most that overlap; spans that begin from lo to hi are a piece's own."""
    out = []
    for n, part in enumerate(parts):
        step = LONG - 2 * MARGIN
        for at in range(0, max(1, len(part) - 2 * MARGIN), step) if len(part) > LONG else (0,):
            last = at + LONG >= len(part)
            stop = min(at + LONG, len(part))
            out.append((n, at, stop, at + MARGIN if at else 0, len(part) if last else stop - MARGIN))
            if last:
                break
    return out


def found_spans(tagger: Tagger, parts: list[str]) -> list[list[Span]]:
    """Spans of each stretch of which the model is sure, from one path over the stretch.

    A stretch of more than LONG signs is decoded in pieces that overlap: a span belongs
    to the piece in whose middle it begins, and of spans that overlap the first stays.
    """
    out: list[list[Span]] = [[] for _ in parts]
    pieces = sorted(_cut(parts), key=lambda p: p[2] - p[1])
    begin = 0
    while begin < len(pieces):  # as many of about one length as CELLS allow
        end = begin + 1
        while end < len(pieces) and end - begin < 128 and (pieces[end][2] - pieces[end][1]) * (end - begin + 1) <= CELLS:
            end += 1
        own = pieces[begin:end]
        for (n, start, _, lo, hi), spans in zip(own, _decoded(tagger, [parts[p[0]][p[1] : p[2]] for p in own])):
            out[n] += [(k, a + start, b + start) for k, a, b in spans if lo <= a + start < hi]
        begin = end
    for n, spans in enumerate(out):
        kept: list[Span] = []
        for span in sorted(spans, key=lambda s: s[1:]):
            if not kept or span[1] >= kept[-1][2]:
                kept.append(span)
        out[n] = kept
    return out


def _decoded(tagger: Tagger, parts: list[str]) -> list[list[Span]]:
    emissions = blended(tagger, parts)
    out: list[list[Span]] = [[] for _ in parts]
    steps = max(map(len, parts))
    e = np.zeros((steps, len(parts), tagger.tags))
    e[:, :, 1:] = -50.0  # beyond a stretch there is nothing
    for c, own in enumerate(emissions):
        e[: len(own), c] = own
    path, (_, marginal, _) = tagger.decode(e), tagger.marginals(e)
    for c, part in enumerate(parts):
        tags = path[:, c].tolist()
        at = 0
        while at < len(part):
            if tags[at] == 0:
                at += 1
                continue
            kind, end = (tags[at] - 1) // 2, at + 1
            while end < len(part) and tags[end] == 2 * kind + 2:
                end += 1
            sure = float(np.mean(marginal[np.arange(at, end), c, path[at:end, c]]))
            if sure >= SURE and end - at >= LEAST[KINDS[kind]] and tags[at] == 2 * kind + 1:
                out[c].append((kind, at, end))
            at = end
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, tagger: Tagger | None = None, trained: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of (doc_id, text).

    The counts and base_sha256 are those of the patterns; spans has the added ones too.
    """
    if tagger is None and trained:
        tagger = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in slices(batches):
            bases, spans, parts, owners = [], [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                own = stretches(text)
                base = base_spans(text) if own else []
                bases.append(base)
                spans.append(list(base))
                for a, b in own:
                    parts.append(text[a:b])
                    owners.append((n, a))
            if tagger is not None:
                for (n, start), new in zip(owners, found_spans(tagger, parts)):
                    for kind, a, b in new:
                        a, b = a + start, b + start
                        if not any(s < b and a < e for _, s, e in bases[n]):
                            spans[n].append((kind, a, b))
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], pa.string())
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(s) for s in spans], pa.string())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
