"""Removal of passages that an earlier document has: repeated-phrase automata.

0.  A document whose whole text an earlier one has is a copy: it is one long passage, told
    by digests, and needs no search.
1.  Every window of 50 words has an anchor: the smallest hash of the word groups of
    half its length in it.  Equal windows have equal anchors.  Counting filters find
    the anchors that occur more than once; a bitmap of fixed size tells them.
2.  Windows with such an anchor leave the document as hashes; counting filters drop
    those whose own hash occurs once.  A window whose hash is in two documents recurs;
    the smallest doc_id owns it.  Stretches of owned windows
    are the passages.
3.  The words of the passages are confirmed by text: they are sent to the documents
    that need them, and the documents of a shard are streamed through the Aho-Corasick
    automaton of the shard's passages.  Its patterns are tiles of half a window, one of
    which is in every window; each match is extended word by word to the whole
    occurrence.  An occurrence of at least a window's length is removed.

Text moves only for documents that own or need a passage.  A shard holds the documents
of one range of hashed doc_ids and what they need, so its size is set by the number
of shards and not by how often a passage occurs.

Nulls: a null text has no words.  A row with a null doc_id keeps all its words and
takes none from others.  Rows that repeat a doc_id are treated one by one, and take
nothing from each other.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import pieces, prefix_bitmap, routed, shuffle_shards, slices, text_or_empty
from keystead.llm.exact_dedup import BLOCKS, filter_blocks, in_bits, partition_filters, recurring_bits
from keystead.session import release, stage

WINDOW = 50
ROUTE_BITS = 26  # the bitmap of recurring anchors: 8 MB whatever the input
DOC_BITS = 22  # the bitmap of documents that own or need a passage
PLACE_BITS = 40  # a place is a mark of the text above, the number of the word below
MEMO = 150_000

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _Hashes(dict):
    """Hashes of words, worked out once; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    parts = [np.array(list(map(_hashes.__getitem__, p.split())), dtype=np.uint64) for p in pieces(text.encode("utf-8", "replace"))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def group_hashes(prefix: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all groups of `size` consecutive words."""
    return _mixed((prefix[size:] - prefix[:-size]) * back[: len(prefix) - size])


def windows(text: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of every window of a text."""
    words = word_hashes(text)
    if len(words) < window:
        return words[:0], words[:0]
    to, back = powers(len(words) + 1)
    prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * to[: len(words)], dtype=np.uint64)))
    half = window // 2
    least, width, want = group_hashes(prefix, back, half), 1, window - half + 1
    while 2 * width <= want:  # minima of doubled spans, then two that overlap
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if want > width:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    return group_hashes(prefix, back, window), least


def split_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, text) of the rows whose text no smaller doc_id has, and of the others.

    All windows of a copy are in the document it copies, which alone has to be looked
    at.  Digests say which texts repeat; only rows that may be among them move.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).withColumn("fp", F.xxhash64("text"))
    sha = F.unhex(F.sha2("text", 256))
    repeated = (
        rows.where("doc is not null").groupBy("fp", sha.alias("sha")).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last").select(F.col("fp").alias("r_fp"), F.col("sha").alias("r_sha"), "first")
    )
    repeated = stage(repeated, "repeated")
    bitmap = stage(prefix_bitmap(repeated.select("r_fp"), "r_fp", DOC_BITS), "texts")
    once = routed(rows, "fp", bitmap, DOC_BITS, keep=False).select("doc", "text")
    maybe = routed(rows, "fp", bitmap, DOC_BITS).withColumn("sha", sha)
    maybe = stage(maybe.join(repeated, (F.col("fp") == F.col("r_fp")) & (F.col("sha") == F.col("r_sha")), "left").select("doc", "text", "first"), "copies")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    return once.unionByName(maybe.where(~copy).select("doc", "text")), maybe.where(copy).select("doc", "text")


def _known(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("doc").isNotNull()).select("doc", "text")


def _mark(text: Column) -> Column:
    """Tells rows that repeat a doc_id apart."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)), PLACE_BITS)


def recurring_anchors(rows: DataFrame, window: int = WINDOW) -> bytes:
    """The bitmap of leading bits of anchors that are in more than one place."""

    shards = shuffle_shards(rows.sparkSession)

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                anchors = windows(text, window)[1]
                if len(anchors):
                    yield np.unique(anchors[np.append(True, anchors[1:] != anchors[:-1])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filter_blocks(anchors_of(batches), shards)
        _hashes.clear()

    return recurring_bits(_known(rows).select("text").mapInArrow(work, BLOCKS), ROUTE_BITS)


def window_places(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, doc, place) of every window whose anchor recurs."""
    shared = rows.sparkSession.sparkContext.broadcast(recurring_anchors(rows, window))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in slices(batches):
            hs, ds, ps = [], [], []
            for doc, text, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h, anchor = windows(text, window)
                hit = np.flatnonzero(in_bits(bits, anchor))
                if len(hit):
                    hs.append(h[hit])
                    ds.append(np.full(len(hit), doc, dtype=np.int64))
                    ps.append(hit + mark)
                if sum(map(len, hs)) > 1 << 18:
                    yield _places(hs, ds, ps)
                    hs, ds, ps = [], [], []
            if hs:
                yield _places(hs, ds, ps)
        _hashes.clear()

    return _known(rows).withColumn("mark", _mark(F.col("text"))).mapInArrow(work, "h long, doc long, place long")


def _places(hs: list, ds: list, ps: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ps))], names=["h", "doc", "place"])


def recurring_places(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, doc, place) of the windows whose own hash occurs more than once, written."""
    found = stage(window_places(rows, window), "windows")
    shared = rows.sparkSession.sparkContext.broadcast(recurring_bits(partition_filters(found, "h"), ROUTE_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(in_bits(bits, batch.column(0).to_numpy().view(np.uint64))))

    places = stage(found.mapInArrow(work, "h long, doc long, place long"), "places")
    release(found)
    return places


def passages(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, owner, first, place): windows in several documents and the passage they belong to; and (owner, first, last) of the passages."""
    from pyspark.sql import Window

    owned = (
        places.groupBy("h").agg(F.min(F.struct("doc", "place")).alias("best"), F.max("doc").alias("last_doc"))
        .where("best.doc < last_doc").select("h", F.col("best.doc").alias("owner"), F.col("best.place").alias("place"))
    )
    # consecutive places of one document are one passage; a document bounds the window
    order = Window.partitionBy("owner").orderBy("place")
    islands = owned.withColumn("island", F.col("place") - F.row_number().over(order))
    first = F.min("place").over(Window.partitionBy("owner", "island"))
    rows = stage(islands.select("h", "owner", first.alias("first"), "place"), "owned")
    ends = rows.groupBy("owner", "first").agg(F.max("place").alias("last"))
    return rows, stage(ends, "passages")


def passage_texts(sources: DataFrame, ends: DataFrame, window: int = WINDOW) -> DataFrame:
    """(owner, first, passage): the words of the passages, from the documents that own them."""
    per_doc = ends.groupBy(F.col("owner"), F.shiftright("first", PLACE_BITS).alias("tag")).agg(
        F.collect_list(F.struct("first", "last")).alias("spans"))
    marked = _known(sources).withColumn("tag", F.shiftright(_mark(F.col("text")), PLACE_BITS)).withColumn("key", F.xxhash64("doc"))
    bitmap = stage(prefix_bitmap(ends.select(F.xxhash64("owner").alias("key")), "key", DOC_BITS), "owners")
    rows = routed(marked, "key", bitmap, DOC_BITS).select("doc", F.col("tag").alias("t"), "text")
    joined = rows.join(per_doc, (F.col("doc") == F.col("owner")) & (F.col("t") == F.col("tag"))).select("owner", "spans", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << PLACE_BITS) - 1
        for batch in slices(batches):
            out = []
            for owner, spans, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode("utf-8", "replace").split()
                out.extend((owner, s["first"], b" ".join(words[s["first"] & low : (s["last"] & low) + window])) for s in spans)
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["owner", "first", "passage"])

    return joined.mapInArrow(work, "owner long, first long, passage binary").dropDuplicates(["owner", "first"])


class Automaton:
    """Finds the passages of a shard in texts, by tiles of half a window.

    A window holds one of the tiles whole, and what is left of it lies beside the tile.
    A tile's places in a passage are told apart by the words beside them only, so the
    many places of a tile in a passage that repeats itself are looked at once.
    """

    def __init__(self, texts: dict[tuple[int, int], bytes], window: int = WINDOW):
        self.window, self.tile = window, window // 2
        side = window - self.tile
        where: dict[str, dict[tuple[int, int], dict[tuple, None]]] = {}
        for key, text in texts.items():
            words = text.split(b" ")
            for at in range(0, len(words) - self.tile + 1, self.tile):
                end = at + self.tile
                tile = " " + b" ".join(words[at:end]).decode("latin-1") + " "
                beside = (tuple(reversed(words[max(0, at - side) : at])), tuple(words[end : end + side]))
                where.setdefault(tile, {}).setdefault(key, {})[beside] = None
        self.found = ahocorasick.Automaton()
        for tile, keys in where.items():
            self.found.add_word(tile, (len(tile), keys))
        self.found.make_automaton()

    def removed(self, words: list[bytes], needed: set[tuple[int, int]]) -> np.ndarray:
        """Which words lie in an occurrence of a needed passage of a window's length at least."""
        out = np.zeros(len(words), dtype=bool)
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        for end, (size, keys) in self.found.iter(line):
            at = int(np.searchsorted(starts, end - size + 1))
            behind = at + self.tile
            for key in (needed if len(needed) < len(keys) else keys):
                if key not in needed or key not in keys:
                    continue
                for before, after in keys[key]:
                    a, b = at, behind
                    for w in before:
                        if a == 0 or words[a - 1] != w:
                            break
                        a -= 1
                    for w in after:
                        if b == len(words) or words[b] != w:
                            break
                        b += 1
                    if b - a >= self.window:
                        out[a:b] = True
        return out


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _kept(doc: int | None, words: list[bytes], gone: np.ndarray | None, texts: bool) -> tuple:
    left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
    line = b" ".join(left)
    return doc, len(words), len(words) - len(left), hashlib.sha256(line).hexdigest(), line.decode("utf-8", "replace") if texts else None


KIND = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeated(docs: DataFrame, window: int = WINDOW, shards: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, one blank between) of every row."""
    shards = shards or 4 * shuffle_shards(docs.sparkSession)
    sources, copies = split_copies(docs)
    places = recurring_places(sources, window)
    owned, ends = passages(places)
    mine = owned.select(F.col("h").alias("oh"), "owner", "first")
    needs = stage(
        places.join(mine, (F.col("h") == F.col("oh")) & (F.col("doc") > F.col("owner"))).select("doc", "owner", "first").distinct(), "needs")
    release(places, owned)
    bodies = passage_texts(sources, ends, window).select(F.col("owner").alias("o"), F.col("first").alias("f"), "passage")
    sent = needs.join(bodies, (F.col("owner") == F.col("o")) & (F.col("first") == F.col("f"))).select("doc", "owner", "first", "passage")

    rows = sources.withColumn("key", F.xxhash64(F.coalesce("doc", F.lit(0))))
    bitmap = stage(prefix_bitmap(needs.select(F.xxhash64("doc").alias("key")), "key", DOC_BITS), "needy")

    def all_or_none(gone: bool):
        """Rows that keep all their words, or lose them all if they fill a window."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = text.encode("utf-8", "replace").split()
                    out.append(_kept(doc, words, np.ones(len(words), dtype=bool) if gone and len(words) >= window else None, texts))
                yield _result(out)
        return work

    def cut(own: pa.Table, need: pa.Table) -> pa.Table:
        keys = list(zip(need.column("owner").to_pylist(), need.column("first").to_pylist()))
        needed: dict[int, set[tuple[int, int]]] = {}
        for doc, key in zip(need.column("doc").to_pylist(), keys):
            needed.setdefault(doc, set()).add(key)
        automaton = Automaton(dict(zip(keys, need.column("passage").to_pylist())), window) if keys else None
        out = []
        for doc, text in zip(own.column("doc").to_pylist(), own.column("text").to_pylist()):
            words = text.encode("utf-8", "replace").split()
            out.append(_kept(doc, words, automaton.removed(words, needed[doc]) if doc in needed else None, texts))
        return pa.Table.from_batches([_result(out)])

    shard = F.pmod(F.xxhash64("doc"), F.lit(shards)).alias("shard")
    untouched = routed(rows, "key", bitmap, DOC_BITS, keep=False).select("doc", "text").mapInArrow(all_or_none(False), KIND)
    touched = (
        routed(rows, "key", bitmap, DOC_BITS).select(shard, "doc", "text").groupBy("shard")
        .cogroup(sent.select(shard, "doc", "owner", "first", "passage").groupBy("shard"))
        .applyInArrow(cut, KIND)
    )
    return untouched.unionByName(touched).unionByName(copies.mapInArrow(all_or_none(True), KIND))
