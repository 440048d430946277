"""Byte-level BPE: encoding and decoding of whole texts.

The words of all documents are counted first; the most frequent ones, encoded once,
become a minimal acyclic transducer (`lexicon`) of bounded size, which every task maps
into memory.  Words that it lacks are merged exactly, lowest rank first.  Decoding
goes from the ids alone.

Nulls: a null text is empty and gives no ids.  Rows that repeat a doc_id are encoded
one by one.  Very long texts are taken in pieces.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import shuffle_shards, slices, text_or_empty
from keystead.llm.lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 200_000  # words of the transducer
LEXICON_BYTES = 64  # longer words are merged
MEMO = 300_000  # stretches of text a task remembers at most
PIECE = 1 << 20  # characters taken at once
SIDE_BY_SIDE = 48  # bytes of the longest words that are merged together
SLOT_BITS = 18  # of the table of merges
ID = np.dtype("<i4")  # of packed ids
HASH = 0x1E3779B97F4A7C15
NEVER = 2**31 - 1

# Unicode's white space, and the pattern that splits text before merging.
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: letters of the Latin blocks.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"

# No word crosses the end of a stretch.  Most are single words: Latin letters before
# another ASCII sign, or stops before white space.  Else a run of white space but for
# its last sign, that sign if it isn't a blank, or what is no white space after a blank.
STRETCH = re.compile(
    rf" ?[{LATIN}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[.,;:!?]+(?=[{SPACE}]|\Z)|[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]"
)
WORD = regex.compile(WORDS.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
CUT = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Merges:
    """Vocabulary, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, number in vocab.items():
            self.bytes_of[number] = bytes(byte_of[c] for c in token)
        self.single = [0] * 256
        for number, value in enumerate(self.bytes_of):
            if len(value) == 1:
                self.single[value[0]] = number
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.rank: dict[int, int] = {}  # left << 32 | right: rank << 32 | merged id
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        names = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.digits = [str(i) for i in range(size)]
        self._fill()

    def _pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs (left << 32 | right); NEVER where there is no such merge."""
        slot = (keys * HASH).view(np.uint64) >> np.uint64(64 - SLOT_BITS)
        rank = np.full(keys.shape, NEVER, dtype=np.int32)
        whole = np.zeros(keys.shape, dtype=np.int32)
        left = np.arange(len(keys))
        at = slot.astype(np.int64)
        while len(left):
            found = self.slots[at]
            hit = found == keys[left]
            rank[left[hit]], whole[left[hit]] = self.ranks[at[hit]], self.wholes[at[hit]]
            go = ~hit & (found >= 0)  # the slot holds another pair: try the next one
            left, at = left[go], (at[go] + 1) & (len(self.slots) - 1)
        return rank, whole

    def _fill(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.ranks, self.wholes = (np.zeros(1 << SLOT_BITS, dtype=np.int32) for _ in range(2))
        keys = np.array(list(self.rank), dtype=np.int64)
        first = ((keys * HASH).view(np.uint64) >> np.uint64(64 - SLOT_BITS)).tolist()
        for at, key, found in zip(first, keys.tolist(), self.rank.values()):
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at], self.ranks[at], self.wholes[at] = key, found >> 32, found & 0xFFFFFFFF

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words, merged side by side; long words one by one."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda n: len(words[n]))
        while order and len(words[order[-1]]) > SIDE_BY_SIDE:
            n = order.pop()
            out[n] = self.merge(words[n])
        single = np.array(self.single, dtype=np.int64)
        for begin in range(0, len(order), 2048):
            rows = order[begin : begin + 2048]
            sizes = np.array([len(words[n]) for n in rows])
            width = int(sizes[-1])
            if not width:
                continue
            flat = single[np.frombuffer(b"".join(words[n] for n in rows), np.uint8)]
            ids = np.full((len(rows), width + 1), -1, dtype=np.int64)
            ids[np.arange(width + 1) < sizes[:, None]] = flat
            open_ = np.arange(len(rows))
            while len(open_) and ids.shape[1] > 1:
                own = ids[open_]
                real = own[:, 1:] >= 0
                rank = np.full(real.shape, NEVER, dtype=np.int32)
                whole = np.zeros(real.shape, dtype=np.int32)
                rank[real], whole[real] = self._pairs((own[:, :-1] << 32 | own[:, 1:])[real])
                j = rank.argmin(axis=1)  # the leftmost of the lowest rank
                more = rank[np.arange(len(j)), j] < NEVER
                open_, own, j, whole = open_[more], own[more], j[more], whole[more]
                columns = np.arange(own.shape[1] - 1)
                moved = np.take_along_axis(own, columns + (columns > j[:, None]), axis=1)
                moved[np.arange(len(j)), j] = whole[np.arange(len(j)), j]
                ids[open_, :-1] = moved
                ids[open_, -1] = -1
            for n, row in zip(rows, ids.tolist()):
                out[n] = row[: row.index(-1)]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, the leftmost of them, is merged until none is left."""
        ids = [self.single[b] for b in word]
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            whole = found & 0xFFFFFFFF
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(whole << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, whole, ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] << 32 | whole)) is not None:
                heapq.heappush(heap, (r, h, ids[h], whole))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def text_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut before single blanks between other signs, where no word can span."""
    start = 0
    while len(text) - start > size and (m := CUT.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class Encoder:
    """Encodes texts with a transducer, exact merging, and a bounded memory of stretches.

    Ids are kept packed, four bytes each: as lists of numbers they take some five times that.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.special = {s: np.array([i], ID).tobytes() for s, i in merges.special.items()}
        self.memo: dict[str, bytes] = {}

    def learn(self, stretches: set[str]) -> None:
        """Remember the ids of stretches that are new."""
        single = {s: s.encode() for s in stretches if s.removeprefix(" ").isalpha()}
        split = {s: [w.encode() for w in WORD.findall(s)] for s in stretches if s not in single}
        words = list({*single.values(), *chain.from_iterable(split.values())})
        places = self.lexicon.places(words).tolist() if words else []
        unseen = [w for w, p in zip(words, places) if p < 0]
        ids = {w: np.array(i, ID).tobytes() for w, i in zip(unseen, self.merges.merge_all(unseen))}
        ids.update((w, self.lexicon.ids_at(p).tobytes()) for w, p in zip(words, places) if p >= 0)
        self.memo.update((s, ids[w]) for s, w in single.items())
        self.memo.update((s, b"".join(map(ids.__getitem__, ws))) for s, ws in split.items())

    def known(self, stretches: list[list[str]]) -> None:
        new = set(chain.from_iterable(stretches)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set(chain.from_iterable(stretches))
        self.learn(new)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Packed ids of some texts; long ones are cut and go by themselves."""
        special, specials = self.special, self.merges.specials
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            self.known([s for _, s in waiting])
            for n, stretches in waiting:
                out[n].append(b"".join(map(self.memo.__getitem__, stretches)))
            waiting.clear()

        for n, text in enumerate(texts):
            for part in specials.split(text) if specials else [text]:
                if part in special:
                    flush()
                    out[n].append(special[part])
                    continue
                for piece in text_pieces(part):
                    waiting.append((n, STRETCH.findall(piece)))
                    held += len(piece)
                    if held > PIECE:
                        flush()
                        held = 0
        flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], ID).tolist()


_loaded: dict[str, object] = {}  # of a worker process: the last tokenizer and the last encoder


def merges_of(path: str) -> Merges:
    if _loaded.get("path") != path:
        _loaded.update(path=path, merges=Merges(path))
    return _loaded["merges"]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word is in the texts of all documents.

    The texts are cut at blanks and counted as they are first; only the distinct
    pieces are split into words.
    """
    # each piece but a text's first has its blank again
    cut = F.expr("transform(split(text, ' '), (p, i) -> if(i = 0, p, concat(' ', p)))")
    rough = docs.select(text_or_empty().alias("text")).select(F.explode(cut).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in WORD.findall(piece):
                    counts[word.encode()] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return rough.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The transducer of the `size` most frequent words of all documents; ties go by the word."""
    top = word_counts(docs).where(F.length("word").between(2, LEXICON_BYTES)).orderBy(F.desc("n"), "word").limit(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            ids = merges.merge_all(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    rows = top.select("word").repartition(shuffle_shards(docs.sparkSession)).mapInArrow(work, "word binary, ids array<int>").toArrow()
    return compile_lexicon(dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist())))


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(docs: DataFrame, path: str, lexicon: bytes | None, batch_rows: int) -> Step:
    """(doc_id, text) to (doc_id, ids), the texts in parts of some rows."""
    data = build_lexicon(docs, path) if lexicon is None else lexicon
    shared, name = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _loaded.get("lexicon") != (path, name):
            _loaded.update(lexicon=(path, name), encoder=Encoder(merges_of(path), Lexicon(shared.value)))
        encoder = _loaded["encoder"]
        for part in slices(batches, batch_rows):
            rows = encoder.packed(part.column(1).to_pylist())
            ends = np.cumsum([0] + [len(r) // ID.itemsize for r in rows]).astype(np.int32)
            flat = np.frombuffer(b"".join(rows), ID)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])
        encoder.memo.clear()  # the worker lives on, for other stages

    return work


def _digesting(path: str, with_ids: bool) -> Step:
    """(doc_id, ids) to the columns of `digests`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for row in batch.column(1):
                ids = row.values.to_numpy(zero_copy_only=False).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(merges.digits.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(merges.decode(ids).encode()).hexdigest())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out + [batch.column(1)] * with_ids, names=names + ["ids"] * with_ids)

    return work


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def _digest_kind(with_ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids


def encode(docs: DataFrame, path: str, lexicon: bytes | None = None, batch_rows: int = 512) -> DataFrame:
    """(doc_id, ids) for every row of (doc_id, text)."""
    return _texts(docs).mapInArrow(_encoding(docs, path, lexicon, batch_rows), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            texts = [None if ids is None else merges.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")


def digests(tokens: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""
    return tokens.mapInArrow(_digesting(path, with_ids), _digest_kind(with_ids))


def encoded_digests(docs: DataFrame, path: str, with_ids: bool = False, lexicon: bytes | None = None, batch_rows: int = 512) -> DataFrame:
    """`digests` of `encode`, both in one Python worker a task: each worker has a vocabulary of its own."""
    encoding, digesting = _encoding(docs, path, lexicon, batch_rows), _digesting(path, with_ids)
    return _texts(docs).mapInArrow(lambda batches: digesting(encoding(batches)), _digest_kind(with_ids))
