"""Compression of vectors to short codes, with codebooks fitted over tries of their parts.

A vector is cut into PARTS consecutive parts, each with a codebook of ENTRIES entries.
Every task turns blocks of its vectors into one trie a part: the distinct parts in
lexicographic order with the number of vectors that have them.  A round walks a trie
depth first.  A node has the distances of its prefix to the prefixes of all entries;
its children add the square of their own dimension to them, so what parts have in
common is added up once.  Subtrees of at most SUBTREE leaves, and small neighbours
together, are walked level by level as arrays, which bounds memory and keeps the walk fast.  A leaf takes the nearest entry
and adds its part, times its number of vectors, to the entry's sums.

The tries are written once and read by every round; a round moves one row of sums an
entry, dimension and task, and the driver holds the codebooks only.

Rows whose vector is null or not finite go.  Of null or repeated vec_ids, nulls come
last and ties are taken in order of the vectors, when the first codebooks are chosen;
every row has its code.  Fewer than ENTRIES rows give smaller codebooks.  Shorter
vectors are filled with zeros to a width that PARTS divides; entries beyond 2 ** 25 are
held there.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.vectors import matrix, whole_vectors
from keystead.session import stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 1 << 14  # vectors of a trie
SUBTREE = 1 << 12  # leaves that are walked as arrays


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, how often each is there, and where each row went."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ordered = parts[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))[: len(parts)]
    place = np.empty(len(parts), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], np.bincount(place), place


def nearest(leaves: np.ndarray, book: np.ndarray, subtree: int = SUBTREE) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every leaf (distinct, in order) and its squared distance; ties to the lower entry."""
    n, depth_of_leaves = leaves.shape
    best, distance = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    stack = [(0, n, 0, np.zeros(len(book), dtype=np.int64))]
    while stack:
        lo, hi, depth, shared = stack.pop()
        if hi - lo > subtree and depth < depth_of_leaves:
            value = leaves[lo:hi, depth]
            cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), hi - lo]
            begin = cuts[0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - begin <= subtree:
                    continue  # small children next to each other are walked together
                if begin < a:
                    stack.append((lo + begin, lo + a, depth, shared))
                begin = a
                if b - a > subtree:
                    far = int(value[a]) - book[:, depth]
                    stack.append((lo + a, lo + b, depth + 1, shared + far * far))
                    begin = b
            if begin < hi - lo:
                stack.append((lo + begin, hi, depth, shared))
            continue
        node, sums = np.zeros(hi - lo, dtype=np.int64), shared[None, :]
        new = np.zeros(hi - lo, dtype=bool)
        for level in range(depth, depth_of_leaves):
            value = leaves[lo:hi, level]
            new[0] = True
            new[1:] |= value[1:] != value[:-1]
            first = np.flatnonzero(new)
            far = value[first, None] - book[None, :, level]
            sums = sums[node[first]] + far * far
            node = np.cumsum(new) - 1
        at = sums.argmin(axis=1)
        best[lo:hi], distance[lo:hi] = at[node], sums[np.arange(len(at)), at][node]
    return best, distance


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches put together to blocks of `size` rows at least (the last may be smaller)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tries(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """(part, leaves, counts): one trie for every part of every block of vectors."""
    step = width // parts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = matrix(batch.column(0), width)
            for p in range(parts):
                leaves, counts, _ = distinct_parts(x[:, p * step : (p + 1) * step])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p], pa.int32()), "leaves": pa.array([leaves.astype("<i4").tobytes()], pa.binary()),
                    "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                })

    return stage(vectors.select("x").mapInArrow(work, "part int, leaves binary, counts binary"), "tries")


def refined(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the tries."""
    parts, entries, step = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, step + 1), dtype=np.int64), False
        for batch in batches:
            for p, own, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                leaves = np.frombuffer(own, "<i4").astype(np.int64).reshape(-1, step)
                weight = np.frombuffer(number, "<i8")
                best, _ = nearest(leaves, books[p])
                np.add.at(sums[p], best, np.column_stack((leaves * weight[:, None], weight)))
                counts = True
        if counts:
            p, e, d = np.indices(sums.shape)
            yield pa.RecordBatch.from_pydict({"p": p.ravel(), "e": e.ravel(), "d": d.ravel(), "v": sums.ravel()})

    found = forest.mapInArrow(work, "p long, e long, d long, v long").groupBy("p", "e", "d").agg(F.sum("v").alias("v")).toArrow()
    p, e, d, v = (found.column(c).to_numpy() for c in ("p", "e", "d", "v"))  # one row an entry and dimension
    sums = np.zeros((parts, entries, step + 1), dtype=np.int64)
    sums[p, e, d] = v
    used = sums[:, :, step] > 0
    out = books.copy()
    out[used] = sums[:, :, :step][used] // sums[:, :, step][used][:, None]
    return out


def first_books(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest vec_ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # `entries` rows
    x = np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), parts, width // parts)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def codebooks(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Entries by part, entry and position."""
    books = first_books(vectors, width, parts, entries)
    if books.size and rounds:
        forest = tries(vectors, width, parts)
        for _ in range(rounds):
            books = refined(forest, books)
    return books


def encode(vectors: DataFrame, width: int, books: np.ndarray, more: str = "") -> DataFrame:
    """vec_id, the columns that `more` declares, code and error of every row (vec_id, ..., x)."""
    parts, _, step = books.shape
    kind = ", ".join(filter(None, ("vec_id long", more, "code string, error long")))
    names = [c for c in vectors.columns if c != "x"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = matrix(batch.column(len(names)), width)
            code, error = np.empty((len(x), parts), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p in range(parts):
                leaves, _, place = distinct_parts(x[:, p * step : (p + 1) * step])
                best, distance = nearest(leaves, books[p])
                code[:, p] = best[place]
                error += distance[place]
            texts = code.tobytes().hex()
            out = [texts[i : i + 2 * parts] for i in range(0, len(texts), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.string()), pa.array(error)], names=[*names, "code", "error"])

    return vectors.select(*names, "x").mapInArrow(work, kind)


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that a code stands for: the middle of each entry's cell."""
    parts, _, step = books.shape
    centres = (books + 0.5) / scale

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, parts)
            x = np.hstack([centres[p][code[:, p]] for p in range(parts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), parts * step).cast(pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return coded.select("vec_id", "code").mapInArrow(work, "vec_id long, embedding array<double>")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row of (vec_id, embedding, label)."""
    kind = table.schema["label"].dataType.simpleString()
    vectors, width = whole_vectors(table, SCALE, ("label",), PARTS)
    books = codebooks(vectors, width)
    rows = stage(encode(vectors, width, books, f"label {kind}"), "codes")
    by_label = rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("own"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
