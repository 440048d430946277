"""Toxicity by nearest labelled examples.

Labelled rows outside the held-out fold are the examples.  Words and word beginnings
that tell the labels apart are the terms; their weights come from document counts
over the whole corpus.  The examples form an inverted index cut into blocks, with the
largest weight of each term in each block: a text adds these up to an upper bound for
every block and opens blocks from the largest bound down until no bound can reach its
k nearest.  Cosines are exact.  The votes of the nearest, weighted by cosine, become a
probability by an isotonic fit over the examples, each scored without itself.

Bounds: EXAMPLES labelled rows are drawn by the hash of their doc_id, and TERMS terms
are kept.  Both bound the model, not the rows that it scores.

Nulls: a null or empty text has no terms and gets the score of such examples.  Null
labels and labels of unknown documents are left out; of labels that repeat a doc_id
the largest counts.  Without any example every score is zero.  Rows that repeat a
doc_id are scored one by one.  Other columns are ignored by `scores` and carried
along by `rejected`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import slices, text_chunks, text_or_empty
from keystead.session import stage

EXAMPLES = 20_000  # labelled rows that are learned from
TERMS = 8_192  # terms of the model
SHARPEST = 2.5  # least log odds ratio of a term
SUREST = 4.0  # least z of a term
BEGINNINGS = (4, 5, 6)  # letters of word beginnings that are terms too
BLOCK = 64  # examples of a block
NEAREST = 15
REMEMBERED = 200_000  # words of which a task knows the terms
COUNTED = 100_000  # terms a task counts before it hands the counts on
PART = 10_000  # counts handed on at a time
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
REST = 1.0  # weight of the words that are no terms, taken together as one
PRIOR = 0.25  # weight of a vote for the mean, so that faint likeness stays near it

TOKEN = re.compile(r"[^\W\d_]+")


def fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % FOLDS, F.lit(0))


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists that don't grow with it."""
    for chunk in text_chunks(text):
        yield TOKEN.findall(chunk.lower())


def word_terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Terms:
    """Numbers of the kept terms by word; what is remembered of words is bounded."""

    def __init__(self, names: list[str]):
        self.number = {t: i for i, t in enumerate(names)}
        self.barren: set[str] = set()  # words without terms: nearly all
        self.fruitful: dict[str, list[int]] = {}

    def of_words(self, words: list[str]) -> dict[str, list[int]]:
        """The words that have terms, and these."""
        out = {}
        for word in set(words).difference(self.barren):
            found = self.fruitful.get(word)
            if found is None:
                found = [self.number[t] for t in word_terms(word) if t in self.number]
                if len(self.barren) + len(self.fruitful) > REMEMBERED:
                    self.forget()
                if found:
                    self.fruitful[word] = found
                else:
                    self.barren.add(word)
            if found:
                out[word] = found
        return out

    def forget(self) -> None:
        self.barren.clear()
        self.fruitful.clear()

    def of_text(self, text: str) -> set[int]:
        return {t for words in word_lists(text) for terms in self.of_words(words).values() for t in terms}

    def counts(self, text: str) -> dict[int, int]:
        """Counts of the terms, and of all words under the number after the last term; nothing for a text without terms."""
        out: dict[int, int] = {}
        total = 0
        for words in word_lists(text):
            total += len(words)
            if found := self.of_words(words):
                counts = Counter(words)
                for word, terms in found.items():
                    for term in terms:
                        out[term] = out.get(term, 0) + counts[word]
        if out:
            out[len(self.number)] = total
        return out


class Index:
    """Examples as unit vectors in blocks, with each term's largest weight in each block."""

    def __init__(self, names: list[str], weights: np.ndarray, vectors: list[dict[int, int]], labels: np.ndarray, ids: np.ndarray, nearest: int = NEAREST):
        self.terms, self.weights, self.nearest = Terms(names), np.append(weights, REST), nearest
        kept = [(self.unit(v), int(y), int(i)) for v, y, i in zip(vectors, labels, ids)]
        self.mean = float(np.mean(labels)) if len(labels) else 0.0
        self.n = len(kept)
        filled = [k for k in kept if len(k[0][0])]
        # examples led by the same term share blocks, which keeps the bounds tight
        filled.sort(key=lambda k: (int(k[0][0][np.argmax(k[0][1])]), k[2]))
        self.labels = np.array([k[1] for k in filled], dtype=np.float64)
        self.ids = np.array([k[2] for k in filled], dtype=np.int64)
        self.blocks = []
        best: dict[tuple[int, int], float] = {}
        for b, at in enumerate(range(0, len(filled), BLOCK)):
            part = filled[at : at + BLOCK]
            row = np.repeat(np.arange(len(part)), [len(k[0][0]) for k in part])
            term = np.concatenate([k[0][0] for k in part])
            value = np.concatenate([k[0][1] for k in part])
            order = np.argsort(term, kind="stable")
            self.blocks.append((at, len(part), row[order], term[order], value[order]))
            for t, v in zip(term.tolist(), value.tolist()):
                best[t, b] = max(best.get((t, b), 0.0), v)
        keys = sorted(best)
        self.max_term = np.array([k[0] for k in keys], dtype=np.int64)
        self.max_block = np.array([k[1] for k in keys], dtype=np.int64)
        self.max_value = np.array([best[k] for k in keys])
        self.first = np.searchsorted(self.max_term, np.arange(len(names) + 2))
        self.steps = (np.zeros(1), np.zeros(1))

    def unit(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), dtype=np.int64)
        if not len(terms):
            return terms, np.zeros(0)
        value = np.log1p([counts[t] for t in terms.tolist()]) * self.weights[terms]
        norm = math.sqrt(float(value @ value))
        return (terms, value / norm) if norm > 0 else (terms[:0], value[:0])

    def neighbours(self, query: tuple[np.ndarray, np.ndarray], without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, example) of the nearest, largest first, ties by doc_id; none for a text without terms."""
        terms, values = query
        if not len(terms) or not self.blocks:
            return []
        bound = np.zeros(len(self.blocks))
        dense = np.zeros(len(self.weights))
        dense[terms] = values
        for t, v in zip(terms.tolist(), values.tolist()):
            a, b = self.first[t], self.first[t + 1]
            bound[self.max_block[a:b]] += v * self.max_value[a:b]
        best: list[tuple[float, int, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == self.nearest and bound[b] < -best[-1][0] - 1e-12:
                break
            at, size, row, term, value = self.blocks[b]
            cosine = np.bincount(row, weights=dense[term] * value, minlength=size)
            found = np.flatnonzero(cosine > 0).tolist()
            best = sorted(best + [(-round(float(cosine[i]), 12), int(self.ids[at + i]), at + i) for i in found if at + i != without])[: self.nearest]
        return [(-c, i) for c, _, i in best]

    def vote(self, found: list[tuple[float, int]]) -> float:
        weight = np.array([c for c, _ in found])
        return float((weight @ self.labels[[i for _, i in found]] + PRIOR * self.mean) / (weight.sum() + PRIOR)) if found else -1.0

    def calibrate(self, vectors: list[dict[int, int]], labels: np.ndarray) -> None:
        """Isotonic steps from votes to the share of toxic examples, each example scored without itself."""
        place = {int(i): n for n, i in enumerate(self.ids)}
        votes = np.array([self.vote(self.neighbours(self.unit(v), place.get(int(i)))) for v, i in zip(vectors, self.example_ids)])
        order = np.argsort(votes, kind="stable")
        groups: list[list[float]] = []  # vote, toxic, rows
        for v, y in zip(votes[order].tolist(), np.asarray(labels, dtype=float)[order].tolist()):
            if groups and groups[-1][0] == v:
                groups[-1][1] += y
                groups[-1][2] += 1
            else:
                groups.append([v, y, 1])
        merged: list[list[float]] = []
        for g in groups:
            merged.append([g[0], g[1], g[2], g[0]])
            while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
                last = merged.pop()
                merged[-1] = [merged[-1][0], merged[-1][1] + last[1], merged[-1][2] + last[2], last[3]]
        if merged:
            at = [x for m in merged for x in ((m[0],) if m[0] == m[3] else (m[0], m[3]))]
            to = [m[1] / m[2] for m in merged for _ in ((0,) if m[0] == m[3] else (0, 1))]
            self.steps = (np.array(at), np.array(to))

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        found = self.neighbours(self.unit(self.terms.counts(text)))
        return (float(np.interp(self.vote(found), *self.steps)) if self.n else 0.0), found


def sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(id, toxic, text) of up to `examples` labelled rows outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold("id") != HELD_OUT))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(examples)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
    # the limit above bounds what is broadcast
    return stage(rows.join(F.broadcast(known), F.col("doc") == F.col("id")).select("id", "toxic", "text"), "examples")


def pick_terms(rows: DataFrame, terms: int = TERMS) -> list[str]:
    """Terms that tell toxic examples from the others, the surest first."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            """The counts so far, in parts; the sums come after."""
            for counts, at in ((toxic, 0), (clean, 1)):
                for some in batched(counts.items(), PART):
                    zeros, ns = pa.array([0] * len(some), pa.int64()), pa.array([n for _, n in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in some], pa.string()), *((zeros, ns) if at else (ns, zeros))], names=["term", "a", "b"])
                counts.clear()

        for batch in slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w for words in word_lists(text) for w in words}
                (toxic if label else clean).update({t for w in own for t in word_terms(w)})
                if len(toxic) + len(clean) > COUNTED:
                    yield from counted()
        yield from counted()

    counts = rows.select("toxic", "text").mapInArrow(work, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n_toxic, n_clean = sum(n for y, n in sizes.items() if y), sum(n for y, n in sizes.items() if not y)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    ratio = F.log(a / (n_toxic + 1 - a)) - F.log(b / (n_clean + 1 - b))
    sure = ratio / F.sqrt(1 / a + 1 / b)
    best = counts.where("a >= 3").select("term", ratio.alias("g"), sure.alias("z")).where((F.col("g") >= SHARPEST) & (F.col("z") >= SUREST))
    return [r["term"] for r in best.orderBy(F.desc("z"), "term").limit(terms).collect()]


def document_counts(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term is, over all documents, and how many there are."""
    size = len(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, n = Terms(names), np.zeros(size, dtype=np.int64), 0
        for batch in slices(batches):
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                if own := terms.of_text(text):
                    counts[list(own)] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *used.tolist()], pa.int64()), "n": pa.array([n, *counts[used].tolist()], pa.int64())})

    sums = docs.select(text_or_empty().alias("text")).mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in sums:
        if r["term"] >= 0:
            out[r["term"]] = r["n"]
    return out, next((r["n"] for r in sums if r["term"] < 0), 0)


def build_index(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """The index of the bounded sample; document counts are over all documents."""
    rows = sample(docs, labels, examples)
    names = pick_terms(rows, terms)
    found, total = document_counts(docs, names)
    weights = np.log((1 + total) / (1 + found))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(names)
        for batch in slices(batches):
            own = [known.counts(t) for t in batch.column(2).to_pylist()]
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in own], kinds), pa.array([list(c.values()) for c in own], kinds)], names=["id", "toxic", "terms", "counts"])

    vectors = rows.mapInArrow(work, "id long, toxic int, terms array<long>, counts array<long>").toArrow().sort_by("id")
    bags = [dict(zip(t, c)) for t, c in zip(vectors["terms"].to_pylist(), vectors["counts"].to_pylist())]
    toxic = np.array(vectors["toxic"].to_pylist(), dtype=np.int64)
    index = Index(names, weights, bags, toxic, np.array(vectors["id"].to_pylist(), dtype=np.int64))
    index.example_ids = np.array(vectors["id"].to_pylist(), dtype=np.int64)
    index.calibrate(bags, toxic)
    return index


def scores(docs: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours (doc_id, cosine and label of the nearest examples) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index or build_index(docs, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in slices(batches):
            out, near = [], []
            for text in batch.column(2).to_pylist():
                score, found = index.score(text)
                out.append(score)
                near.append([{"doc_id": int(index.ids[i]), "cosine": c, "toxic": int(index.labels[i])} for c, i in found])
            marks = pa.array([int(s >= THRESHOLD) for s in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), marks, pa.array(near, kind)], names=["doc_id", "held_out", "score", "predicted", "neighbours"])
        index.terms.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int, neighbours array<struct<doc_id:long,cosine:double,toxic:int>>")


def accepted(docs: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(index or build_index(docs, labels))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            keep = [index.score(t or "")[0] < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        index.terms.forget()

    return docs.mapInArrow(work, docs.schema)
