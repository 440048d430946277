import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from keystead.llm import codes
from keystead.llm.vectors import whole_vectors

KIND = "vec_id long, embedding array<float>, label int, part string, code int, own long, p int"


@pytest.fixture(scope="module")
def vectors_of(spark):
    """A table of vectors with columns that clash."""
    return lambda rows: spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], KIND)


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in plain loops over whole numbers: sorted rows without the label."""
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], label) for i, v, label in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(kept[0][1]) // parts
    cut = [[r[1][p * step : (p + 1) * step] for p in range(parts)] for r in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    errors, total = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for r, e in zip(kept, errors):
        total[r[2]] += e
    return sorted((str(r[0]), "".join(f"{e:02x}" for _, e in f), err, total[r[2]], sha) for r, f, err in zip(kept, found, errors))


def result(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_given_table_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150)
    assert result(codes.compressed(table)) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])


def test_copies_ties_nulls_and_bad_rows(vectors_of):
    rng = np.random.default_rng(5)
    pool = [np.round(rng.normal(size=16), 1).astype(np.float32).tolist() for _ in range(30)]
    rows = [(i, pool[int(k)], [None, 1, 2][i % 3]) for i, k in enumerate(rng.integers(0, 30, 200))]
    rows += [(1000 + i, pool[0], 7) for i in range(150)] + [(None, pool[1], None), (None, pool[2], 1), (3, pool[4], 1)]
    bad = [(2000, None, 1), (2001, [None] + pool[0][1:], 1), (2002, [math.nan] * 16, 1), (2003, [math.inf] * 16, 1)]
    assert result(codes.compressed(vectors_of(rows + bad).repartition(5))) == brute(rows)


def test_few_rows_empty_tables_and_odd_widths(vectors_of):
    rows = [(5, [0.5] * 8, 1), (2, [0.25] * 8, None)]
    assert result(codes.compressed(vectors_of(rows))) == brute(rows)
    assert codes.compressed(vectors_of([])).count() == 0
    assert codes.compressed(vectors_of([(1, None, 1)])).count() == 0
    odd = codes.compressed(vectors_of([(1, [1.0, 2.0, 3.0], 1), (2, [1.0], 1)])).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in odd) == [(1, "0000000000000000", 0), (2, "0001010000000000", 0)]
    assert codes.compressed(vectors_of([(1, [], 1)])).count() == 1
    assert codes.compressed(vectors_of([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])).count() == 2


def test_walk_equals_plain_search():
    rng = random.Random(6)
    for subtree in (1, 3, 50, 4096):
        parts = np.array([[rng.randint(-3, 3) for _ in range(5)] for _ in range(400)], dtype=np.int64)
        book = np.array([[rng.randint(-3, 3) for _ in range(5)] for _ in range(16)], dtype=np.int64)
        leaves, counts, place = codes.distinct_parts(parts)
        assert counts.sum() == 400 and (leaves[place] == parts).all() and len(np.unique(parts, axis=0)) == len(leaves)
        best, distance = codes.nearest(leaves, book, subtree)
        plain = ((leaves[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_decoded_vectors_are_near(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors, width = whole_vectors(table, codes.SCALE, (), codes.PARTS)
    books = codes.codebooks(vectors, width)
    coded = codes.encode(vectors, width, books)
    back = {r["vec_id"]: np.array(r["embedding"]) for r in codes.decode(coded, books).collect()}
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    for r in table.collect():
        off = ((np.array(r["embedding"]) - back[r["vec_id"]]) ** 2).sum()
        assert abs(off - errors[r["vec_id"]] / codes.SCALE**2) < 0.05


def test_parts_move_only_as_sums(spark, sf_dir):
    vectors, width = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), codes.SCALE, (), codes.PARTS)
    forest = codes.tries(vectors, width)
    assert forest.agg({"counts": "count"}).first()[0] == codes.PARTS  # one block
    assert "Exchange" not in codes.encode(vectors, width, codes.first_books(vectors, width))._jdf.queryExecution().executedPlan().toString()
