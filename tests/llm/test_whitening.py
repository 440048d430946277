import math

import numpy as np
import pytest

from keystead.llm import whitening
from keystead.llm.vectors import whole_vectors

KIND = "vec_id long, embedding array<float>, label int, n long, x string, component int, mean double"


@pytest.fixture(scope="module")
def vectors_of(spark):
    """A table of vectors with columns that clash."""
    return lambda rows: spark.createDataFrame([(i, v, 1, 2, "x", 3, 0.5) for i, v in rows], KIND)


def brute(rows):
    """The contract by one dense eigendecomposition: n, sums, directions, variances, trace."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in rows])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    values, vectors = np.linalg.eigh(cov)
    return x, len(fit), fit.sum(axis=0), vectors[:, ::-1], values[::-1], np.trace(cov)


def check(result, rows, components=4):
    x, n, sums, directions, values, trace = brute([v for _, v in rows])
    found = {}
    for r in result.collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(found) == sorted(i for i, _ in rows)
    mean = x.astype(float) - sums / n
    for c in range(1, components + 1):
        want = mean @ directions[:, c - 1] / math.sqrt(values[c - 1])
        got = np.array([found[i][c]["whitened"] for i, _ in rows])
        sign = np.sign(want @ got)
        assert np.allclose(sign * got, want, rtol=1e-8, atol=1e-9)
    for at, (i, _) in enumerate(rows):
        assert set(found[i]) == set(range(1, components + 1))
        r = found[i][1]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums))
        assert abs(r["explained"] - values[0] / trace) < 1e-9 and r["identity_error"] < 1e-8


def test_given_table_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(whitening.whiten(table), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_copies_count_once_and_bad_rows_go(spark, vectors_of):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(300)]  # one vector is most of the table
    bad = [(900, None), (901, [None] + rows[1][1][1:]), (902, [math.nan] * 6), (903, [math.inf] * 6)]
    check(whitening.whiten(vectors_of(rows + bad).repartition(7)), rows)


def test_badly_conditioned_and_dependent_entries(vectors_of):
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(200, 5)) * [3000, 40, 1, 0.5, 0.03]
    check(whitening.whiten(vectors_of(list(enumerate(wide.astype(np.float32).tolist())))), list(enumerate(wide.astype(np.float32).tolist())))
    twice = np.hstack((np.floor(wide[:, :4] * 256) / 256, np.floor(wide[:, :4] * 256) / 256, np.ones((200, 2))))
    check(whitening.whiten(vectors_of(list(enumerate(twice.tolist())))), list(enumerate(twice.tolist())))


def test_few_dimensions_give_few_components(vectors_of):
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(5)]
    check(whitening.whiten(vectors_of(line)), line, components=1)
    assert whitening.whiten(vectors_of([(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(vectors_of([])).count() == 0
    assert whitening.whiten(vectors_of([(1, None), (2, [])])).count() == 0


def test_null_ids_short_vectors_and_large_entries(vectors_of):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 1.0]), (5, [2.0]), (5, [2.0, 0.0]), (6, [1e30, -1e30])]
    out = whitening.whiten(vectors_of(rows)).collect()
    assert len(out) == 10 and {r["n"] for r in out} == {4}
    assert [r["deviation"] for r in out if r["vec_id"] == 5 and r["component"] == 1][0] == [r["deviation"] for r in out if r["vec_id"] == 5 and r["component"] == 1][1]


def test_deviations_beyond_a_long():
    x = np.array([[1 << 20, -5]], dtype=np.int64)
    assert whitening.deviations(x, 7, [3, 4]) == [(7 * (1 << 20) - 3) ** 2 + (-35 - 4) ** 2]
    assert whitening.deviations(x, 1 << 40, [3, 4]) == [None]
    assert whitening.deviations(np.array([[1, 1]]), 1 << 30, [1 << 31, 0]) == [1 << 61]  # by whole numbers of any size


def test_passes_reach_the_identity_on_bad_condition(spark, vectors_of):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(500, 8)) * np.logspace(3, -1.5, 8)).astype(np.float32).tolist())]
    vectors, width = whole_vectors(vectors_of(rows), 256)
    model = whitening.whitening(vectors, width)
    assert 3 <= model.passes < whitening.PASSES and model.identity_error < 1e-9
    assert np.allclose(model.directions.T @ model.directions, np.eye(4), atol=1e-12)


def test_solved_is_the_inverse():
    rng = np.random.default_rng(4)
    factor = np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = rng.normal(size=(9, 6))
    assert np.allclose(whitening.solved(rows, factor) @ factor, rows)
