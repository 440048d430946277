import hashlib
import re

import numpy as np
import pytest

from keystead.llm import exact_dedup
from keystead.llm.exact_dedup import CountingFilter


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((m[3], keep[3], len(members), m == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def values(df):
    return [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


CASES = [(5, "a b"), (3, "ab"), (4, "a\tb"), (9, "a  b "), (1, None), (2, ""), (7, " \n"), (8, "é ü"), (10, "éü"), (11, "single"), (12, "x\xa0y"), (13, "xy"), (None, "nulls"), (14, "null s"), (15, "long " * 50_000), (16, "long" * 50_000)]


def test_against_brute_force(docs_of):
    assert sorted_rows(values(exact_dedup.duplicate_rows(docs_of(CASES)))) == sorted_rows(expected(CASES))


def test_all_documents(documents, texts):
    assert sorted_rows(values(exact_dedup.duplicate_rows(documents))) == sorted_rows(expected(texts.items()))


def test_repeated_rows_keep_one(docs_of):
    rows = [(1, "a"), (1, "a"), (2, "a")]
    out = values(exact_dedup.duplicate_rows(docs_of(rows)))
    assert [r[1:3] for r in out] == [(1, 3)] * 3 and sum(r[3] for r in out) == 1
    assert exact_dedup.distinct_rows(docs_of(rows)).count() == 1


def test_null_id_stays_only_alone(docs_of):
    out = {r[0]: r for r in values(exact_dedup.duplicate_rows(docs_of([(None, "b"), (4, "b"), (None, "c")])))}
    assert out[4][1:4] == (4, 2, True)


def test_distinct_rows_keep_all_columns(docs_of):
    df = docs_of(CASES)
    out = exact_dedup.distinct_rows(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(i, dict(CASES)[i]) for i, _, _, kept, _ in expected(CASES) if kept}


def test_empty_table(docs_of):
    assert exact_dedup.duplicate_rows(docs_of([])).count() == 0
    assert exact_dedup.distinct_rows(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_filter_round_trip_and_merge(n):
    rng = np.random.RandomState(n)
    fps = rng.randint(0, 2**63, max(1, n // 2), dtype=np.int64).astype(np.uint64) * np.uint64(2)
    fps = np.concatenate([fps, fps[: n - len(fps)]])[:n] if n else fps[:0]
    parts = [CountingFilter.of(p) for p in np.array_split(fps, 3)]
    whole = CountingFilter.merged([CountingFilter.from_bytes(p.to_bytes()) for p in parts])
    keys, counts = np.unique(fps, return_counts=True)
    assert whole.fingerprints().tolist() == keys.tolist() and whole.counts.tolist() == counts.tolist()
    blocks = [b for _, b in whole.split(8)]
    assert sum(len(b.counts) for b in blocks) == len(keys)


def test_filters_count_every_fingerprint(spark):
    df = spark.range(0, 3000).selectExpr("xxhash64(id % 1000) as fp")
    found = exact_dedup.repeated_fingerprints(exact_dedup.merge_filters(exact_dedup.partition_filters(df)))
    assert found.count() == 1000 and {r["n"] for r in found.collect()} == {3}
