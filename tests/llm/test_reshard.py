import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from keystead.llm import reshard


def check(rows, out, shards):
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(shards):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["shard"] for r in out} <= set(range(shards)) and {r["law"] for r in out} <= {"bytes"} and all(r["grown_shard"] is None for r in out)


def sizes(out, shards):
    return [sum(r["size"] for r in out if r["shard"] == s) for s in range(shards)]


def test_given_documents(spark, documents, texts):
    out = reshard.assign(documents, reshard.by_source()).collect()
    check(list(texts.items()), out, 16)
    own = sizes(out, 16)
    assert max(own) - min(own) <= 2 * max(r["size"] for r in out)


def test_sizes_are_near_equal_and_few_bytes_move(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = reshard.assign(docs, reshard.by_source()).collect()
    own = sizes(out, 16)
    assert max(own) < 1.01 * min(own)
    moved = sum(r["size"] for r in out if r["shard"] != r["old_shard"])
    old = {}
    for r in out:
        old[r["old_shard"]] = old.get(r["old_shard"], 0) + r["size"]
    least = sum(max(0, b - (sum(own) / 16 if i < 16 else 0)) for i, b in old.items())
    assert moved <= 1.01 * least


def test_odd_rows(docs_of):
    rows = [(i, "x" * (i % 37)) for i in range(500)] + [(None, None), (None, None), (3, ""), (3, ""), (700, "é" * 30_000)]
    out = reshard.assign(docs_of(rows), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int"), 4).collect()
    check(rows, out, 4)
    out = reshard.assign(docs_of(rows), F.lit(None).cast("int"), 5).collect()
    check(rows, out, 5)
    assert reshard.assign(docs_of([]), F.lit(0), 4).count() == 0


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supplies = [rng.randint(0, 4) for _ in range(n)]
        total = sum(supplies)
        room = [rng.randint(0, 6) for _ in range(m - 1)]
        room.append(max(0, total - sum(room)) + rng.randint(0, 2))
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supplies, room, cost)
        assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(n)] == supplies
        assert all(sum(a for (_, j), a in flow.items() if j == k) <= room[k] for k in range(m))
        units = [i for i, s in enumerate(supplies) for _ in range(s)]
        if len(units) <= 6:
            best = min((sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= room[j] for j in range(m))), default=0)
            assert sum(cost[i][j] * a for (i, j), a in flow.items()) == best
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4], [[0]])


def test_rewrite_touches_what_changes(docs_of, tmp_path):
    rows = [(i, "x" * 99) for i in range(400)]
    docs = docs_of(rows)
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 200, 1).otherwise(2)
    placed = reshard.assign(docs, old, 4)
    written = {r["shard"]: r["n_rows"] for r in reshard.rewrite(docs, placed, str(tmp_path / "out")).collect()}
    assert written == {2: 100, 3: 100}  # shards 0 and 1 have their share already
