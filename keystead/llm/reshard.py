"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities.  A flow from old to new shards that
costs one for each byte that changes its place, and nothing for a byte that stays, is
solved on the few shards; it says how many bytes of each old shard go where.  The rows
of an old shard then lie one after the other, long ones first, and the flow cuts this
line: running sums over bins of rows and inside each bin place every row.

The law is `bytes`: new shards differ by rows that lie across a cut, and cuts fall among
short rows where they can.  Equal texts are no unit here; each row goes by itself.

Nulls: a null text has size one and checksum zero; null doc_ids and old shards are
values like any other.  Repeated rows are placed one by one.  Other columns are
ignored by `assign`; `rewrite` carries them along.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystead.llm.common import shuffle_shards, text_or_empty
from keystead.session import stage

SHARDS = 16
OLD_SHARDS = 24
STEPS = 4  # size classes for each doubling


def min_cost_flow(supplies: list[int], capacities: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Amounts from i to j that send all supplies at the least cost, by successive shortest paths."""
    n, m = len(supplies), len(capacities)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, room, cost, place of the reverse edge

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, amount in enumerate(supplies):
        edge(source, i, amount, 0)
        for j in range(m):
            edge(i, n + j, amount, cost[i][j])
    for j, room in enumerate(capacities):
        edge(n + j, sink, room, 0)
    potential, left = [0] * len(graph), sum(supplies)
    while left:
        far, via = [None] * len(graph), [None] * len(graph)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                to = d + price + potential[a] - potential[b]
                if room and (far[b] is None or to < far[b]):
                    far[b], via[b] = to, (a, k)
                    heapq.heappush(heap, (to, b))
        if far[sink] is None:
            raise ValueError("the new shards can't hold all bytes")
        potential = [p + (f or 0) for p, f in zip(potential, far)]
        path, b = [], sink
        while b != source:
            path.append(via[b])
            b = via[b][0]
        amount = min(left, *(graph[a][k][1] for a, k in path))
        for a, k in path:
            graph[a][k][1] -= amount
            graph[graph[a][k][0]][graph[a][k][3]][1] += amount
        left -= amount
    return {(i, b - n): graph[b][back][1] for i in range(n) for b, _, _, back in graph[i] if n <= b < n + m and graph[b][back][1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def cuts(sizes: dict[int, int], shards: int = SHARDS, capacities: list[int] | None = None) -> dict[int, list[tuple[int, int]]]:
    """For each old shard where its line is cut: (end, new shard), what stays first."""
    old = sorted(sizes)
    room = capacities or equal_capacities(sum(sizes.values()), shards)
    flow = min_cost_flow([sizes[i] for i in old], room, [[int(i != j) for j in range(len(room))] for i in old])
    out = {}
    for k, i in enumerate(old):
        end, parts = 0, []
        for j, amount in sorted(((j, a) for (q, j), a in flow.items() if q == k), key=lambda p: (p[0] != i, -p[1], p[0])):
            end += amount
            parts.append((end, j))
        out[i] = parts
    return out


def by_source(shards: int = OLD_SHARDS, column: str = "source") -> Column:
    """The old layout: all rows of a source in one shard."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % shards, F.lit(0)).cast("int")


def assign(docs: DataFrame, old_shard: Column, shards: int = SHARDS, capacities: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard for every row of (doc_id, text)."""
    size = (F.octet_length(text_or_empty()) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text_or_empty()).alias("crc"), F.coalesce(old_shard, F.lit(-1)).alias("old"), F.monotonically_increasing_id().alias("row"))
    parts = shuffle_shards(docs.sparkSession)
    # long rows first: a bin holds the rows of one class of sizes and one range of hashes
    level = (F.lit(64 * STEPS) - F.floor(F.log2(F.col("size")) * STEPS)).cast("int")
    rows = stage(rows.withColumn("bin", level * F.lit(parts) + F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "rows")
    bins = stage(rows.groupBy("old", "bin").agg(F.sum("size").alias("bytes")), "bins")
    sizes = {r["old"]: r["b"] for r in bins.groupBy("old").agg(F.sum("bytes").alias("b")).collect()}  # a row for each old shard
    lines = cuts(sizes, shards, capacities) if sizes else {}
    known = docs.sparkSession.createDataFrame([(i, [{"end": e, "to": j} for e, j in p]) for i, p in lines.items()], "o int, cuts array<struct<end:long,to:int>>")

    before = Window.partitionBy("old").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(F.col("old").alias("o_old"), F.col("bin").alias("o_bin"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("old", "bin").orderBy("row")
    placed = (
        rows.withColumn("rank", F.row_number().over(inside))
        .withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, (F.col("old") == F.col("o_old")) & (F.col("bin") == F.col("o_bin")))
        .join(F.broadcast(known), F.col("old") == F.col("o"))  # a row for each old shard
        .withColumn("middle", F.col("start") + F.col("run") - F.col("size") / 2)
        .withColumn("shard", F.expr("filter(cuts, c -> middle < c.end)[0].to"))
        .select("doc_id", "size", "crc", "old", "bin", "rank", "shard")
    )
    placed = stage(placed, "placed")
    groups = placed.groupBy("shard", "old", "bin").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("old", "bin").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        F.col("shard").alias("g_shard"), F.col("old").alias("g_old"), F.col("bin").alias("g_bin"),
        (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("least")).alias("shift"),
    )
    same = (F.col("shard") == F.col("g_shard")) & (F.col("old") == F.col("g_old")) & (F.col("bin") == F.col("g_bin"))
    return placed.join(groups, same).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> DataFrame:
    """Write the new shards that gain or lose rows under path, by shard; the others stay as they are.

    `docs` must have unique doc_ids; own columns shard and slot give way.  Returns (shard, n_rows, n_bytes) of what was written.
    """
    stays = F.col("old_shard") == F.col("shard")
    changed = placed.groupBy("shard").agg(F.min(stays).alias("same"), F.sum("size").alias("now"), F.first("shard").alias("s"))
    lost = placed.where(~stays).select(F.col("old_shard").alias("s")).distinct().withColumn("lost", F.lit(True))
    affected = stage(changed.join(lost, "s", "left").where(~F.col("same") | F.col("lost").isNotNull()).select(F.col("s").alias("hit")), "affected")
    where = placed.join(F.broadcast(affected), F.col("shard") == F.col("hit")).select("doc_id", "shard", "slot").toDF("w_id", "w_shard", "w_slot")  # a row a shard
    own = [docs[n] for n in docs.columns if n not in ("shard", "slot")]
    out = docs.join(where, docs["doc_id"] == where["w_id"]).select(*own, where["w_shard"].alias("shard"), where["w_slot"].alias("slot"))
    out.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length(text_or_empty()) + 1).alias("n_bytes"))
