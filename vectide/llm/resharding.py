"""Resharding by minimum-cost flow: even shards with the fewest bytes moved.

Documents lie in shards by the hash of their text. A shard is a fixed number of
blocks; sizes and counts are summed per block, so what the driver sees is
some ``shards * blocks`` rows whatever the table holds. From the old sizes and the
new capacities a transportation problem gives the bytes each shard sends to
each other, cheaper inside a rack; blocks that come closest to those amounts then
move whole. What whole blocks leave uneven is mended by single moves and swaps of
blocks, until none brings shards closer.

Groups, equal texts, stay in one shard, but for those larger than a quarter of a
shard: these are cut into parts of like size, as the law of even bytes goes
first and such a group may hold a third of all rows. A null text has no bytes.
Rows without a doc_id, or with a shared one, are placed by their text like
others. Very long texts are never cut: sizes then differ by one text at most. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.llm.common import materialise


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The cheapest shipments from supplies to demands, by successive shortest paths.

    cost: per byte, for each source and target. What exceeds the total demand stays unsent.
    """
    n, m = len(supply), len(demand)
    left, want = list(supply), list(demand)
    flow = [[0] * m for _ in range(n)]
    pot_s, pot_t = [0] * n, [0] * m
    while True:
        best_s = [0 if left[i] > 0 else None for i in range(n)]
        best_t: list[int | None] = [None] * m
        back_t: list[int | None] = [None] * m
        back_s: list[int | None] = [None] * n
        heap = [(0, 0, i) for i in range(n) if left[i] > 0]
        heapq.heapify(heap)
        end = None
        while heap:
            d, side, v = heapq.heappop(heap)
            if side == 0:
                if d > best_s[v]:
                    continue
                for j in range(m):
                    e = d + cost[v][j] + pot_s[v] - pot_t[j]
                    if best_t[j] is None or e < best_t[j]:
                        best_t[j], back_t[j] = e, v
                        heapq.heappush(heap, (e, 1, j))
            else:
                if d > best_t[v]:
                    continue
                if want[v] > 0 and end is None:
                    end = v
                for i in range(n):
                    if flow[i][v]:
                        e = d - cost[i][v] - pot_s[i] + pot_t[v]
                        if best_s[i] is None or e < best_s[i]:
                            best_s[i], back_s[i] = e, v
                            heapq.heappush(heap, (e, 0, i))
        if end is None:
            return flow
        far = best_t[end]
        for i in range(n):
            if best_s[i] is not None:
                pot_s[i] += min(best_s[i], far)
            else:
                pot_s[i] += far
        for j in range(m):
            pot_t[j] += min(best_t[j], far) if best_t[j] is not None else far
        path, j = [], end
        while True:
            i = back_t[j]
            path.append((i, j, 1))
            if back_s[i] is None:
                break
            path.append((i, back_s[i], -1))
            j = back_s[i]
        amount = min([want[end], left[i], *(flow[a][b] for a, b, s in path if s < 0)])
        for a, b, s in path:
            flow[a][b] += s * amount
        left[i] -= amount
        want[end] -= amount


#: Shards whose sizes differ by this share of the mean count as even.
EVEN = 0.001


def plan_moves(sizes: dict[int, int], shards: int, capacity: list[int] | None = None, cost: list[list[int]] | None = None) -> dict[int, int]:
    """Block to its new shard. A block ``b`` lies in shard ``b % shards`` now.

    cost: of a byte from each shard to each; moves cost the same if not given.
    Blocks are taken largest first into what is still to be sent, so the rest
    of each shipment is below the smallest block's size.
    """
    old = [0] * shards
    for b, s in sizes.items():
        old[b % shards] += s
    total = sum(old)
    if not capacity:  # what does not divide stays where most is
        fullest = sorted(range(shards), key=lambda i: -old[i])[: total % shards]
        capacity = [total // shards + (i in fullest) for i in range(shards)]
    over = [max(0, o - c) for o, c in zip(old, capacity)]
    under = [max(0, c - o) for o, c in zip(old, capacity)]
    flow = min_cost_flow(over, under, cost or [[1] * shards for _ in range(shards)])
    now = {b: b % shards for b in sizes}
    for i in range(shards):
        blocks = sorted((b for b in sizes if b % shards == i), key=lambda b: (-sizes[b], b))
        for j in sorted(range(shards), key=lambda j: -flow[i][j]):
            rest = flow[i][j]
            for b in blocks:
                if now[b] == i and 0 < sizes[b] <= rest:
                    now[b], rest = j, rest - sizes[b]
    return even_out(now, sizes, capacity)


def even_out(now: dict[int, int], sizes: dict[int, int], capacity: list[int]) -> dict[int, int]:
    """Moves and swaps of single blocks between the fullest shard and others, or the emptiest and others, while one helps."""
    shards = len(capacity)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for b, s in sizes.items():
        if s:
            held[now[b]].append((s, b))
    for blocks in held:
        blocks.sort()
    excess = [sum(s for s, _ in blocks) - c for blocks, c in zip(held, capacity)]
    close = EVEN * sum(capacity) / shards
    while max(excess) - min(excess) > close:
        order = sorted(range(shards), key=lambda i: excess[i])
        low, high = order[0], order[-1]
        for i, j in [(high, j) for j in order[:-1]] + [(i, low) for i in reversed(order[1:-1])]:
            if (found := _exchange(held[i], held[j], excess[i] - excess[j])) is not None:
                break
        else:
            break
        for a, (source, target) in zip(found, ((i, j), (j, i))):
            if a is not None:
                held[source].remove(a)
                insort(held[target], a)
                now[a[1]] = target
                excess[source] -= a[0]
                excess[target] += a[0]
    return now


def _exchange(more: list[tuple[int, int]], less: list[tuple[int, int]], gap: int) -> tuple | None:
    """The block of ``more``, and perhaps one of ``less`` in return, whose exchange brings a gap closest to none."""
    best, found = gap, None
    for a in more:
        # what should come back for this block
        k = bisect_left(less, (a[0] - gap / 2, -1))
        for back in (None, *less[max(0, k - 1) : k + 1]):
            left = abs(gap - 2 * (a[0] - (back[0] if back else 0)))
            if left < best:
                best, found = left, (a, back)
    return found


#: Texts of more than this share of a shard are no longer kept whole.
WHOLE = 4
#: Rows are numbered in parts of about this share of a shard.
PARTS = 64
RACK = 4


def rack_cost(shards: int, rack: int = RACK) -> list[list[int]]:
    """What a byte costs from each shard to each: 1 inside a rack of neighbouring shards, 2 beyond it."""
    return [[1 if i // rack == j // rack else 2 for j in range(shards)] for i in range(shards)]


def _sums(rows: DataFrame, *by: str) -> list:
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()


def _units(thin: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Append ``unit``, what is placed as a whole: a block of texts, or a part of a text too large for that; and ``part``, in which its rows are numbered."""
    sums = _sums(thin, "block")
    total = sum(r.bytes for r in sums)
    whole, share = max(1, total // (WHOLE * shards)), max(1, total // (PARTS * shards))
    crowded = [r.block for r in sums if r.bytes > whole]  # WHOLE * shards at most
    big, start = [], shards * blocks
    for r in sorted(_sums(thin.where(F.col("block").isin(crowded)), "hash"), key=lambda r: r["hash"]) if crowded else []:
        if r.bytes > whole and r.n > 1:
            big.append((r["hash"], start, -(-r.bytes // share)))
            start += big[-1][2]
    cut = thin.sparkSession.createDataFrame(big, "hash long, start int, cut int")
    dealt = F.pmod(F.xxhash64("row"), F.col("cut")).cast("int")
    placed = thin.join(F.broadcast(cut), "hash", "left").withColumn("unit", F.coalesce(F.col("start") + dealt, "block")).drop("start", "cut")
    # a block with much in it is placed as one, but numbered in parts
    large = thin.sparkSession.createDataFrame([(r.block, -(-r.bytes // share)) for r in sums if r.bytes > share], "unit int, parts int")
    part = F.coalesce(F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")), F.lit(0)).cast("int")
    return placed.join(F.broadcast(large), "unit", "left").withColumn("part", part).drop("parts")


def reshard(docs: DataFrame, shards: int = 16, blocks: int = 1024, cost: list[list[int]] | None = None) -> DataFrame:
    """Each document's shard and slot under the law ``bytes``: sizes near equal.

    Returns doc_id, size, text_crc32, law, old_shard, shard, slot and
    grown_shard (null under this law). slot counts 0, 1, ... in each shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.xxhash64(F.lit("block"), text)
    columns = ["doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"), digest.alias("hash")]
    block = F.pmod("hash", F.lit(shards * blocks)).cast("int")
    # written, so that a row keeps its number
    thin = materialise(docs.select(*columns).select("*", block.alias("block"), F.monotonically_increasing_id().alias("row")))
    rows = _units(thin, shards, blocks)
    counts, sizes = {}, Counter()
    for r in _sums(rows, "unit", "part"):
        counts[r.unit, r.part] = r.n
        sizes[r.unit] += r.bytes
    now = plan_moves(dict(sizes), shards, cost=cost or rack_cost(shards))
    plan, filled = [], [0] * shards
    for unit, part in sorted(counts):
        plan.append((unit, part, now[unit], filled[now[unit]]))
        filled[now[unit]] += counts[unit, part]
    placed = docs.sparkSession.createDataFrame(plan, "unit int, part int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("unit", "part").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return rows.withColumn("rank", rank).join(F.broadcast(placed), ["unit", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.pmod("unit", F.lit(shards)).cast("int").alias("old_shard"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def laid_out(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The documents with their shard and slot; equal rows may take each other's places."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = ["__id", "__size", "__crc"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))).alias("__nth")
    rows = docs.drop("shard", "slot").withColumns({"__id": F.struct(F.col("doc_id").alias("id")), "__size": F.octet_length(text) + F.lit(1), "__crc": F.crc32(F.encode(text, "UTF-8"))})
    places = placed.select(F.struct(F.col("doc_id").alias("id")).alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "slot")
    on = [*same, "__nth"]
    return rows.withColumn("__nth", nth).join(places.withColumn("__nth", nth), on).drop(*on)


def rewrite(docs: DataFrame, placed: DataFrame, path: str, changed_only: bool = True) -> list[int]:
    """Write the documents of the shards whose content changes, a folder ``shard=N`` each, below ``path``.

    Shards that neither send nor receive keep their files. A shard is written
    by several tasks, each a range of its slots. docs may be read from ``path``
    itself. Returns the shards that were written.
    """
    moves = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()
    touched = sorted(r.s for r in moves) if changed_only else sorted(r.shard for r in placed.select("shard").distinct().collect())
    if touched:
        mine = laid_out(docs, placed.where(F.col("shard").isin(touched)))
        ordered = mine.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return touched
