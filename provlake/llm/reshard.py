"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes.

Old shard sizes and new capacities make a small network (source, old shards, new shards, sink)
in which a byte that stays costs nothing and a byte that moves costs one. Its solution says how
many bytes each old shard keeps and sends where; each old shard is then cut into blocks at
those prefix sums, large documents first, so that the cuts fall between small ones. Prefix sums
and slots have two levels (within a bucket, then over bucket totals), so no task holds a shard.
Only shard totals, a row for each shard, reach the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import on_exit, shared_dir, written

#: Rows to a bucket, over all shards; there are 64 buckets and as many as shuffle partitions at least.
_BUCKET = 1 << 20


def min_cost_flow(sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of the cheapest flow that places all `sizes` within `capacities`.

    Shard i stays in place where old and new share its number. Successive shortest paths.
    """
    n, m = len(sizes), len(capacities)
    if sum(capacities) < sum(sizes):
        raise ValueError("the capacities do not hold the shards")
    flow = [[0] * m for _ in range(n)]
    left, room = list(sizes), list(capacities)
    cost = lambda i, j: int(i != j)
    while any(left):
        # Bellman-Ford from all old shards with bytes left, over the residual network
        dist = [0 if x else None for x in left] + [None] * m
        back: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost(i, j) < dist[n + j]):
                        dist[n + j], back[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow[i][j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost(i, j) < dist[i]):
                        dist[i], back[i], changed = dist[n + j] - cost(i, j), n + j, True
            if not changed:
                break
        end = min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j], j))
        path = [n + end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        most = min([left[path[0]], room[end], *(flow[b][a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[path[0]] -= most
        room[end] -= most
    return [(i, j, flow[i][j]) for i in range(n) for j in range(m) if flow[i][j]]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def place(docs: DataFrame, old: Column, n_old: int, n_new: int, capacities: list[int] | None = None, buckets: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(row, doc_id, size, text_crc32, old_shard, shard, slot) for each row of `docs`, and the transfers.

    row is the row's number in `docs`, which has to give the same partitions each time, as files do.
    size is the UTF-8 bytes of the text, none if null, plus 8; `old` is the shard, 0 to
    n_old - 1, where a row lies. Default capacities are equal. Slots count from 0 in each new
    shard without gaps. Ties and repeated rows are ordered arbitrarily but get slots of their
    own; null ids are ids like any other; an empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), old.cast("int").alias("old_shard"))
    rows = written(rows.withColumn("class", -F.floor(F.log2("size")).cast("int")), "sized")
    if buckets is None:
        buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _BUCKET))
    # the row's number is hashed too, so that rows alike in id and text are dealt like any others
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(buckets)).cast("int"))

    parts = rows.groupBy("old_shard", "class", "bucket").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("old_shard").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    totals = {r.old_shard: r.bytes for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    sizes = [totals.get(i, 0) for i in range(n_old)]
    moves = min_cost_flow(sizes, capacities or equal_capacities(sum(sizes), n_new))

    cuts, at = [], [0] * n_old
    for i, j, size in sorted(moves, key=lambda x: (x[0], x[0] != x[1], x[1])):  # what stays comes first
        cuts.append((i, 2 * at[i], 2 * (at[i] + size), j))
        at[i] += size
    plan = docs.sparkSession.createDataFrame(cuts, "old_shard int, low long, high long, shard int")

    inside = Window.partitionBy("old_shard", "class", "bucket").orderBy(F.desc("size"), "doc_id", "text_crc32", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("prefix", F.sum("size").over(inside)).join(parts.drop("bytes"), ["old_shard", "class", "bucket"])
    middle = 2 * (F.col("base") + F.col("prefix")) - F.col("size")
    placed = placed.withColumn("middle", middle).join(F.broadcast(plan), "old_shard").where("low <= middle and middle < high")
    placed = written(placed.select("row", "doc_id", "size", "text_crc32", "old_shard", "shard", "bucket"), "placed")

    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")
    out = placed.withColumn("i", F.row_number().over(inside) - 1).join(counts, ["shard", "bucket"])
    return out.select("row", "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("i")).cast("long").alias("slot")), moves


def rewrite(docs: DataFrame, placed: DataFrame, moves: list[tuple[int, int, int]], path: str) -> list[int]:
    """Write the shards that gained or lost bytes to `path`/shard=N, (slot, row: all columns as one struct), by slot within files; returns them.

    Rows meet their places by their numbers, held against id, checksum and size, so repeated rows,
    null ids and any other columns are written once each. A table that changed since it was placed raises.
    """
    touched = sorted({s for i, j, _ in moves if i != j for s in (i, j)} & {j for _, j, _ in moves})
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"), F.col("doc_id").alias("id"), F.crc32(raw).alias("crc"), (F.octet_length(raw) + 8).alias("of"))
    there = placed.where(F.col("shard").isin(touched)).withColumnRenamed("row", "number")
    both = keyed.join(there, (keyed["at"] == there.number) & keyed.id.eqNullSafe(there.doc_id) & (keyed.crc == there.text_crc32) & (keyed.of == there["size"]))
    both.select("row", "slot", "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    found = docs.sparkSession.read.parquet(path).count() if touched else 0
    if found != there.count():
        raise RuntimeError("the documents changed between two reads")
    return touched


def query(docs: DataFrame) -> DataFrame:
    """16 shards by a hash of the id become 24 of near-equal bytes; the result is read from the files of the shards that changed."""
    spark = docs.sparkSession
    placed, moves = place(docs, F.pmod(F.xxhash64("doc_id"), F.lit(16)), 16, 24)
    placed = written(placed, "slots")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    touched = rewrite(docs, placed, moves, path)
    raw = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    out = placed.where(~F.col("shard").isin(touched)).select("doc_id", "size", "text_crc32", "shard", "slot")
    if touched:
        kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
        files = spark.read.schema(f"row {kind}, slot long, shard int").parquet(path)
        out = out.union(files.select("row.doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "shard", "slot"))
        on_exit(spark, path)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
