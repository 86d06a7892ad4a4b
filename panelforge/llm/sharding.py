"""Shards of near-equal bytes for groups that stay whole, by Karmarkar-Karp differencing.

A partial partition is k sums, largest first. Two are combined by adding the one's largest sum to the other's smallest
and so on, and the two with the largest spread (largest less smallest sum) are combined first. Groups are dealt to
buckets of bounded size; each is differenced in a task of its own, then buckets are differenced by their sums alone, level
by level, until one partial partition is left. Going back down the levels, each bucket's bins get their shards.

A group is all rows with equal texts and stays in one shard; null texts are a group. A group of more bytes than a shard's
part has a shard for itself, which is larger than the others. An empty table gives an empty result. Slots number the rows of a shard by
bucket of doc_id, doc_id, size and CRC; rows equal in all of these, such as many without a doc_id, are counted before they
are sent and numbered in pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, written

#: Groups in a bucket, and buckets combined in one task or on the driver.
BUCKET, FAN = 20_000, 512
#: Equal rows that one piece of a run numbers.
RUN = 10_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (n rows of k sums) into one: its sums, largest first, and the bin of every sum."""
    n, k = sums.shape
    first = np.argsort(-sums, axis=1, kind="stable")
    nodes: list[np.ndarray] = list(np.take_along_axis(sums, first, axis=1))
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(x[-1] - x[0]), i) for i, x in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = nodes[a] + nodes[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        nodes[a] = nodes[b] = None
        made.append((a, b, order))
        nodes.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(nodes) - 1))
    bins: list[np.ndarray | None] = [None] * len(nodes)
    bins[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        to = np.empty(k, np.int64)
        to[order] = bins[n + i]
        bins[a], bins[b], bins[n + i] = to, to[::-1], None
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, first, np.stack(bins[:n]), axis=1)
    return nodes[-1], out


def difference_items(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for single sizes: the sums, and the bin of each size."""
    made: list[tuple[int, int, np.ndarray | None]] = []
    zero = np.zeros(k, np.int64)
    nodes: list = [int(s) for s in sizes]
    heap = [(-s, i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    n = len(nodes)

    def sums(i: int) -> np.ndarray:
        if isinstance(nodes[i], int):
            own = zero.copy()
            own[0] = nodes[i]
            return own
        return nodes[i]

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums(a) + sums(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        nodes[a] = nodes[b] = None
        made.append((a, b, order.astype(np.int16)))
        nodes.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(nodes) - 1))
    last = sums(len(nodes) - 1)
    out, bins = np.zeros(n, np.int64), {len(nodes) - 1: np.arange(k)}
    if n == 1:
        return last, out
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        to = np.empty(k, np.int64)
        to[order] = bins.pop(n + i)
        for child, own in ((a, to), (b, to[::-1])):
            if child < n:
                out[child] = own[0]
            else:
                bins[child] = own
    return last, out


def group_shards(groups: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """A shard for each row of groups (keys, size); the result is a written table of keys and shard."""
    spark = groups.sparkSession
    groups = written(groups.select(*keys, "size"), "groups")
    key_types = ", ".join(f"{k} {t}" for k, t in groups.dtypes if k in keys)
    count, left = groups.agg(F.count("*"), F.sum("size")).first()
    # fewer than `shards` groups can be as large as a shard's part of what smaller ones leave; each gets a shard for itself
    alone = []
    for row in groups.orderBy(F.desc("size"), *keys).limit(shards - 1).collect():
        if row["size"] * (shards - len(alone)) < left:
            break
        alone.append((*(row[k] for k in keys), shards - 1 - len(alone)))
        left -= row["size"]
    by_itself = spark.createDataFrame(alone, f"{key_types}, shard int")
    groups, shards = groups.join(F.broadcast(by_itself), keys, "left_anti"), shards - len(alone)
    buckets = max(1, -(-count // BUCKET))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, bins = difference_items(pdf["size"].to_numpy(np.int64), shards)
        rows = pdf[["node", *keys]].assign(bin=bins, sums=None)
        return pd.concat([rows, pd.DataFrame({"node": pdf["node"][:1], **{k: pdf[k][:1] for k in keys}, "bin": -1, "sums": [sums.tolist()]})])

    level = written(groups.withColumn("node", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("node").applyInPandas(first, f"node long, {key_types}, bin int, sums array<long>"), "bins")
    placed, nodes, ups = level.where("bin >= 0").drop("sums"), level.where("bin = -1").select("node", "sums"), []

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, bins = difference(np.array(pdf["sums"].tolist(), np.int64))
        up = pdf["node"].iloc[0] // FAN
        rows = pd.DataFrame({"node": pdf["node"], "up": up, "bins": bins.tolist(), "sums": None})
        return pd.concat([rows, pd.DataFrame({"node": [-1], "up": [up], "bins": [None], "sums": [sums.tolist()]})])

    while buckets > FAN:
        step = written(nodes.groupBy(F.expr(f"node div {FAN}")).applyInPandas(again, "node long, up long, bins array<long>, sums array<long>"), "bins")
        ups.append(step.where("node >= 0").select("node", "up", "bins"))
        nodes, buckets = step.where("node = -1").select(F.col("up").alias("node"), "sums"), -(-buckets // FAN)
    top = nodes.orderBy("node").limit(FAN).collect()  # FAN rows of `shards` numbers at most, by the loop above
    bins = difference(np.array([r["sums"] for r in top], np.int64))[1] if top else np.zeros((0, shards), np.int64)
    to_shard = spark.createDataFrame([(r["node"], b) for r, b in zip(top, bins.tolist(), strict=True)], "node long, shards array<long>")
    for up in reversed(ups):
        to_shard = up.join(to_shard.withColumnRenamed("node", "up"), "up").select("node", F.transform("bins", lambda b: F.col("shards")[b.cast("int")]).alias("shards"))
    found = placed.join(to_shard, "node").select(*keys, F.col("shards")[F.col("bin")].cast("int").alias("shard"))
    return written(found.unionByName(by_itself), "shards")


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; the law is bytes."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )
    rows = written(rows, "sizes")
    by_group = group_shards(rows.groupBy("h1", "h2").agg(F.sum("size").alias("size")), ["h1", "h2"], shards)
    buckets = parallelism(docs.sparkSession)
    placed = rows.join(by_group, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    # rows that are equal in all of these are counted before they are sent, and numbered in runs
    runs = written(placed.groupBy("shard", "bucket", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "placed")
    counts = runs.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("shard", "bucket", before.alias("before")), "starts")
    upto = F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0))
    numbered = runs.withColumn("from", upto - F.col("n")).join(starts, ["shard", "bucket"]).withColumn("from", F.col("before") + F.col("from"))
    short, long = numbered.where(F.col("n") <= RUN), numbered.where(F.col("n") > RUN)
    # a long run is cut into pieces that are dealt to all tasks
    cut = long.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))))
    pieces = cut.select("doc_id", "size", "text_crc32", "shard", (F.col("from") + F.col("piece") * RUN).alias("from"), F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("piece") * RUN).alias("n")).repartition(buckets)
    every = short.select("doc_id", "size", "text_crc32", "shard", "from", "n").unionByName(pieces)
    slots = every.withColumn("slot", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
