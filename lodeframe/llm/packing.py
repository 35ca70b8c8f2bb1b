"""Items of varying length packed into containers of fixed capacity.

Items are dealt to blocks of a bounded number of containers; in each block the
Karmarkar-Karp multiway differencing method merges partial partitions with
opposing imbalances into near-equal windows, and the window count rises until no
window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import os
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Fixed value: the pre-tokenising pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Containers that a block aims at: bounds the memory of a task and the room lost at a block's end.
WINDOWS = 128


def token_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (id, n_tokens) of whole texts under a public byte-level tokenizer; null texts are left out.

    ``vocabulary`` is a file on the driver; it is sent to the workers.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in parts:
            yield pd.DataFrame({"_id": pdf["_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in pdf["_t"]]})

    return src.mapInPandas(run, f"_id {kind}, n_tokens bigint").withColumnRenamed("_id", id_col)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item by the multiway differencing method with k windows."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    left, right = np.full(2 * n * 2, -1, dtype=np.int64), np.full(2 * n * 2, -1, dtype=np.int64)
    nodes = n  # the first n nodes are the items, later ones join two
    heap: list = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, s, a = heapq.heappop(heap)
        _, _, t, b = heapq.heappop(heap)
        m, o = len(s), len(t)
        over = m + o - k
        if over <= 0:
            sums, tree = np.concatenate([s, t]), np.concatenate([a, b])
        else:
            # the smallest of one meet the largest of the other; only ``over`` slots overlap
            x, y = np.concatenate([s, np.zeros(k - m, dtype=np.int64)]), np.concatenate([np.zeros(k - o, dtype=np.int64), t[::-1]])
            sums = x + y
            tree = np.concatenate([a, np.full(k - m, -1, dtype=np.int64)])
            other = np.concatenate([np.full(k - o, -1, dtype=np.int64), b[::-1]])
            both = (tree >= 0) & (other >= 0)
            c = int(both.sum())
            if nodes + c > len(left):
                grow = max(len(left), c)
                left, right = np.concatenate([left, np.full(grow, -1)]), np.concatenate([right, np.full(grow, -1)])
            fresh = np.arange(nodes, nodes + c)
            left[fresh], right[fresh] = tree[both], other[both]
            nodes += c
            tree = np.where(tree >= 0, tree, other)
            tree[both] = fresh
        order = np.argsort(-sums, kind="stable")
        sums, tree = sums[order], tree[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, tick, sums, tree))
        tick += 1
    out = np.zeros(n, dtype=np.int64)
    for w, root in enumerate(heap[0][3]):
        todo = [int(root)]
        while todo:
            x = todo.pop()
            if x < 0:
                continue
            if x < n:
                out[x] = w
            else:
                todo += [int(left[x]), int(right[x])]
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item (none above the capacity), with the fewest windows that the search finds."""
    total = int(sizes.sum())
    k = max(1, math.ceil(total / capacity))

    def fits(k: int):
        w = differencing(sizes, k)
        return w if np.bincount(w, weights=sizes, minlength=k).max() <= capacity else None

    if len(sizes) == 0:
        return np.zeros(0, dtype=np.int64)
    w, step, bad = fits(k), 1, k - 1
    while w is None:
        bad, k = k, min(len(sizes), k + step)
        step *= 2
        w = fits(k)
    best = w
    while k - bad > 1:
        mid = (k + bad) // 2
        w = fits(mid)
        if w is None:
            bad = mid
        else:
            k, best = mid, w
    return best


def pack_items(items: DataFrame, id_col: str, size_col: str, capacities: list[tuple[int, int]], windows: int = WINDOWS) -> DataFrame:
    """Assigns items to containers for each (profile_id, capacity).

    One row for each piece: profile_id, container_id, id, piece, start, size. An item
    larger than the capacity gives full pieces that fill a container each, and a
    remainder that is packed with the others; no other item is split. Items of null
    or negative size are left out; items of size 0 take part. No container exceeds
    its capacity. Repeated rows are packed as rows of their own.
    """
    src = materialize(items.where(F.col(size_col) >= 0).select(F.col(id_col).alias("_id"), F.col(size_col).cast("bigint").alias("_n")), "sizes")
    src = src.withColumn("_u", F.monotonically_increasing_id())
    totals = src.agg(*[F.sum(F.col("_n") % c).alias(f"t{i}") for i, (_, c) in enumerate(capacities)], *[F.sum(F.floor(F.col("_n") / c)).alias(f"f{i}") for i, (_, c) in enumerate(capacities)]).first()
    plan = []
    for i, (pid, c) in enumerate(capacities):
        # containers to come, full pieces included, so that a block stays bounded
        need = (totals[f"t{i}"] or 0) / c + (totals[f"f{i}"] or 0)
        plan.append(F.struct(F.lit(pid).alias("profile_id"), F.lit(int(c)).cast("bigint").alias("_c"), F.lit(max(1, round(need / windows))).cast("bigint").alias("_blocks")))
    rows = src.withColumn("_p", F.explode(F.array(*plan))).select("_id", "_n", "_u", "_p.*")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_u", "_id"), F.col("_blocks")))
    kind = src.schema["_id"].dataType.simpleString()
    out_cols = ["profile_id", "container_id", "_id", "piece", "start", "size"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_u"], ascending=[False, True])
        c = int(pdf["_c"].iloc[0])
        n, ids = pdf["_n"].to_numpy(), pdf["_id"].to_numpy()
        full, rest = n // c, n % c
        packed = (rest > 0) | (n == 0)
        w = pack(rest[packed], c)
        used = int(w.max()) + 1 if len(w) else 0
        prefix = f"{int(pdf['_block'].iloc[0])}-"
        at = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        a = pd.DataFrame({"container_id": [f"{prefix}{used + j}" for j in range(len(at))], "_id": ids[at], "piece": piece, "start": piece * c, "size": c})
        b = pd.DataFrame({"container_id": [f"{prefix}{j}" for j in w], "_id": ids[packed], "piece": full[packed], "start": full[packed] * c, "size": rest[packed]})
        out = pd.concat([a, b], ignore_index=True)
        out["profile_id"] = pdf["profile_id"].iloc[0]
        return out[out_cols]

    out = rows.groupBy("profile_id", "_block").applyInPandas(run, f"profile_id int, container_id string, _id {kind}, piece bigint, start bigint, size bigint")
    return out.withColumnRenamed("_id", id_col)
