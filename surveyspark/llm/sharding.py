"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

All rows with equal text form one group.  A partial partition is a list of K
byte sums with the groups behind each; differencing repeatedly takes the two
partial partitions with the largest spread (largest minus smallest sum) and
adds the largest sum of one to the smallest of the other, and so on.

At scale this runs as a tree: groups are dealt into buckets by hash (as many as
keep a bucket near ``BUCKET_GROUPS``), each bucket is differenced down to one
partial partition in one task, every group starting as its own, and the partial
partitions, K sums each, are differenced again, at most ``FAN_IN`` in a task,
until one is left.

Groups that are large beside one shard's part of a bucket are differenced first;
if they are too many for one bucket, in the same way (the largest of them first).
Every bucket then starts with its share of their K sums, so that its small groups
level them, and keeps its parts in that order; one bucket goes last, starts with
the sums of all the others and levels what they left.

Null and empty texts are one group of size 16 a row; ids may be null or
repeated (each row has its own slot); extra columns take no part.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from surveyspark.llm.tables import documents, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed by the contract: bytes that a row takes besides its text.
ROW_BYTES = 16
BUCKET_GROUPS = 50_000
FAN_IN = 1_000
#: A group is large if it has more than this part of what one shard gets of a bucket (so at most K * buckets / LARGE are,
#: which is far fewer than the groups; should they be over half of them, the limit is doubled).
LARGE = 1 / 8
#: Rows that are numbered in one task when slots are dealt.
SLOT_ROWS = 100_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over n partial partitions of K sums each.

    Returns the K final sums (ascending) and, for each input and each of its K
    parts, the final part that it went to.
    """
    n, k = sums.shape
    order = np.argsort(sums, axis=1, kind="stable")
    state = {i: np.take(sums[i], order[i]) for i in range(n)}
    heap = [(-(s[-1] - s[0]), i) for i, s in state.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int, np.ndarray]] = []
    top = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = state.pop(a) + state.pop(b)[::-1]
        rank = np.argsort(joined, kind="stable")
        state[top] = joined[rank]
        merges.append((top, a, b, rank))
        heapq.heappush(heap, (-(state[top][-1] - state[top][0]), top))
        top += 1
    part = np.empty((top, k), dtype=np.int32)               # part[i][j]: final part of the j-th smallest sum of i
    part[top - 1] = np.arange(k)
    for c, a, b, rank in reversed(merges):
        place = np.empty(k, dtype=np.int32)
        place[rank] = part[c]
        part[a], part[b] = place, place[::-1]
    out = np.empty((n, k), dtype=np.int32)
    np.put_along_axis(out, order, part[:n], axis=1)
    return state[top - 1], out


def _start(first: np.ndarray):
    """Groups of one bucket -> (bucket, part) of each group; parts are those of ``first``, the K sums that are there before."""
    def run(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True])
        k = len(first)
        mixed = np.random.default_rng(abs(int(key[0]))).permutation(k)   # else equal sums would take the same side in every bucket
        sums = np.zeros((len(groups) + 1, k), dtype=np.int64)
        sums[0] = first[mixed]
        sums[1:, -1] = groups["bytes"].to_numpy()
        out = difference(sums)[1]
        part = np.empty(k, dtype=np.int32)
        part[out[0]] = mixed
        return groups[["bucket", "h1", "h2", "bytes"]].assign(part=part[out[1:, -1]])
    return run


def _merge(k: int):
    """(node, part, bytes) rows of some partial partitions -> the part of the merged partition that each goes to."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="node", columns="part", values="bytes", fill_value=0, aggfunc="sum").reindex(columns=range(k), fill_value=0).sort_index()
        to = difference(wide.to_numpy(dtype=np.int64))[1]
        return pd.DataFrame({"node": np.repeat(wide.index.to_numpy(), k), "part": np.tile(np.arange(k, dtype=np.int32), len(wide)),
                             "up": np.int64(key[0]), "to": to.reshape(-1)})
    return run


def _differenced(placed: DataFrame, shards: int, buckets: int) -> DataFrame:
    """The shard of every group (h1, h2), from the buckets' partial partitions, differenced until one is left."""
    # nodes: partial partitions; 'to' maps (node of the first level, part) to the part of the root
    level = placed.groupBy(F.col("bucket").alias("node"), "part").agg(F.sum("bytes").alias("bytes"))
    path = None
    count = buckets
    while count > 1 or path is None:
        up = -(-count // FAN_IN)
        step = level.withColumn("up", F.pmod(F.col("node"), F.lit(up)))
        step = written(step.groupBy("up").applyInPandas(_merge(shards), "node long, part int, up long, to int"), "shard-merge")
        level = level.join(step, ["node", "part"]).groupBy(F.col("up").alias("node"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
        if path is None:
            path = step.select(F.col("node").alias("bucket"), "part", F.col("up").alias("node"), F.col("to").alias("at"))
        else:
            path = path.join(step.select("node", F.col("part").alias("at"), "up", "to"), ["node", "at"]).select(
                "bucket", "part", F.col("up").alias("node"), F.col("to").alias("at"))
        count = up
    return placed.join(path, ["bucket", "part"]).select("h1", "h2", "bytes", F.col("at").alias("shard"))


def _sums(placed: DataFrame, part: str, shards: int) -> np.ndarray:
    sums = np.zeros(shards, dtype=np.int64)
    for r in placed.groupBy(F.col(part).alias("part")).agg(F.sum("bytes").alias("bytes")).collect():
        sums[r["part"]] = r["bytes"]
    return sums


def _placed(groups: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, bytes, shard) of written groups (h1, h2, bytes)."""
    size = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-size["n"] // BUCKET_GROUPS))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("h1", "h2", F.lit(buckets)), F.lit(buckets)))

    def place(some: DataFrame, first: np.ndarray) -> DataFrame:
        return written(some.groupBy("bucket").applyInPandas(_start(first), "bucket long, h1 long, h2 long, bytes long, part int"), "shard-groups-placed")

    n_large, limit = 0, LARGE * size["bytes"] / (shards * buckets)
    while buckets > 1:
        is_large = F.col("bytes") > F.lit(limit)
        n_large = groups.where(is_large).count()
        if 2 * n_large <= size["n"]:
            break
        limit *= 2
    if not n_large:
        return _differenced(place(dealt, np.zeros(shards, dtype=np.int64)), shards, buckets)
    large = written(_placed(written(groups.where(is_large), "shard-groups-large"), shards), "shard-groups-large-placed")
    heavy = _sums(large, "shard", shards)
    most = place(dealt.where(~is_large & (F.col("bucket") > 0)), heavy // buckets)
    last = place(dealt.where(~is_large & (F.col("bucket") == 0)), heavy + _sums(most, "part", shards))
    return large.union(most.union(last).select("h1", "h2", "bytes", F.col("part").alias("shard")))


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = documents(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), F.reverse(text)).alias("h2"))
    groups = written(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    where = _placed(groups.select("h1", "h2", "bytes"), shards).drop("bytes")
    located = written(rows.join(where, ["h1", "h2"]).select("id", "size", "crc", "shard"), "shard-rows")

    # slots: rows of a shard are cut into pieces by hash, pieces get offsets, rows are numbered inside their piece
    pieces = max(1, -(-located.count() // (SLOT_ROWS)))
    cut = located.withColumn("piece", F.pmod(F.xxhash64("id", "size", "crc"), F.lit(pieces)))
    sizes = cut.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("id", "size", "crc")) - 1
    return cut.withColumn("inside", inside).join(before, ["shard", "piece"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
