"""Conversation prefix trie: the tree of common beginnings of conversations, found block by block.

The turns of every conversation get chained digests.  Conversations are first
grouped by successive blocks of ``BLOCK`` turns: a block's key is the digest at
its end, which stands for everything up to there.  Where all conversations that
share a beginning go on with one and the same block, its turns are nodes as they
are; only where blocks part (siblings diverge) are the turn boundaries inside
them grouped one by one, from the distinct blocks and their counts.

What a node sums over its subtree comes from its members, in one more pass: the
smallest member of a node owns it, the nodes that a conversation owns are the
last ones of its path, and what it shares with others is all that goes before.

Digests are values of a polynomial over the turns' hashes modulo 2^127 - 1.  Two
parts of a conversation can be put together, so a very long conversation is
dealt over several partitions by (conversation, block).  What is carried from one
partition to the next is one row per partition border, which the driver adds up.
Members that end at a node are dealt by (node, conversation) and joined to texts
of at most ``IDS_IN_CHUNK`` ids, which a task reads in order, chunk by chunk.

Null roles and texts count as empty; rows of one conversation are ordered by turn
(null first), then by the digest of role and text; rows without a conversation id
belong to none and are left out; repeated rows are turns of their own; other
columns take no part.  An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.tables import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4
IDS_IN_CHUNK = 10_000
ROWS_OUT = 1_000

MODULUS = (1 << 127) - 1
FACTOR = 0x5DEECE66D1CE4E5B9BF58476D1CE4E5B
ROOT = bytes(16)

#: Fixed by the contract: conversations of five share an opening of at most eight turns.
FAMILY = 5
OPENINGS = 9


def as_bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


def as_int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes): every turn with its place in its conversation, from 0."""
    said, who = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32))
    rows = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
                                F.octet_length(said).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")).where("conv is not null")
    keys = ("conv", "turn", "digest", "row")                     # the row number parts equal rows of a hot conversation
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", F.spark_partition_id().alias("part"), "digest", "bytes")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            places = []
            for c in b.column(0).to_pylist():
                n = n + 1 if c == last else 0
                last = c
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], names=[*b.schema.names, "local"])

    numbered = written(dealt.mapInArrow(number, "conv long, part int, digest binary, bytes long, local long"), "trie-turns")
    # one row for each partition border inside a conversation: fewer than there are partitions
    in_order = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    borders = numbered.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", F.sum("n").over(in_order).alias("before")).where("before > 0")
    return numbered.join(F.broadcast(borders), ["conv", "part"], "left").select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def paths_as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv) and (conv, depth, digest, bytes)."""
    return turns.select("conv").distinct(), turns.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes")


def paths_with_openings(turns: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their family, h from a checksum of their id: (conv) and (conv, depth, digest, bytes)."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    checksum = F.crc32(F.col("conv").cast("string").cast("binary"))
    convs = written(convs.withColumns({"h": checksum % openings, "first": F.col("conv") - F.col("conv") % family}), "trie-convs")
    firsts = convs.select(F.col("conv").alias("first"), F.col("n").alias("n_first"))
    known = written(convs.join(firsts, "first", "left").select("conv", "first", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken")), "trie-openings")
    heads = turns.where((F.col("conv") % family == 0) & (F.col("pos") < openings - 1)).withColumnRenamed("conv", "first")
    opening = known.join(heads, "first").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    own = turns.join(known.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    return known.select("conv"), opening.unionByName(own)


def path_blocks(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, block, prev, end, hashes, sizes, before): the chained digests at every turn of a block, with the digest and the text bytes before it."""
    numbered = paths.withColumn("block", F.floor((F.col("depth") - 1) / block).cast("long"))
    dealt = numbered.repartitionByRange("conv", "block").sortWithinPartitions("conv", "block", "depth")
    dealt = dealt.select("conv", F.spark_partition_id().alias("part"), "block", "digest", "bytes")
    schema = "conv long, part int, block long, seen long, prev binary, hashes array<binary>, sizes array<bigint>, before long"
    local = written(dealt.mapInArrow(chain, schema), "trie-local")

    # conversations on both sides of a partition border: at most two rows for each border
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    ends = local.groupBy("conv", "part").agg(F.max_by(F.struct((F.col("seen") + F.size("hashes")).alias("n"), F.element_at("hashes", -1).alias("h"),
                                                               (F.col("before") + size).alias("bytes")), "block").alias("e"))
    split = ends.withColumn("parts", F.count("*").over(Window.partitionBy("conv"))).where("parts > 1").select("conv", "part", "e.*")
    carried: dict[tuple[int, int], tuple[int, int]] = {}
    last, h, total = None, 0, 0
    for r in sorted(split.collect(), key=lambda r: (r["conv"], r["part"])):
        h, total = (h, total) if r["conv"] == last else (0, 0)
        last = r["conv"]
        carried[r["conv"], r["part"]] = h, total
        h, total = (h * pow(FACTOR, r["n"], MODULUS) + as_int(r["h"])) % MODULUS, total + r["bytes"]
    carry = paths.sparkSession.sparkContext.broadcast(carried)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                h, total = carry.value.get((r["conv"], r["part"]), (0, 0))
                if h:
                    at = h * pow(FACTOR, r["seen"], MODULUS) % MODULUS
                    r["prev"] = as_bytes((at + as_int(r["prev"])) % MODULUS)
                    for k, x in enumerate(r["hashes"]):
                        at = at * FACTOR % MODULUS
                        r["hashes"][k] = as_bytes((at + as_int(x)) % MODULUS)
                    r["before"] += total
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return written(local.mapInArrow(put_together, schema).select("conv", "block", "prev", F.element_at("hashes", -1).alias("end"), "hashes", "sizes", "before"), "trie-blocks")


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block from turns in order; digests and bytes count from the conversation's first turn in this partition."""
    schema = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("seen", pa.int64()), ("prev", pa.binary()),
                        ("hashes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("before", pa.int64())])
    out: list[dict] = []
    last, h, seen, total = None, 0, 0, 0
    for b in batches:
        for conv, part, block, digest, size in zip(*(c.to_pylist() for c in b.columns)):
            if conv != last:
                last, h, seen, total = conv, 0, 0, 0
            if not out or out[-1]["conv"] != conv or out[-1]["block"] != block:
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
                out.append(dict(conv=conv, part=part, block=block, seen=seen, prev=as_bytes(h), hashes=[], sizes=[], before=total))
            h = (h * FACTOR + as_int(digest)) % MODULUS
            seen, total = seen + 1, total + size
            out[-1]["hashes"].append(as_bytes(h))
            out[-1]["sizes"].append(size)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def block_nodes(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(digest, depth, parent, before, n_convs, conv): every node but the root; turns are grouped only where blocks diverge."""
    distinct = written(blocks.groupBy("prev", "end").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.min(F.struct("block", "hashes", "sizes", "before")).alias("b")).select("prev", "end", "n", "conv", "b.*"), "trie-distinct")
    lone = written(distinct.groupBy("prev").agg(F.count("*").alias("kinds")), "trie-kinds")
    judged = distinct.join(lone, "prev")
    turns = judged.select("kinds", "prev", "hashes", "sizes", "before", "block", "n", "conv", F.posexplode("hashes").alias("t", "digest"))
    done = F.aggregate(F.slice("sizes", F.lit(1), F.col("t")), F.col("before"), lambda a, x: a + x)
    turns = turns.select("kinds", "digest", (F.col("block") * block + F.col("t") + 1).alias("depth"),
                         F.coalesce(F.get("hashes", F.col("t") - 1), F.col("prev")).alias("parent"), done.alias("before"), F.col("n").alias("n_convs"), "conv")
    alone = turns.where("kinds = 1").drop("kinds")
    parted = turns.where("kinds > 1").groupBy("digest").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("before").alias("before"),
                                                            F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"))
    return alone.unionByName(parted)


def end_digests(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of nodes where conversations end: their ids in order, joined by commas."""
    dealt = members.select("end", "conv").repartitionByRange("end", "conv").sortWithinPartitions("end", "conv").select("end", "conv", F.spark_partition_id().alias("part"))
    chunks = written(dealt.mapInArrow(join_ids, "end binary, part int, seq long, ids string"), "trie-ends")
    in_order = chunks.repartition("end").sortWithinPartitions("end", "part", "seq").select("end", "ids")
    return in_order.mapInArrow(hash_ids, "digest binary, ends_sha256 string")


def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end, conv) rows as texts of at most IDS_IN_CHUNK ids."""
    names, seq = ["end", "part", "seq", "ids"], 0
    end, part, ids, out = None, 0, [], []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.string()))], names=names)

    for b in batches:
        for e, c, p in zip(*(x.to_pylist() for x in b.columns)):
            if e != end or len(ids) >= IDS_IN_CHUNK:
                if ids:
                    out.append((end, part, seq, ",".join(ids)))
                    seq += 1
                end, part, ids = e, p, []
            ids.append(str(c))
        if len(out) >= ROWS_OUT:
            yield batch(out)
            out = []
    if ids:
        out.append((end, part, seq, ",".join(ids)))
    if out:
        yield batch(out)


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's texts in order; only the hash state is held."""
    end, state, out = None, None, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["digest", "ends_sha256"])

    for b in batches:
        for e, ids in zip(*(x.to_pylist() for x in b.columns)):
            if e != end:
                if state:
                    out.append((end, state.hexdigest()))
                end, state = e, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) >= ROWS_OUT:
            yield batch(out)
            out = []
    if state:
        out.append((end, state.hexdigest()))
    if out:
        yield batch(out)


def prefix_trie(convs: DataFrame, paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: __digest, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` (conv) names every conversation, also those without turns; ``paths`` (conv, depth from 1, digest, bytes) has their turns.
    """
    spark = convs.sparkSession
    blocks = path_blocks(paths, block)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    ends = blocks.groupBy("conv").agg(F.max_by(F.struct("end", (F.col("before") + size).alias("bytes")), "block").alias("e"))
    whole = written(convs.join(ends, "conv", "left").select("conv", F.coalesce("e.end", F.lit(ROOT)).alias("end"), F.coalesce("e.bytes", F.lit(0)).alias("bytes")), "trie-whole")
    root = whole.agg(F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
                     F.lit(0).cast("long").alias("before"), F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    nodes = written(block_nodes(blocks, block).unionByName(root), "trie-nodes")

    # what a conversation owns: the nodes from `first` to `last`; what it shares: `shared` bytes before `first` (all its bytes if it owns none)
    first = F.struct("digest", "parent", "before", "depth")
    owners = written(nodes.groupBy("conv").agg(F.min_by(first, "depth").alias("f"), F.max_by("digest", "depth").alias("last")), "trie-owners")
    parents = written(owners.where("f.parent is not null").groupBy(F.col("f.parent").alias("digest")).agg(F.count("*").alias("n")), "trie-parents")
    leaves = owners.join(parents, owners["last"] == parents["digest"], "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    shares = written(whole.join(owners.select("conv", "f"), "conv", "left").join(leaves, "conv", "left").select(
        "conv", "end", F.coalesce("f.before", "bytes").alias("shared"), F.coalesce("f.depth", F.lit(1 << 62)).alias("from"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-shares")

    # sums over members: shared bytes up to the first owned turn, one for the owner of a leaf all along its path
    length = F.size("hashes")
    unowned = F.least(length.cast("long"), F.greatest(F.col("from") - 1 - F.col("block") * block, F.lit(0))).cast("int")
    of = blocks.select("conv", "block", "end", "hashes").join(shares.where("shared > 0 or leaf > 0").select("conv", "shared", "from", "leaf"), "conv")
    parts = of.select("end", F.explode(F.array(F.struct(unowned.alias("upto"), F.col("shared"), F.lit(0).cast("long").alias("leaf")),
                                               F.struct(length.alias("upto"), F.lit(0).cast("long").alias("shared"), F.col("leaf")))).alias("s"), "hashes")
    sums = parts.where("s.upto > 0 and (s.shared > 0 or s.leaf > 0)").groupBy("end", "s.upto").agg(
        F.sum("s.shared").alias("shared"), F.sum("s.leaf").alias("leaves"), F.min("hashes").alias("hashes"))
    sums = sums.select(F.explode(F.slice("hashes", F.lit(1), F.col("upto"))).alias("digest"), "shared", "leaves")
    at_root = shares.agg(F.lit(ROOT).alias("digest"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves"))
    above = owners.select("conv", "f.digest", "f.parent").join(nodes.select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv")), "parent")

    # everything known of a node meets in one exchange by its digest
    columns = {"depth": "long", "before": "long", "n_convs": "long", "conv": "long", "parent_conv": "long", "starts": "int", "stops": "int",
               "kids": "long", "shared": "long", "leaves": "long", "ends_sha256": "string"}

    def marks(df: DataFrame, **given: object) -> DataFrame:
        return df.select("digest", *[F.lit(given[c]).cast(t).alias(c) if c in given else F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c)
                                     for c, t in columns.items()])

    rows = [marks(nodes), marks(owners.select("f.digest"), starts=1), marks(above.select("digest", "parent_conv")), marks(owners.select(F.col("last").alias("digest")), stops=1),
            marks(parents.withColumnRenamed("n", "kids")), marks(sums.unionByName(at_root)), marks(end_digests(shares))]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    summed = ("kids", "shared", "leaves")
    one = every.groupBy("digest").agg(*[(F.sum(c) if c in summed else F.max(c)).alias(c) for c in columns]).where("depth is not null")
    no_ends = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return one.select(
        F.col("digest").alias("__digest"), F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("starts").isNull(), F.col("conv")).otherwise(F.col("parent_conv")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("kids", zero) + F.when(F.col("stops").isNull(), 1).otherwise(0)).cast("long").alias("n_children"), F.coalesce("leaves", zero).alias("n_leaves"),
        (F.coalesce("shared", zero) - F.col("before") * (F.col("n_convs") - 1)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(no_ends)).alias("ends_sha256"))


def trie_digest(nodes: DataFrame) -> DataFrame:
    return nodes.drop("__digest")
