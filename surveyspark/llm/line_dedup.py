"""Line dedup over all documents, incremental and reversible.

The index is a written table of reference counts, one signed row for each
(line key, batch): documents that are added count +1, documents that are taken
away count -1, so any change can be undone exactly.  Keys are 128-bit hashes of
the stripped, lower-cased line.  From the counts, keys found in at least
``min_docs`` documents are the hot ones.

Sharded cuckoo filters over the hot keys are stored beside the counts.  Each
batch inserts the keys whose exact count reaches ``min_docs`` with it and deletes
those whose count falls below; a shard is built anew from the counts only if its
filter overflowed before and its keys fit again.  A batch counts once its
filters are written; one that broke off before is written over by the next.

To drop lines, tasks first ask the filters.  They have a fixed total size; a
shard whose filter would overflow answers "perhaps" to everything, so a filter
only ever saves work.  Lines that may be hot are then joined with the exact
counts.

Null and empty texts have one empty line; empty keys are never dropped.  Rows
count as documents one by one (repeated rows and null ids included): results
join on a hash of the text, since which lines are hot depends on nothing else.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.tables import plain, shared_path, written
from surveyspark.llm.words import WHITE, bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS = 10
#: The filters' size is fixed: SHARDS filters of SHARD_BUCKETS buckets with four 16-bit fingerprints (16 MB in all).
SHARDS = 64
SHARD_BUCKETS = 1 << 15
SLOTS = 4
MAX_KICKS = 500
FULL = 0.9
#: Keys that a shard's filter may hold.
ROOM = int(FULL * SHARD_BUCKETS * SLOTS)
FILTER = "shard long, n long, bytes binary"


def shard_of() -> Column:
    return F.col("k1").bitwiseAND(SHARDS - 1)


def line_key(line: bytes) -> bytes | None:
    """16 bytes for a stripped, lower-cased line; None for a line without any character."""
    line = line.strip(WHITE)
    return xxhash.xxh3_128_digest(line.lower()) if line else None


def key_columns(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])


class CuckooFilter:
    """Partial-key cuckoo hashing: a key's fingerprint stands in one of two buckets; entries can be taken out again."""

    def __init__(self, table: np.ndarray | None = None) -> None:
        self.table = np.zeros((SHARD_BUCKETS, SLOTS), dtype=np.uint16) if table is None else table
        self.overflow = False

    @staticmethod
    def places(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(SHARD_BUCKETS - 1)
        mark = (k2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (k1.astype(np.uint64) >> np.uint64(8)) & mask
        return mark, one, (one ^ CuckooFilter.jump(mark)) & mask

    @staticmethod
    def jump(mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        mask = SHARD_BUCKETS - 1
        rng = np.random.default_rng(7)
        for m, a, b in zip(*(x.tolist() for x in self.places(k1, k2))):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                at = (a, b)[rng.integers(2)]
                for _ in range(MAX_KICKS):
                    slot = rng.integers(SLOTS)
                    m, self.table[at, slot] = int(self.table[at, slot]), m
                    at = int((at ^ int(self.jump(np.array([m], dtype=np.uint16))[0])) & mask)
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = m
                        break
                else:
                    self.overflow = True
                    return

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for m, a, b in zip(*(x.tolist() for x in self.places(k1, k2))):
            for at in (a, b):
                there = np.flatnonzero(self.table[at] == m)
                if len(there):
                    self.table[at, there[0]] = 0
                    break

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        if self.overflow:
            return np.ones(len(k1), dtype=bool)
        mark, one, two = self.places(k1, k2)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)


def _edit_filter(moves: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """One shard's stored filter (none yet: an empty one) with keys deleted and inserted; at most about twice ROOM keys."""
    f = CuckooFilter(np.frombuffer(old["bytes"].iloc[0], dtype=np.uint16).reshape(-1, SLOTS).copy() if len(old) else None)
    k1, k2, up = moves["k1"].to_numpy(), moves["k2"].to_numpy(), moves["up"].to_numpy(dtype=bool)
    f.delete(k1[~up], k2[~up])
    f.insert(k1[up], k2[up])
    n = (int(old["n"].iloc[0]) if len(old) else 0) + int(up.sum()) - int((~up).sum())
    return pd.DataFrame({"shard": [int(moves["shard"].iloc[0])], "n": [n], "bytes": [None if f.overflow else f.table.tobytes()]})


def _probe(tables: dict[int, bytes | None], k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Whether each key may be hot; a shard without an entry has no hot key, one with None has too many to tell."""
    shard = (k1.astype(np.uint64) & np.uint64(SHARDS - 1)).astype(np.int64)
    out = np.zeros(len(k1), dtype=bool)
    for s, table in tables.items():
        here = np.flatnonzero(shard == s)
        if len(here):
            out[here] = True if table is None else CuckooFilter(np.frombuffer(table, dtype=np.uint16).reshape(-1, SLOTS)).contains(k1[here], k2[here])
    return out


class LineIndex:
    """Reference counts of line keys and cuckoo filters over the hot ones, in a folder below the shared one; documents
    are added and taken away in batches.  A folder that holds an index already is gone on with."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.path, self.min_docs, self.batch = spark, path or shared_path(spark, "line-index"), min_docs, 0
        bounded_batches(spark)
        if path is not None:
            self._reopen()

    def _reopen(self) -> None:
        try:
            last = self._stored().where("shard = -1").select("batch", "n").orderBy(F.desc("batch")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last is not None:
            if last["n"] != self.min_docs:
                raise ValueError(f"the index at {self.path} holds filters for min_docs = {last['n']}, not {self.min_docs}")
            self.batch = last["batch"]

    def _stored(self) -> DataFrame:
        """All versions of the filters; row -1 of a version states its min_docs."""
        return self.spark.read.schema("shard long, n long, bytes binary, batch int").parquet(f"{self.path}/filters")

    def _batches(self, first: int, last: int) -> DataFrame:
        if last < 1:
            return self.spark.createDataFrame([], "k1 long, k2 long, n long")
        rows = self.spark.read.schema("k1 long, k2 long, n long, batch int").parquet(f"{self.path}/counts")
        return rows.where(F.col("batch").between(first, last)).select("k1", "k2", "n")

    def add(self, docs: DataFrame, text_col: str = "text", sign: int = 1) -> LineIndex:
        now = self.batch + 1
        counts = line_counts(docs, text_col).groupBy("k1", "k2").agg((F.sum("n") * sign).alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch={now}")
        self._edit_filters(now)
        self.batch = now
        return self

    def remove(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Takes documents away that were added before."""
        return self.add(docs, text_col, -1)

    def _crossings(self, now: int) -> DataFrame:
        """(k1, k2, shard, up): keys whose count reaches min_docs, or falls below it, with batch ``now``."""
        delta = self._batches(now, now)
        both = delta.select("k1", "k2", F.lit(0).cast("long").alias("was"), F.col("n").alias("total"))
        if now > 1:                                          # of the older batches only the keys that the new one has
            old = self._batches(1, now - 1).join(delta.select("k1", "k2"), ["k1", "k2"], "left_semi")
            both = both.union(old.select("k1", "k2", "n", "n")).groupBy("k1", "k2").agg(F.sum("was").alias("was"), F.sum("total").alias("total"))
        up = F.col("total") >= self.min_docs
        return both.where(up != (F.col("was") >= self.min_docs)).select("k1", "k2", shard_of().alias("shard"), up.alias("up"))

    def _edit_filters(self, now: int) -> None:
        moves = written(self._crossings(now), "line-crossings")
        before = self._stored().where(F.col("batch") == now - 1).select("shard", "n", "bytes").where("shard >= 0") if now > 1 else self.spark.createDataFrame([], FILTER)
        size, lost = {}, set()
        for r in before.select("shard", "n", F.col("bytes").isNull().alias("lost")).collect():
            size[r["shard"]] = r["n"]
            lost |= {r["shard"]} if r["lost"] else set()
        moved = moves.groupBy("shard").agg(F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("d")).collect()
        for r in moved:
            size[r["shard"]] = size.get(r["shard"], 0) + r["d"]
        fits = {s for s, n in size.items() if 0 < n <= ROOM}
        again = sorted(fits & lost)                          # too full before, fits now (or was unlucky): built from the counts
        edited = sorted(fits & {r["shard"] for r in moved} - lost)
        todo = moves.where(F.col("shard").isin(edited))
        if again:
            hot = self._hot(now, self.min_docs).select("k1", "k2", shard_of().alias("shard"), F.lit(True).alias("up"))
            todo = todo.union(hot.where(F.col("shard").isin(again)))
        new = before.where(F.col("shard").isin(sorted(fits - {*again, *edited})))
        if again or edited:
            old = before.where(F.col("shard").isin(edited)).groupBy("shard")
            new = new.union(todo.groupBy("shard").cogroup(old).applyInPandas(_edit_filter, FILTER))
        rest = [(s, n, None) for s, n in size.items() if n > ROOM] + [(-1, self.min_docs, None)]
        new.union(self.spark.createDataFrame(rest, FILTER)).write.mode("overwrite").parquet(f"{self.path}/filters/batch={now}")

    def filters(self) -> dict[int, bytes | None]:
        """The stored filters, of fixed size in all; None for a shard with too many hot keys."""
        if not self.batch:
            return {}
        rows = self._stored().where((F.col("batch") == self.batch) & (F.col("shard") >= 0))
        return {r["shard"]: None if r["bytes"] is None else bytes(r["bytes"]) for r in rows.collect()}

    def counts(self) -> DataFrame:
        """Documents per key now; keys that no document has any more are gone."""
        return self._totals(self.batch).where("n > 0")

    def _totals(self, last: int) -> DataFrame:
        rows = self._batches(1, last)
        return rows if last <= 1 else rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"))    # a batch has one row for each key

    def _hot(self, last: int, min_docs: int) -> DataFrame:
        return self._totals(last).where(F.col("n") >= min_docs).select("k1", "k2")

    def hot(self, min_docs: int | None = None) -> DataFrame:
        return written(self._hot(self.batch, self.min_docs if min_docs is None else min_docs), "hot-lines")

    def drop(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``drop_lines`` with the index's own hot keys and stored filters."""
        return drop_lines(docs, self.hot(), text_col, self.filters())


def line_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, n): documents with a key, counted within each Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[bytes, int] = {}
            for t in b.column(0):
                lines = (t.as_py() or "").encode().split(b"\n")
                for k in {line_key(x) for x in lines}:
                    if k is not None:
                        counts[k] = counts.get(k, 0) + 1
            k1, k2 = key_columns(list(counts))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(list(counts.values()), type=pa.int64())], names=["k1", "k2", "n"])

    return docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "k1 long, k2 long, n long")


def filters(hot: DataFrame) -> dict[int, bytes | None]:
    """Cuckoo filters over hot keys that no index holds (at most SHARDS * SHARD_BUCKETS * SLOTS * 2 bytes); shards with
    too many keys are not built."""
    keyed = hot.select("k1", "k2", shard_of().alias("shard"), F.lit(True).alias("up"))
    sizes = {r["shard"]: r["n"] for r in keyed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    few = keyed.where(F.col("shard").isin([s for s, n in sizes.items() if n <= ROOM]))
    none = pd.DataFrame({"n": [], "bytes": []})
    built = few.groupBy("shard").applyInPandas(lambda moves: _edit_filter(moves, none), FILTER)
    out: dict[int, bytes | None] = {s: None for s in sizes}
    out.update({r["shard"]: None if r["bytes"] is None else bytes(r["bytes"]) for r in built.collect()})
    return out


def drop_lines(docs: DataFrame, hot: DataFrame, text_col: str = "text", stored: dict[int, bytes | None] | None = None) -> DataFrame:
    """The input's rows with hot lines gone from the text, plus __n_lines and __n_dropped; other columns unchanged
    (input names that begin with ``__`` are not carried).  ``stored``: filters that hold all hot keys; built here if not given."""
    docs, spark = plain(docs), docs.sparkSession
    bounded_batches(spark)
    tables = spark.sparkContext.broadcast(filters(hot) if stored is None else stored)
    text = F.col(f"`{text_col}`").cast("string")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for t, h in zip(b.column(0), b.column(1).to_pylist()):
                if t.is_valid:
                    own = {line_key(x) for x in t.as_py().encode().split(b"\n")} - {None}
                    rows += [h] * len(own)
                    keys += own
            k1, k2 = key_columns(keys)
            may = np.flatnonzero(_probe(tables.value, k1, k2))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(rows, dtype=np.int64)[may]), pa.array(k1[may]), pa.array(k2[may])], names=["h", "k1", "k2"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, drop in zip(b.column("__text"), b.column("__drop")):
                lines = (t.as_py() or "").split("\n")
                drop = {(d["k1"], d["k2"]) for d in drop.as_py() or ()}
                kept = lines
                if drop:
                    keys = [line_key(x.encode()) for x in lines]
                    k1, k2 = key_columns([k or bytes(16) for k in keys])
                    kept = [x for x, k, p in zip(lines, keys, zip(k1.tolist(), k2.tolist())) if k is None or p not in drop]
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(texts, type=pa.string()), pa.array(n_lines, type=pa.int64()), pa.array(n_dropped, type=pa.int64())],
                                             names=["__row", "__kept", "__n_lines", "__n_dropped"])

    may = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).mapInArrow(candidates, "h long, k1 long, k2 long")
    found = written(may.join(hot, ["k1", "k2"], "left_semi").groupBy("h").agg(F.collect_set(F.struct("k1", "k2")).alias("__drop")), "lines-to-drop")
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row") if others else F.struct(F.lit(0)).alias("__row"),
                         text.alias("__text"), F.xxhash64(text).alias("__h"))
    # one join strategy at every size; both sides are plain exchanges, so AQE can split the rows of a text with many copies
    both = packed.join(found.hint("merge"), packed["__h"] == found["h"], "left").select("__row", "__text", "__drop")
    schema = T.StructType([both.schema["__row"], T.StructField("__kept", T.StringType()), T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    out = both.mapInArrow(rewrite, schema)
    return out.select(*[F.col("__kept").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns], "__n_lines", "__n_dropped")


def line_digest(dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return dropped.select(F.col(f"`{id_col}`"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                          F.sha2(F.col(f"`{text_col}`"), 256).alias("kept_sha256"))
