"""Substring dedup by seed and extend.

A window is ``window`` consecutive words.  A word goes if it stands in a window
whose words also stand, in the same order, somewhere in a document with a
smaller id; what counts is the input, not what is left.

1. Copies: documents whose whole text also belongs to a smaller id need no
   search (all their windows are found there).  Up to ``COPIED_TEXTS`` of the
   most copied texts are set aside this way; the rest take the general path,
   with the same result.
2. Seeds: of the k-word shingles in each window the one with the least hash is
   its anchor (winnowing), so equal windows have equal anchors.  Anchors are
   joined across documents by counting documents per anchor.
3. Extend: around each anchor that several documents share, the windows that
   chose it reach up to ``window - k`` words to either side; they are matched
   exactly and the smallest document of each is kept.
4. Matched windows that overlap make up the maximal repeats; their words go.

Fixed-size Bloom filters keep rows that cannot match from being shuffled; exact
joins decide.  Hot anchors and windows are counted with partial aggregation.

Null and empty texts have no words; rows with a null id lose nothing and are no
source; rows that share an id are one document; other columns take no part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm import bloom
from surveyspark.llm.tables import documents, written
from surveyspark.llm.words import Words, bounded_batches, grams, slices, text_of_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SEED_WORDS = 5
COPIED_TEXTS = 200_000


def anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window hashes, first word of each window, anchor hash of each window, place of that anchor)."""
    h, at = grams(words, window)
    if not len(at):
        return h, at, h, at
    g, place = grams(words, k)
    full = np.full(len(words.hashes), np.uint64(2**64 - 1))
    full[place] = g
    best, where = full[at], at.copy()
    for j in range(1, window - k + 1):
        other = full[at + j]
        less = other <= best
        best[less] = other[less]
        where[less] = at[less] + j
    return h, at, best, where


def text_hashes(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit("second"), F.reverse(text)).alias("__t2")]


def copied_texts(rows: DataFrame, most: int) -> DataFrame:
    """(t1, t2, first id) of texts with copies: all of them, or those with the most copies, at most ``most``."""
    texts = written(rows.where("text is not null and id is not null").groupBy(*text_hashes(F.col("text")))
                    .agg(F.min("id").alias("__first"), F.count("*").alias("n")).where("n > 1"), "copied-texts")
    least, total = 2, 0
    sizes = texts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).orderBy(F.desc("p")).collect()
    for r in sizes:                                         # whole powers of two, from the most copied down
        total += r["c"]
        if total > most:
            least = 2 ** (r["p"] + 1)
            break
    return texts.where(F.col("n") >= least).drop("n")


def repeated_words(docs: DataFrame, id_col: str, text_col: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """((id, array of the first words of its matched windows), copied texts)."""
    rows = documents(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    copied = written(copied_texts(rows, COPIED_TEXTS), "copied-texts-kept")
    own = rows.where("id is not null and text is not null").select("id", "text", *text_hashes(F.col("text")))
    own = own.join(F.broadcast(copied), ["__t1", "__t2"], "left").where("__first is null or __first = id").select("id", "text")
    sc = docs.sparkSession.sparkContext

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Words]]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for row, end, w in slices(b.column(1), False):
                yield np.repeat(ids[row:end], np.diff(w.first)), w

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in each(batches):
            _, _, best, where = anchors(w, window, k)
            first = np.flatnonzero(np.diff(where, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(best[first].view(np.int64)), pa.array(ids[where[first]])], names=["h", "id"])

    found = own.mapInArrow(seeds, "h long, id long").groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    shared = sc.broadcast(bloom.build(found, "h"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in each(batches):
            h, at, best, _ = anchors(w, window, k)
            near = np.flatnonzero(bloom.perhaps(shared.value, best))
            yield pa.RecordBatch.from_arrays([pa.array(h[near].view(np.int64)), pa.array(ids[at[near]])], names=["w", "id"])

    sources = written(own.mapInArrow(extend, "w long, id long").groupBy("w").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                      .where("first < last").select("w", "first"), "repeat-sources")
    repeats = sc.broadcast(bloom.build(sources, "w"))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in each(batches):
            h, at = grams(w, window)
            near = np.flatnonzero(bloom.perhaps(repeats.value, h))
            local = at - w.first[text_of_rows(np.diff(w.first))[at]] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(h[near].view(np.int64)), pa.array(ids[at[near]]), pa.array(local[near].astype(np.int32))], names=["w", "id", "at"])

    hits = own.mapInArrow(matched, "w long, id long, at int").join(sources, "w").where("first < id")
    return written(hits.groupBy("id").agg(F.collect_set("at").alias("__at")), "repeat-hits"), copied


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the words that stay, joined by one space), spans (array of
    (start, end) word ranges of the maximal repeats)."""
    bounded_batches(docs.sparkSession)
    hits, copied = repeated_words(docs, id_col, text_col, window, k)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{id_col}`").cast("long").alias("__key"), text.alias("__text"), *text_hashes(text))
    rows = rows.join(F.broadcast(copied), ["__t1", "__t2"], "left").select("__id", "__key", "__text", F.coalesce(F.col("__first") < F.col("__key"), F.lit(False)).alias("__copy"))
    both = rows.join(hits.withColumnRenamed("id", "__key"), "__key", "left").select("__id", "__text", "__copy", "__at")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            at = b.column("__at")
            copies = b.column("__copy").to_pylist()
            for row, end, w in slices(b.column("__text"), False):
                data = w.data.tobytes()
                for r in range(row, end):
                    a, z = int(w.first[r - row]), int(w.first[r - row + 1])
                    n = z - a
                    gone = np.zeros(n + 1, dtype=np.int64)
                    starts = at[r].values.to_numpy() if at[r].is_valid else np.zeros(0, dtype=np.int64)
                    starts = np.unique(starts[starts <= n - window])
                    if copies[r]:
                        starts = np.arange(max(0, n - window + 1))
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                    covered = np.cumsum(gone)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    n_words.append(n)
                    n_removed.append(int(covered.sum()))
                    stay = np.flatnonzero(~covered) + a
                    kept.append(b" ".join([data[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist())]).decode())
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()),
                                              pa.array(kept, type=pa.string()), pa.array(spans, type=kind)], names=[id_col, "n_words", "n_removed", "kept", "spans"])

    from pyspark.sql import types as T
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, both.schema["__id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(span))])
    return both.mapInArrow(run, schema)


def repeat_digest(dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return dropped.select(F.col(f"`{id_col}`"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_repeats"))
