"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

Distances count words.  For an item of n words, a passage matches if it is at
most ``max_edit * n`` word edits away.

1. Windows: places where enough of the item's word q-grams stand near one
   diagonal (the q-gram lemma: fewer cannot be within the distance) give
   item-sized windows of the text.
2. CGK embedding: windows and items are walked with the same random bits, each
   step writing the current word and moving on or not; few edits then mean few
   differing places of the 3n that are written.
3. Bit-sampling LSH: ``repetitions`` walks, each sampled at ``sampled`` places;
   a window meets an item if all sampled places of one walk agree.
4. Exact check: the edit distance between the item and the best passage around
   the window.

The index goes to the tasks in blocks of items with at most ``BLOCK_WORDS``
words each, whatever the size of the benchmark; documents are never shuffled.

Null and empty texts match nothing; null and empty items are no items; ids may
be null or repeated (rows are handled one by one); equal items all match.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.tables import plain, written
from surveyspark.llm.words import Words, bounded_batches, grams, mix, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_EDIT = 0.2
REPETITIONS = 48
SAMPLED = 2
BLOCK_WORDS = 1_000_000
SEED = 41
#: Windows that walk together; bounds the tables of one step.
WINDOWS_AT_ONCE = 2_000


def limits(n: int, max_edit: float) -> tuple[int, int, int]:
    """(edits, q, least shared q-grams) for an item of n words; q is the largest up to 3 that still needs a shared one."""
    e = int(max_edit * n + 1e-9)
    for q in (3, 2, 1):
        if (least := n - q + 1 - q * e) >= 1:
            return e, q, least
    return e, 1, 1


def sample_steps(n: int, repetitions: int, sampled: int) -> np.ndarray:
    """(repetitions, sampled) sampled places of the 3n that a walk over n words writes, ascending.

    Walks take two steps a word on average.  Places past their end would agree for all pairs, so the first 1.6n are used.
    """
    rng = np.random.default_rng([SEED, n])
    return np.sort(np.stack([rng.choice(max(8 * n // 5, sampled), size=sampled, replace=False) for _ in range(repetitions)]), axis=1)


def embed(windows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The words that the CGK walks write at their sampled steps: (repetitions, m, sampled) for an (m, n) table of word
    hashes.  All walks of all windows move together; each repetition has random bits of its own."""
    (m, n), (repetitions, sampled) = windows.shape, steps.shape
    at = np.zeros((repetitions, m), dtype=np.int64)
    cells = np.arange(m) * n
    flat = windows.reshape(-1)
    salt = mix(np.arange(1, repetitions + 1, dtype=np.uint64) * np.uint64(1_000_003 + SEED))[:, None]
    out = np.zeros((repetitions, m, sampled), dtype=np.uint64)
    for step in range(int(steps.max()) + 1):
        word = np.where(at < n, flat[cells + np.minimum(at, n - 1)], np.uint64(0))
        for j in range(sampled):
            here = np.flatnonzero(steps[:, j] == step)
            out[here, :, j] = word[here]
        at += (mix(word + salt + np.uint64(7_919 * step)) & np.uint64(1)).astype(np.int64)
    return out


def keys(windows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(repetitions, m) LSH keys."""
    out = embed(windows, steps)
    h = np.broadcast_to(np.arange(1, len(steps) + 1, dtype=np.uint64)[:, None], out.shape[:2])
    for j in range(out.shape[2]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + out[:, :, j])
    return h


def passage_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between the item and any stretch of the text (one table row for each item word)."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        up = row + 1
        up[1:] = np.minimum(up[1:], row[:-1] + (text != word))
        up[0] = i
        row = np.minimum.accumulate(up - place) + place     # insertions run on from the left
    return int(row.min())


class Index:
    """What tasks need to know of a block of items."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float, repetitions: int, sampled: int) -> None:
        self.max_edit = max_edit
        self.ids, self.words = [], []
        seeds: dict[int, list[tuple[int, int, int]]] = {1: [], 2: [], 3: []}
        for item_id, text in items:
            for _, _, w in slices(pa.array([text]), True):
                n = len(w.hashes)
                if not n:
                    continue
                q = limits(n, max_edit)[1]
                g, at = grams(w, q)
                seeds[q] += [(int(h), len(self.ids), int(a)) for h, a in zip(g, at)]
                self.ids.append(item_id)
                self.words.append(w.hashes)
        self.seeds = {}
        for q, rows in seeds.items():
            if rows:
                rows.sort()
                h, item, at = (np.array(c, dtype=t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
                sieve = np.zeros(1 << 21, dtype=bool)
                sieve[(h & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
                self.seeds[q] = (h, item, at, sieve)
        self.steps: dict[int, np.ndarray] = {}
        self.buckets: dict[int, dict[int, list[int]]] = {}
        for n in {len(x) for x in self.words}:
            own = [i for i, x in enumerate(self.words) if len(x) == n]
            self.steps[n] = sample_steps(n, repetitions, sampled)
            bucket = self.buckets[n] = {}
            for row in keys(np.stack([self.words[i] for i in own]), self.steps[n]).tolist():
                for k, i in zip(row, own):
                    bucket.setdefault(k, []).append(i)
        self.known = {n: np.array(sorted(b), dtype=np.uint64) for n, b in self.buckets.items()}
        self.lengths = np.array([len(x) for x in self.words], dtype=np.int64)
        self.limits = np.array([limits(len(x), max_edit) for x in self.words], dtype=np.int64).reshape(-1, 3)

    def windows(self, w: Words) -> dict[int, np.ndarray]:
        """Item length -> sorted distinct (first word of the window in the slice) over all texts of the slice."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (h, item, at, sieve) in self.seeds.items():
            g, place = grams(w, q)
            near = np.flatnonzero(sieve[(g & np.uint64((1 << 21) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(h, g[near]), np.searchsorted(h, g[near], side="right")
            near, lo, count = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(near):
                continue
            row = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            p = np.repeat(place[near], count)
            doc = np.searchsorted(w.first, p, side="right") - 1
            diag, it = p - at[row], item[row]
            order = np.lexsort((diag, it, doc))
            doc, it, diag = doc[order], it[order], diag[order]
            n, lim = self.lengths[it], self.limits[it]
            edits, least = lim[:, 0], lim[:, 2]
            # enough hits of this text and item with diagonals in [d, d + 2 * edits]: compare with the least-th next hit
            ok = np.zeros(len(diag), dtype=bool)
            for k in np.unique(least):
                mine = np.flatnonzero(least == k)
                last = mine + k - 1
                mine, last = mine[last < len(diag)], last[last < len(diag)]
                good = (doc[last] == doc[mine]) & (it[last] == it[mine]) & (diag[last] - diag[mine] <= 2 * edits[mine])
                for a, b in zip(mine[good], last[good]):
                    ok[a:b + 1] = True
            for length in np.unique(n[ok]):
                at_len = ok & (n == length)
                start = np.clip(diag[at_len], w.first[doc[at_len]], np.maximum(w.first[doc[at_len] + 1] - length, w.first[doc[at_len]]))
                found.setdefault(int(length), []).append(start)
        return {n: np.unique(np.concatenate(s)) for n, s in found.items()}

    def matches(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(text of the slice, item, first word of the window in that text, distance) of every match, the nearest passage each."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, starts in self.windows(w).items():
            doc = np.searchsorted(w.first, starts, side="right") - 1
            span = starts[:, None] + np.arange(n)
            inside = span < w.first[doc + 1][:, None]
            table = np.where(inside, w.hashes[np.minimum(span, len(w.hashes) - 1)], np.uint64(0))
            met: set[tuple[int, int]] = set()
            for lo in range(0, len(table), WINDOWS_AT_ONCE):
                k = keys(table[lo:lo + WINDOWS_AT_ONCE], self.steps[n])
                hit = np.isin(k, self.known[n])
                for j, key in zip((np.nonzero(hit)[1] + lo).tolist(), k[hit].tolist()):
                    met.update((j, i) for i in self.buckets[n][key])
            edits = limits(n, self.max_edit)[0]
            for (d, i), group in itertools.groupby(sorted((int(doc[j]), i, int(starts[j])) for j, i in met), key=lambda x: x[:2]):
                first, lo, hi = -1, 0, -1
                for _, _, s in [*group, (0, 0, None)]:      # windows that overlap are checked as one passage
                    if s is not None and first >= 0 and s - 2 * edits <= hi:
                        hi = s + n + 2 * edits
                        continue
                    if first >= 0:
                        passage = w.hashes[max(int(w.first[d]), lo):min(int(w.first[d + 1]), hi)]
                        distance = passage_distance(self.words[i], passage)
                        if distance <= edits and (distance, first) < best.get((d, i), (edits + 1, 0)):
                            best[d, i] = (distance, first)
                    if s is not None:
                        first, lo, hi = s, s - 2 * edits, s + n + 2 * edits
        return sorted((d, i, s - int(w.first[d]), e) for (d, i), (e, s) in best.items())


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[list[tuple[int, str]]]:
    """The benchmark's items in blocks; only one block at a time is on the driver."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null and i is not null")
    words = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // block_words))
    for k in range(n):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               max_edit: float = MAX_EDIT, repetitions: int = REPETITIONS, sampled: int = SAMPLED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The input's rows and columns plus __leaks: an array of (item_id, first_word, distance) of the items found in the text
    (input names that begin with ``__`` are not carried).  Only one block's index is held at a time: what the blocks before
    it found is written first."""
    docs, spark = plain(docs), docs.sparkSession
    bounded_batches(spark)
    leak = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("distance", T.LongType())])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("distance", pa.int64())]))
    out = docs.withColumn("__leaks", F.array().cast(T.ArrayType(leak)))
    at, index = docs.columns.index(text_col), None
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        if not block:
            continue
        if index is not None:
            out = written(out, "leaks-so-far")
            index.destroy()
        index = spark.sparkContext.broadcast(Index(block, max_edit, repetitions, sampled))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaks = b.column(b.num_columns - 1).to_pylist()
                for row, _, words in slices(b.column(at), True):
                    for d, i, s, e in index.value.matches(words):
                        leaks[row + d] = [*leaks[row + d], {"item_id": index.value.ids[i], "first_word": s, "distance": e}]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(leaks, type=kind)], names=b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def leak_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document; kept is false if any item was found in it."""
    ids = F.array_sort(F.transform("__leaks", lambda x: x["item_id"]))
    return found.select(F.col(f"`{id_col}`"), (F.size("__leaks") == 0).alias("kept"), F.size("__leaks").cast("long").alias("n_items"), ids.alias("item_ids"),
                        F.array_min(F.transform("__leaks", lambda x: x["distance"])).alias("least_distance"))
