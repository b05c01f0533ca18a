"""Word splitting and hashing of whole text columns with numpy, inside Spark tasks.

Every function works on one Arrow batch of texts and allocates in proportion
to :data:`SLICE_BYTES` (or to the one longest text), never to the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows in an Arrow batch and text bytes handled at once inside a task.
BATCH_ROWS = 1_000
SLICE_BYTES = 2_000_000

#: Fixed by the contracts: the white space between words.
WHITE = b" \t\n\x0b\x0c\r"

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply and xor-shift rounds)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    """1, base, base^2, ... as n wrapping 64-bit values."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts, end to end: byte ranges, hashes and, for each text, its range of words."""

    __slots__ = ("data", "starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        white = _IS_WHITE[data]
        if lower:
            data = _LOWER[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = white[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = white[1:]
        solid = ~white
        self.data = data
        self.starts = np.flatnonzero(solid & (before | edge[:n]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lens = self.ends - self.starts
        if not len(lens):
            self.hashes = np.zeros(0, dtype=np.uint64)
            return
        at = np.cumsum(lens) - lens
        inner = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        value = _BYTE[data[solid]] * powers(int(lens.max()))[inner]
        self.hashes = mix(np.add.reduceat(value, at) + lens.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.first) - 1


def slices(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over consecutive rows of about SLICE_BYTES each; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        lo, hi = offsets[row], offsets[end]
        yield row, end, Words(data[lo:hi], offsets[row:end + 1] - lo, lower)
        row = end


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the index of each run's first word, in text order."""
    n = len(words.hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    p = powers(k, np.uint64(0xD6E8FEB86659FD93))
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        h += words.hashes[j:n - k + 1 + j] * p[j]
    ok = np.ones(n + 1, dtype=bool)
    starts, lens = words.first[:-1], np.diff(words.first)
    for j in range(1, k):                       # a run may not begin within the last k - 1 words of its text
        cut = starts + lens - j
        ok[cut[(lens >= j)]] = False
    at = np.flatnonzero(ok[:n - k + 1])
    return mix(h[at]), at


def text_of_rows(counts: np.ndarray) -> np.ndarray:
    """Row number of each element, from the number of elements in each row."""
    return np.repeat(np.arange(len(counts)), counts)


def bounded_batches(spark) -> None:
    """Keep Arrow batches to BATCH_ROWS rows, so that very long texts fit a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
