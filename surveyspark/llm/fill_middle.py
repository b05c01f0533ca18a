"""Fill-in-middle transformation: texts cut into prefix, middle and suffix and put in another order.

A text is a row of units: code points, or lines (each with its line feed).  The
byte offsets where units begin, and the end of the text, form a boundary set in
compressed containers of 2^16 offsets each: a sorted array, a bitmap or runs,
whichever is smallest.  Cumulative cardinalities tell which container holds the
k-th boundary; a local select in that container gives its byte offset.  Both cuts
of a document are two such selects.

Cuts and form come from the hash of a seed and the decimal id, so they don't
depend on partitions, order or other rows.  A text that holds one of the markers
stays as it is (plain); the others can be rebuilt exactly from output and form.

A null text counts as empty; an empty text is plain; a null id hashes as no
digits; repeated rows are cut alike; input columns whose names begin with ``__``
are not carried, all others are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.tables import plain
from surveyspark.llm.words import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed by the contract.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1:"
PLAIN_FROM, SPM_BELOW = 90, 20

#: Offsets per container, and the fixed costs in bytes that choose a container's kind.
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class Array:
    """Few boundaries: their sorted low bits."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """Many scattered boundaries: one bit for each offset, and bit counts up to each byte."""

    def __init__(self, mask: np.ndarray) -> None:
        self.bits = np.packbits(mask)
        self.upto = np.cumsum(_BITS[self.bits])

    def select(self, k: int) -> int:
        byte = int(np.searchsorted(self.upto, k, side="right"))
        before = int(self.upto[byte - 1]) if byte else 0
        return 8 * byte + int(np.flatnonzero(np.unpackbits(self.bits[byte:byte + 1]))[k - before])


class Runs:
    """Stretches of consecutive boundaries: their starts and the boundaries before each."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = starts.astype(np.uint16)
        self.before = np.cumsum(lengths) - lengths

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class Boundaries:
    """A set of offsets: containers, and the number of boundaries up to the end of each."""

    __slots__ = ("high", "containers", "upto")

    def __init__(self, mask: np.ndarray) -> None:
        """From one truth value for each offset."""
        self.high: list[int] = []
        self.containers: list[Array | Bitmap | Runs] = []
        sizes = []
        for start in range(0, len(mask), SPAN):
            part = mask[start:start + SPAN]
            n = int(np.count_nonzero(part))
            if n:
                self.high.append(start)
                self.containers.append(container(part, n))
                sizes.append(n)
        self.upto = np.cumsum(np.array(sizes, dtype=np.int64))

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th offset in order, from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        return self.high[at] + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def container(mask: np.ndarray, n: int) -> Array | Bitmap | Runs:
    """The smallest of the three kinds for the n set places of a mask."""
    if n == len(mask):
        return Runs(np.zeros(1, dtype=np.int64), np.array([n], dtype=np.int64))
    rises = np.flatnonzero(mask[1:] & ~mask[:-1]) + 1
    n_runs = len(rises) + int(mask[0])
    if 4 * n_runs <= min(2 * n, BITMAP_BYTES):
        starts = np.concatenate([[0], rises]) if mask[0] else rises
        falls = np.flatnonzero(mask[:-1] & ~mask[1:]) + 1
        ends = np.concatenate([falls, [len(mask)]]) if mask[-1] else falls
        return Runs(starts, ends - starts)
    if 2 * n <= BITMAP_BYTES:
        return Array(np.flatnonzero(mask))
    return Bitmap(mask)


def starts_of_units(data: np.ndarray, unit: str) -> np.ndarray:
    """Truth values for each byte offset and the end of a text: does a unit begin there (the end always counts)?"""
    mask = np.ones(len(data) + 1, dtype=bool)
    if unit == "char":
        mask[:-1] = (data & 0xC0) != 0x80
    elif unit == "line":
        mask[1:-1] = data[:-1] == 10
    else:
        raise ValueError(f"Unknown unit: {unit}")
    return mask


def cut_text(data: bytes, h1: int, h2: int, h3: int, h4: int, unit: str = "char") -> tuple[int, str, bytes, bytes, bytes, bytes]:
    """(units, form, prefix, middle, suffix, output) of one text."""
    bounds = Boundaries(starts_of_units(np.frombuffer(data, dtype=np.uint8), unit))
    n = len(bounds) - 1 if data else 0
    if not data or h3 % 100 >= PLAIN_FROM or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", b"", b"", b"", data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = bounds.select(low), bounds.select(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", prefix, middle, suffix, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", prefix, middle, suffix, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, unit: str = "char") -> DataFrame:
    """The input's columns, __n (units), __form, __prefix_chars, __middle_chars (code points; null if plain) and __output."""
    docs = plain(docs)
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    words = [F.conv(F.substring("__digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]
    keyed = docs.withColumn("__digest", digest).select(*[F.col(f"`{c}`") for c in docs.columns], *words)
    at, n_in = docs.columns.index(text_col), len(docs.columns)
    extra = [T.StructField("__n", T.LongType()), T.StructField("__form", T.StringType()), T.StructField("__prefix_chars", T.LongType()),
             T.StructField("__middle_chars", T.LongType()), T.StructField("__output", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.large_binary())
            rows = [cut_text(t.as_py() or b"", *h, unit) for t, *h in zip(texts, *(b.column(n_in + k).to_pylist() for k in range(4)))]
            chars = [(None, None) if form == "plain" else (n_chars(prefix), n_chars(middle)) for _, form, prefix, middle, _, _ in rows]
            out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([c[0] for c in chars], pa.int64()),
                   pa.array([c[1] for c in chars], pa.int64()), pa.array([r[5] for r in rows], pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_in], *out], names=[*b.schema.names[:n_in], *(f.name for f in extra)])

    return keyed.mapInArrow(run, schema)


def n_chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that an output of this form was made of; markers stand where the text itself has none, so they part it."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output))


def middle_digest(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Units, form and cuts; digests of the output and of the text rebuilt from it."""
    return cut.select(F.col(f"`{id_col}`"), F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"),
                      F.col("__middle_chars").alias("middle_chars"), F.sha2("__output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("__output"), F.col("__form")), 256).alias("restored_sha256"))
