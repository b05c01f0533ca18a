"""Bloom filters of one fixed size, built by tasks and asked by tasks.

The size does not depend on the data (64 parts of 2^21 bits, 16 MB in all), so
it may be broadcast whatever the data; the more keys, the more often it says
"perhaps".  Every use is followed by an exact join or count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 64
BITS = 1 << 21


def places(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Part and three bit numbers of each 64-bit hash."""
    h = h.astype(np.uint64, copy=False)
    part = (h & np.uint64(PARTS - 1)).astype(np.int64)
    mask = np.uint64(BITS - 1)
    return part, [((h >> np.uint64(s)) & mask).astype(np.int64) for s in (6, 22, 43)]


def build(keys: DataFrame, column: str) -> np.ndarray:
    """PARTS bit maps over a column of 64-bit hashes; tasks send at most PARTS maps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            part, bits = places(b.column(0).to_numpy().view(np.uint64))
            for p in np.unique(part).tolist():
                own = maps.setdefault(p, np.zeros(BITS, dtype=bool))
                for x in bits:
                    own[x[part == p]] = True
        for p, own in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], type=pa.int32()), pa.array([np.packbits(own).tobytes()], type=pa.binary())], names=["part", "bits"])

    part = F.col(column).bitwiseAND(PARTS - 1)
    rows = keys.select(F.col(column), part.alias("part")).repartition(PARTS, "part").select(column).mapInArrow(run, "part int, bits binary").collect()
    out = np.zeros((PARTS, BITS // 8), dtype=np.uint8)
    for r in rows:
        out[r["part"]] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def perhaps(maps: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False where a hash is surely not among the keys."""
    part, bits = places(h)
    out = np.ones(len(h), dtype=bool)
    for x in bits:
        out &= (maps[part, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
    return out
