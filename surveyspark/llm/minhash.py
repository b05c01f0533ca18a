"""MinHash near-dedup: many universal hash minima, banding, signature check, exact check, connected components.

1. Each text's set of k-word shingles gets a 128-bit identity and ``MINIMA``
   minima of universal hashes.  Texts with equal sets are one class.
2. Classes that agree in all rows of a band share a bucket.  Within a bucket no
   pairs are listed at first: every class is compared with the least one, which
   connects most of the bucket.
3. Where a bucket still holds several components, its classes are compared in
   blocks of ``BLOCK`` signatures, inside a task.  One link is enough to join two
   components, so the first round checks only the most alike pair of each two;
   the second lists what is then still apart and alike by a longer signature.
   A pair is listed in the first band that it shares only.  A block meets itself
   where it lies; only different blocks of one bucket are joined.
4. Compared pairs pass the signature check (estimate not far below the
   threshold), then the exact check on full shingle sets.
5. Components come from alternating large-star and small-star steps; later
   rounds join components of the rounds before, not their members.

With 32 bands of 4 rows a pair at similarity 0.8 is missed with probability
(1 - 0.8^4)^32 < 1e-7; the signature check loses one with probability < 1e-6.

Null and empty texts have an empty set: they are linked with nothing and kept.
Rows with a null id are linked with nothing (component null, kept).  Rows that
share an id and a text share everything; extra columns take no part.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.components import components
from surveyspark.llm.tables import documents, plain, written
from surveyspark.llm.words import SLICE_BYTES, Words, bounded_batches, grams, mix, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Minima a signature has (16 bits each); the first BANDS * ROWS make the bands.
MINIMA = 256
BANDS, ROWS = 32, 4
#: Five standard deviations of an estimate of 0.8 from 256 minima.
MARGIN = 0.125
#: More minima (8 bits each) for classes whose pairs must be listed, and the margin of five deviations of both together.
FINE = 512
FINE_MARGIN = 0.073
#: Classes whose signatures are compared at once in a task.
BLOCK = 512
_RNG = np.random.default_rng(9_973)
_A = _RNG.integers(0, 2**63, MINIMA + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, MINIMA + FINE, dtype=np.uint64)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the distinct shingles of every text, sorted within a text.

    A text with fewer than k words but at least one has one shingle, all its words.
    """
    h, at = grams(words, k)
    text = np.searchsorted(words.first, at, side="right") - 1
    n = np.diff(words.first)
    for r in np.flatnonzero((n > 0) & (n < k)).tolist():
        own = words.hashes[words.first[r]:words.first[r + 1]]
        one = np.array([len(own)], dtype=np.uint64)
        for j in range(len(own)):
            one = mix(one * np.uint64(31) + own[j:j + 1])
        h, text = np.append(h, one), np.append(text, r)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def signatures(h: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size, identity 1, identity 2, minima as uint16) of each text; texts without shingles have size 0."""
    size = np.bincount(text, minlength=n_texts)
    c1, c2 = np.zeros(n_texts, dtype=np.uint64), np.zeros(n_texts, dtype=np.uint64)
    minima = np.zeros((n_texts, MINIMA), dtype=np.uint16)
    some = np.flatnonzero(size)
    if len(some):
        start = (np.cumsum(size) - size)[some]
        c1[some] = mix(np.add.reduceat(mix(h + np.uint64(11)), start))
        c2[some] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), start) + size[some].astype(np.uint64))
        for j in range(MINIMA):                             # the low bits of a minimum are spread evenly, the high ones are not
            minima[some, j] = mix(np.minimum.reduceat(h * _A[j] + _B[j], start)) & np.uint64(0xFFFF)
    return size, c1.view(np.int64), c2.view(np.int64), minima


def signed(rows: DataFrame, k: int) -> DataFrame:
    """(id, c1, c2, n, sig) of every row of (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, w in slices(b.column(1), True):
                size, c1, c2, minima = signatures(*shingle_sets(w, k), end - row)
                sig = pa.array([x.tobytes() if s else None for x, s in zip(minima, size)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(c1), pa.array(c2), pa.array(size.astype(np.int64)), sig],
                                                 names=["id", "c1", "c2", "n", "sig"])

    return rows.mapInArrow(run, "id long, c1 long, c2 long, n long, sig binary")


def fine_signed(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, sig) of (node, text), with the fine minima behind the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, w in slices(b.column(1), True):
                h, text = shingle_sets(w, k)
                size, _, _, minima = signatures(h, text, end - row)
                fine = np.zeros((end - row, FINE), dtype=np.uint8)
                some = np.flatnonzero(size)
                start = (np.cumsum(size) - size)[some]
                for j in range(FINE if len(some) else 0):
                    fine[some, j] = mix(np.minimum.reduceat(h * _A[MINIMA + j] + _B[MINIMA + j], start)) & np.uint64(0xFF)
                sig = pa.array([x.tobytes() + y.tobytes() for x, y in zip(minima, fine)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(size.astype(np.int64)), sig], names=["node", "n", "sig"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, sig binary")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(m, BANDS) bucket keys of m signatures."""
    rows = sig[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + rows[:, :, j])
    return key


def unpacked(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, MINIMA)


def split_signatures(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Minima and fine minima (no columns where there are none) of signatures of one kind."""
    rows = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), -1)
    return np.ascontiguousarray(rows[:, :2 * MINIMA]).view(np.uint16), rows[:, 2 * MINIMA:]


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, node): one row for each band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = band_keys(unpacked(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band", "node"])

    return classes.select("node", "sig").mapInArrow(run, "band long, node long")


MEMBER = ("node", "n", "c", "sig")
PAIR = ("u", "v", "cu", "cv")


def alike_in_blocks(still: DataFrame, classes: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs (u, v, cu, cv) of nodes in one bucket and their components, which differ, that are alike by signature.

    ``still`` has (band, blocks, node, c).  Members of a bucket are dealt into blocks; each two blocks of a bucket meet
    in one row, and each block meets itself.  With ``best_only`` two blocks give at most one pair, the most alike, for each two components.
    """
    rows = still.join(classes.select("node", "n", "sig"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = written(rows.groupBy("band", "block", "blocks").agg(*[F.collect_list(x).alias(x) for x in MEMBER]), "near-blocks")
    own = dealt.select("band", *[F.col(x).alias(f"a_{x}") for x in MEMBER])
    left = dealt.where("block < blocks - 1").select("band", F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("with"), *[F.col(x).alias(f"a_{x}") for x in MEMBER])
    right = dealt.where("block > 0").select("band", F.col("block").alias("with"), *[F.col(x).alias(f"b_{x}") for x in MEMBER])

    def meet(sides: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for r in range(batch.num_rows):
                    a, b = ([batch.column(f"{side}_{x}")[r].values.to_numpy(zero_copy_only=x != "sig") for x in MEMBER] for side in sides)
                    found.append(pairs_of(batch.column("band")[r].as_py(), sides == "aa", a, b, percent, best_only))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=list(PAIR))

        return run

    pair = ", ".join(f"{x} long" for x in PAIR)
    return own.mapInArrow(meet("aa"), pair).unionByName(left.join(right, ["band", "with"]).drop("with").mapInArrow(meet("ab"), pair))


def pairs_of(band: int, same: bool, a: list[np.ndarray], b: list[np.ndarray], percent: int, best_only: bool) -> tuple[np.ndarray, ...]:
    """The alike pairs between two blocks (or within one) of a bucket; a block is its members' nodes, sizes, components and signatures."""
    (ia, na, ca, sa), (ib, nb, cb, sb) = a, b
    if len(np.unique(np.concatenate([ca, cb]))) < 2:
        return ia[:0], ib[:0], ca[:0], cb[:0]
    (sa, fa), (sb, fb) = (split_signatures(list(x)) for x in (sa, sb))
    ka, kb = band_keys(sa), band_keys(sb)
    us, vs, es = [], [], []
    for lo in range(0, len(ia), 32):
        hi = min(len(ia), lo + 32)
        fits = (ca[lo:hi, None] != cb[None, :]) & (100 * np.minimum(na[lo:hi, None], nb[None, :]) >= percent * np.maximum(na[lo:hi, None], nb[None, :]))
        if same:
            fits &= np.arange(lo, hi)[:, None] < np.arange(len(ib))[None, :]
        x, y = np.nonzero(fits)
        x += lo
        e = (sa[x] == sb[y]).mean(axis=1) if len(x) else np.zeros(0)
        near = e >= percent / 100 - MARGIN
        x, y, e = x[near], y[near], e[near]
        if fa.shape[1] and len(x):                          # equal low bytes by chance: one in 256
            f = ((fa[x] == fb[y]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            e = (MINIMA * e + FINE * f) / (MINIMA + FINE)
            near = e >= percent / 100 - FINE_MARGIN
            x, y, e = x[near], y[near], e[near]
        first = np.argmax(ka[x] == kb[y], axis=1) if len(x) else x
        here = ka[x, first].view(np.int64) == band if len(x) else np.zeros(0, dtype=bool)
        us.append(x[here]), vs.append(y[here]), es.append(e[here])
    x, y, e = np.concatenate(us), np.concatenate(vs), np.concatenate(es)
    if best_only and len(x):
        lo, hi = np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y])
        order = np.lexsort((y, x, -e, hi, lo))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
        x, y = x[order][new], y[order][new]
    return ia[x], ib[y], ca[x], cb[y]


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that pass the signature check."""
    sigs = classes.select("node", "sig")
    with_sigs = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, t = unpacked(b.column("su").to_pylist()), unpacked(b.column("sv").to_pylist())
                near = (s == t).mean(axis=1) >= percent / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(near))

    return with_sigs.select("u", "v", "su", "sv").mapInArrow(likely, "u long, v long")


def similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(cu, cv) as (u, v) of the pairs (u, v, cu, cv) whose full shingle sets have 100 * intersection >= percent * union."""
    both = written(pairs, "near-likely").join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = similar_rows(b.column("tu"), b.column("tv"), k, percent)
            yield pa.RecordBatch.from_arrays([b.column("cu"), b.column("cv")], names=["u", "v"]).filter(pa.array(keep))

    return both.select("cu", "cv", "tu", "tv").mapInArrow(exact, "u long, v long")


def similar_rows(tu: pa.Array, tv: pa.Array, k: int, percent: int) -> np.ndarray:
    """Whether the sets of the two texts of each row are similar; texts that near rows share are split once for about SLICE_BYTES of rows."""
    keep = np.zeros(len(tu), dtype=bool)
    upto = np.cumsum(pc.binary_length(tu).to_numpy().astype(np.int64) + pc.binary_length(tv).to_numpy())
    row = 0
    while row < len(tu):
        end = max(int(np.searchsorted(upto, (upto[row - 1] if row else 0) + SLICE_BYTES, side="right")), row + 1)
        both = pa.concat_arrays([x.slice(row, end - row).cast(pa.large_string()) for x in (tu, tv)]).dictionary_encode()
        sets = text_sets(both.dictionary, k)
        for r, (i, j) in enumerate(zip(*np.split(both.indices.to_numpy(), 2)), row):
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            keep[r] = 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared)
        row = end
    return keep


def text_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The set of shingles of each text."""
    sets: list[np.ndarray] = []
    for row, end, w in slices(texts, True):
        h, text = shingle_sets(w, k)
        sets += np.split(h, np.searchsorted(text, np.arange(1, end - row)))
    return sets


def moved(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows with their component c replaced by the one that it was joined to, if any."""
    to = joined.select(F.col("node").alias("c"), F.col("component").alias("to"))
    return rows.join(to, "c", "left").withColumn("c", F.coalesce("to", "c")).drop("to")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (the row's id is its component's)."""
    bounded_batches(docs.sparkSession)
    rows = documents(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed_rows = written(signed(rows, k), "near-signed")
    classes = written(signed_rows.where("n > 0 and id is not null").groupBy("c1", "c2")
                      .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    bands = band_rows(classes)
    buckets = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").drop("hi")
    members = written(bands.join(buckets, "band"), "near-members")
    involved = members.select("node").distinct()
    heads = rows.join(involved, rows["id"] == involved["node"], "left_semi")
    texts = written(heads.where("text is not null").select(F.col("id").alias("node"), "text").distinct(), "near-texts")

    least = members.select(F.col("lo").alias("u"), F.col("node").alias("v")).where("u < v").distinct()
    steps = [components(similar(alike(least, classes, percent).select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")), texts, k, percent))]
    where = members.select("band", "node", F.col("node").alias("c"))
    for best_only in (True, False):
        where = written(moved(where, steps[-1]).select("band", "node", "c"), "near-where")
        split = where.groupBy("band").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        still = where.join(split.where("c_lo < c_hi").select("band", "blocks"), "band")
        signed_nodes = classes if best_only else written(fine_signed(texts.join(still.select("node").distinct(), "node", "left_semi"), k), "near-fine")
        steps.append(components(similar(alike_in_blocks(still, signed_nodes, percent, best_only), texts, k, percent)))

    of_class = written(reduce(moved, steps, classes.select("c1", "c2", F.col("node").alias("c"))).select("c1", "c2", F.col("c").alias("component")), "near-components")
    joined = signed_rows.drop("sig").join(of_class, ["c1", "c2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), own)
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows without those that have a near copy with a smaller id; of rows that share an id, one of each kept text stays."""
    kept = near_components(docs, id_col, text_col, k, percent).where(f"kept and `{id_col}` is not null").select(F.col(f"`{id_col}`").cast("long").alias("__kept")).distinct()
    docs = plain(docs)
    with_id = docs.where(F.col(f"`{id_col}`").isNotNull())
    stay = with_id.join(kept, F.col(f"`{id_col}`").cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_col, text_col])
    return stay.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
