"""Byte-level BPE encoding and decoding, merges found with a segment tree.

The vocabulary file gives byte symbols, ranked merges and added tokens.  A text
is cut at the added tokens, then into words; a word starts as its bytes.  Over
the ranks of all adjacent pairs of a word stands a segment tree of minima: its
root is the lowest rank and, among equal ranks, the leftmost place.  That pair
is merged; the two pairs that touch it and the one that vanishes are updated on
their way up the tree, until the root holds no mergeable pair.

Equal words have equal ids, so a task encodes each distinct word once (its cache
is emptied when full): all words of one length together, as trees side by side
in numpy; words of more than ``LONG_WORD`` bytes one by one.

A null or empty text has no ids and decodes to an empty text; the strings of
added tokens in a text become those tokens; ids that the file does not know
decode to nothing; repeated rows are encoded each; input columns whose names
begin with ``__`` are not carried, all others are.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.tables import plain
from surveyspark.llm.words import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed by the format: how a text is cut into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that Unicode added after version 16, which the public tokenizers do not know as such.
NEW_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    r"\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F")
NEW_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"

_NEW = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")
_WORDS = regex.compile(WORD.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
_OLD_WORDS = regex.compile(WORD.replace(r"[^\s{L}{N}]", rf"(?:[{NEW_LETTERS}{NEW_NUMBERS}]|[^\s\p{{L}}\p{{N}}])")
                           .replace("{L}", rf"[\p{{L}}--[{NEW_LETTERS}]]").replace("{N}", rf"[\p{{N}}--[{NEW_NUMBERS}]]"), regex.V1)

#: No pair: greater than every rank and place.
NONE = np.int64(1) << 62
PLACE_BITS = 31
LONG_WORD = 128
TABLE_CELLS = 1_000_000
CACHED_WORDS = 400_000
#: Characters of short texts, and words of a long one, that are looked up at once.
CHARS_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 200_000


def byte_symbols() -> dict[str, int]:
    """The format's printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    out.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(own)))
    return out


class Merges:
    """A vocabulary: ids of the bytes, ranked merges, bytes of every id, added tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> None:
        as_byte = byte_symbols()
        self.added = added
        self.width = max([*vocab.values(), *added.values()]) + 1
        self.surface = [b""] * self.width
        for token, i in vocab.items():
            self.surface[i] = bytes(map(as_byte.__getitem__, token))
        for token, i in added.items():
            self.surface[i] = token.encode()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for char, b in as_byte.items():
            self.byte_id[b] = vocab[char]
        table = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        rows = sorted((a * self.width + b, rank, new) for (a, b), (rank, new) in table.items())
        self.pairs = np.array([r[0] for r in rows] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.ranks = np.array([r[1] for r in rows] + [0], dtype=np.int64)
        self.merged = np.zeros(len(merges) + 1, dtype=np.int64)
        for _, rank, new in rows:
            self.merged[rank] = new
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def load(path: str) -> Merges:
        """Reads the vocabulary file (on the driver); files that ask for anything but plain byte-level BPE are refused."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain_bpe = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain_cut = before["type"] == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"] and spec["normalizer"] is None
        if not (plain_bpe and plain_cut) or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"Not a plain byte-level BPE vocabulary: {path}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return Merges(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    # --- one pair ----------------------------------------------------------
    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree entries of pairs: rank, then place; NONE for pairs that do not merge or have a side off the word (-1)."""
        key = left * self.width + right
        at = np.searchsorted(self.pairs, key)
        known = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at] << PLACE_BITS | place, NONE)

    # --- all words of one length ------------------------------------------
    def encode_table(self, table: np.ndarray) -> list[bytes]:
        """The ids (as int32 bytes) of m words of n bytes each, given as an (m, n) table; one tree per row."""
        m, n = table.shape
        size = 1 << (n + 1).bit_length()
        symbol = np.full((n + 2, m), -1, dtype=np.int64)           # places 1 to n; off the word: -1
        symbol[1:n + 1] = self.byte_id[table].T
        after = np.repeat(np.arange(1, n + 3)[:, None], m, axis=1)
        before = after - 2
        tree = np.full((2 * size, m), NONE, dtype=np.int64)
        tree[size + 1:size + n] = self.leaves(symbol[1:n], symbol[2:n + 1], np.arange(1, n)[:, None])
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        row = np.arange(m)
        while True:
            root = tree[1, row]
            go = root < NONE
            row, root = row[go], root[go]
            if not len(row):
                break
            at = root & ((1 << PLACE_BITS) - 1)
            gone = after[at, row]
            symbol[at, row], symbol[gone, row] = self.merged[root >> PLACE_BITS], -1
            right, left = after[gone, row], before[at, row]
            after[at, row], before[right, row] = right, at
            tree[size + gone, row] = NONE
            tree[size + at, row] = self.leaves(symbol[at, row], symbol[right, row], at)
            tree[size + left, row] = self.leaves(symbol[left, row], symbol[at, row], left)
            k = np.stack([gone, at, left]) + size
            while k[0, 0] > 1:
                k >>= 1
                tree[k, row] = np.minimum(tree[2 * k, row], tree[2 * k + 1, row])
        whole = symbol[1:n + 1].T
        left_over = whole >= 0
        flat = whole[left_over].astype(np.int32).tobytes()
        ends = (np.cumsum(left_over.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    # --- one long word -----------------------------------------------------
    def encode_long(self, data: bytes) -> bytes:
        """The same for one word; a path up the tree ends where a minimum does not change."""
        n = len(data)
        size = 1 << (n + 1).bit_length()
        start = np.full(n + 2, -1, dtype=np.int64)
        start[1:n + 1] = self.byte_id[np.frombuffer(data, dtype=np.uint8)]
        levels = [np.full(size, NONE, dtype=np.int64)]
        levels[0][1:n] = self.leaves(start[1:n], start[2:n + 1], np.arange(1, n))
        while len(levels[0]) > 1:
            levels.insert(0, levels[0].reshape(-1, 2).min(axis=1))
        tree = [int(NONE), *np.concatenate(levels).tolist()]
        symbol, after, before = start.tolist(), list(range(1, n + 3)), list(range(-1, n + 1))
        ranks = dict(zip(self.pairs[:-1].tolist(), self.ranks[:-1].tolist()))
        merged, width, none = self.merged.tolist(), self.width, int(NONE)

        def put(place: int, a: int, b: int) -> None:
            rank = ranks.get(a * width + b) if a >= 0 and b >= 0 else None
            k = size + place
            tree[k] = none if rank is None else rank << PLACE_BITS | place
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while (root := tree[1]) < none:
            at = root & ((1 << PLACE_BITS) - 1)
            gone = after[at]
            right, left = after[gone], before[at]
            symbol[at], symbol[gone] = merged[root >> PLACE_BITS], -1
            after[at], before[right] = right, at
            put(gone, -1, -1)
            put(at, symbol[at], symbol[right])
            put(left, symbol[left], symbol[at])
        return np.array([s for s in symbol if s >= 0], dtype=np.int32).tobytes()

    # --- texts ---------------------------------------------------------------
    def words_of(self, text: str) -> Iterator[list[str]]:
        """The words and added tokens of a text, in lists of bounded length."""
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.added:
                yield [piece]
                continue
            pattern = _OLD_WORDS if not piece.isascii() and _NEW.search(piece) else _WORDS
            if len(piece) <= CHARS_AT_ONCE:
                yield pattern.findall(piece)
                continue
            found = pattern.finditer(piece)
            while words := [m[0] for m in islice(found, WORDS_AT_ONCE)]:
                yield words

    def look_up(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of words; each new word is encoded once."""
        new = set().union(*lists).difference(self.cache)
        if len(self.cache) + len(new) > CACHED_WORDS:
            new = set().union(*lists)
            self.cache.clear()
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            data = w.encode()
            if w in self.added:
                self.cache[w] = np.int32(self.added[w]).tobytes()
            elif len(data) > LONG_WORD:
                self.cache[w] = self.encode_long(data)
            else:
                by_length.setdefault(len(data), []).append((w, data))
        for n, pairs in by_length.items():
            step = max(1, TABLE_CELLS // (4 * n + 4))
            for k in range(0, len(pairs), step):
                part = pairs[k:k + step]
                table = np.frombuffer(b"".join(d for _, d in part), dtype=np.uint8).reshape(-1, n)
                self.cache.update(zip((w for w, _ in part), self.encode_table(table)))
        return [b"".join(map(self.cache.__getitem__, words)) for words in lists]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; short texts are looked up together, of a long one a bounded list of words at a time."""
        out: list[bytes] = []
        row = 0
        while row < len(texts):
            end, size = row + 1, len(texts[row])
            while end < len(texts) and size + len(texts[end]) <= CHARS_AT_ONCE:
                size += len(texts[end])
                end += 1
            if size <= CHARS_AT_ONCE:
                out += self.look_up([[w for words in self.words_of(t) for w in words] for t in texts[row:end]])
            else:
                out.append(b"".join(self.look_up([words])[0] for words in self.words_of(texts[row])))
            row = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < self.width)]
        return b"".join(map(self.surface.__getitem__, known.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The input's columns and __ids, the token ids of the text (none for a null one)."""
    docs = plain(docs)
    bounded_batches(docs.sparkSession)
    merges = docs.sparkSession.sparkContext.broadcast(Merges.load(model))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = merges.value.encode([t or "" for t in b.column(at).to_pylist()])
            offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), type=pa.int32())
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, values)], names=[*b.schema.names, "__ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The input's columns, __decoded (the text that __ids stand for) and __ids_sha256 (of the ids as little-endian 32-bit integers)."""
    merges = encoded.sparkSession.sparkContext.broadcast(Merges.load(model))
    at = encoded.columns.index("__ids")
    extra = [T.StructField("__decoded", T.StringType()), T.StructField("__ids_sha256", T.StringType())]
    schema = T.StructType([*encoded.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.values.to_numpy(zero_copy_only=False).astype("<i4") if x.is_valid else np.zeros(0, dtype="<i4") for x in b.column(at)]
            texts = pa.array([merges.value.decode(x) for x in ids], type=pa.string())
            sums = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], type=pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts, sums], names=[*b.schema.names, "__decoded", "__ids_sha256"])

    return encoded.mapInArrow(run, schema)


def token_digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number and digest of the ids, digest of the decoded text."""
    return decoded.select(F.col(f"`{id_col}`"), F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids_sha256").alias("ids_sha256"),
                          F.sha2("__decoded", 256).alias("decoded_sha256"))
