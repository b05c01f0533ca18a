"""SentencePiece unigram encoding (best-scoring segmentation) and decoding.

The vocabulary file gives pieces with log scores; a double-array trie over
their UTF-8 bytes finds all pieces that begin at a place.  The encoding of a
text is the segmentation with the largest sum of scores.  Characters that no
piece covers are written as byte pieces.  Spaces become the marker U+2581, one
marker is put before the text, and decoding takes it away again.

A marker begins every word and no piece goes on past one, so words are encoded
independently: each distinct word of an Arrow batch is encoded once, all words
of one length together in numpy (a Viterbi step for every place of all words).

A null text has null ids, an empty one none; a literal U+2581 in a text decodes
to a space (the format cannot tell them apart); extra columns stay as they are.
"""

from __future__ import annotations

import re
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

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed value of the format: how much worse than the worst piece an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Longer words are encoded one by one, so that the numpy tables stay small.
LONG_WORD = 96
TABLE_CELLS = 2_000_000


class Pieces:
    """A vocabulary: pieces, scores, byte pieces, and the double-array trie over the pieces."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: dict[int, int], unknown: int) -> None:
        self.unknown = unknown
        self.byte_ids = np.array([byte_ids.get(b, unknown) for b in range(256)], dtype=np.int32)
        self.has_bytes = len(byte_ids) == 256
        self.scores = np.array(scores, dtype=np.float64)
        self.unknown_score = float(min((s for s, ok in zip(scores, normal) if ok), default=0.0)) - UNKNOWN_PENALTY
        keyed = sorted((p.encode(), i) for i, (p, ok) in enumerate(zip(pieces, normal)) if ok and p)
        self.base, self.owner, self.value = build_trie(keyed)
        self.longest = max((len(k) for k, _ in keyed), default=1)
        mark = MARK.encode()
        self.by_words = not any(mark in k.lstrip(b"\xe2\x96\x81") and mark in k.decode().lstrip(MARK).encode() for k, _ in keyed)
        self.newline_alone = not any(b"\n" in k for k, _ in keyed)
        self.surface = [p.encode() for p in pieces]
        for b, i in byte_ids.items():
            self.surface[i] = bytes([b])
        as_byte = set(byte_ids.values())
        for i, ok in enumerate(normal):
            if not ok and i not in as_byte:
                self.surface[i] = " ⁇ ".encode() if i == unknown else b""

    @staticmethod
    def load(path: str) -> Pieces:
        """Reads the vocabulary file (on the driver)."""
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        return Pieces(names, [sp.get_score(i) for i in range(n)], normal, byte_ids, sp.unk_id())

    def chunks(self, text: str) -> list[str]:
        """The text, marked, in parts that are encoded independently."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.by_words:
            return [marked]
        return (CHUNK_LINES if self.newline_alone else CHUNK).findall(marked)

    # --- one word ---------------------------------------------------------
    def encode_one(self, chunk: str) -> list[int]:
        """Viterbi over one chunk; earlier starts win ties."""
        data = chunk.encode()
        n = len(data)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        base, owner, value, scores = self.base, self.owner, self.value, self.scores
        for s in range(n):
            if best[s] == -np.inf or data[s] & 0xC0 == 0x80:
                continue
            width = char_width(data[s])
            state, single = 0, False
            for e in range(s, n):
                to = int(base[state]) + data[e]
                if to >= len(owner) or owner[to] != state:
                    break
                state = to
                if value[state] >= 0:
                    single |= e + 1 - s == width
                    if (got := best[s] + scores[value[state]]) > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = got, s, int(value[state])
            if not single and (got := best[s] + self.unknown_score) > best[s + width]:
                best[s + width], back[s + width], piece[s + width] = got, s, -1
        out: list[int] = []
        e = n
        while e:
            s = back[e]
            out += [piece[e]] if piece[e] >= 0 else [int(self.byte_ids[b]) for b in reversed(data[s:e])] if self.has_bytes else [self.unknown]
            e = s
        return out[::-1]

    # --- all words of one length -------------------------------------------
    def encode_table(self, table: np.ndarray) -> list[bytes]:
        """The ids (as int32 bytes) of m chunks of n bytes each, given as an (m, n) table."""
        m, n = table.shape
        best = np.full((n + 1, m), -np.inf)
        back = np.zeros((n + 1, m), dtype=np.int16)
        piece = np.full((n + 1, m), -1, dtype=np.int32)
        best[0] = 0.0
        width = WIDTH[table]
        for s in range(n):
            live = np.flatnonzero((best[s] > -np.inf) & (width[:, s] > 0))
            if not len(live):
                continue
            state = np.zeros(len(live), dtype=np.int64)
            single = np.zeros(m, dtype=bool)
            rows = live
            for e in range(s, min(n, s + self.longest)):
                to = self.base[state] + table[rows, e]
                ok = to < len(self.owner)
                ok[ok] = self.owner[to[ok]] == state[ok]
                rows, state = rows[ok], to[ok]
                if not len(rows):
                    break
                ends = np.flatnonzero(self.value[state] >= 0)
                if len(ends):
                    r, v = rows[ends], self.value[state[ends]]
                    single[r[width[r, s] == e + 1 - s]] = True
                    got = best[s, r] + self.scores[v]
                    up = got > best[e + 1, r]
                    r, v = r[up], v[up]
                    best[e + 1, r], back[e + 1, r], piece[e + 1, r] = got[up], s, v
            lone = live[~single[live]]
            for w in np.unique(width[lone, s]) if len(lone) else ():
                r = lone[width[lone, s] == w]
                got = best[s, r] + self.unknown_score
                up = got > best[s + w, r]
                r = r[up]
                best[s + w, r], back[s + w, r], piece[s + w, r] = got[up], s, -1
        # walk back; an unknown character gives one id for each of its bytes
        rows, end = np.arange(m), np.full(m, n)
        who, where, ids = [], [], []
        while len(rows):
            start, p = back[end, rows].astype(np.int64), piece[end, rows]
            known = p >= 0
            who.append(rows[known]), where.append(start[known]), ids.append(p[known])
            if not known.all():
                r, s, e = rows[~known], start[~known], end[~known]
                if self.has_bytes:
                    for j in range(int((e - s).max())):
                        here = s + j < e
                        who.append(r[here]), where.append(s[here] + j), ids.append(self.byte_ids[table[r[here], s[here] + j]])
                else:
                    who.append(r), where.append(s), ids.append(np.full(len(r), self.unknown, dtype=np.int32))
            more = start > 0
            rows, end = rows[more], start[more]
        who_all = np.concatenate(who)
        order = np.lexsort((np.concatenate(where), who_all))
        flat = np.concatenate(ids)[order].astype(np.int32).tobytes()
        cut = (np.cumsum(np.bincount(who_all, minlength=m)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cut[:-1]], cut)]

    def encode_words(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of distinct chunks."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for c in chunks:
            data = c.encode()
            if len(data) > LONG_WORD:
                out[c] = np.array(self.encode_one(c), dtype=np.int32).tobytes()
            else:
                by_length.setdefault(len(data), []).append((c, data))
        for n, pairs in by_length.items():
            step = max(1, TABLE_CELLS // n)
            for k in range(0, len(pairs), step):
                part = pairs[k:k + step]
                table = np.frombuffer(b"".join(d for _, d in part), dtype=np.uint8).reshape(-1, n)
                out.update(zip((c for c, _ in part), self.encode_table(table)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of texts, as int32 bytes."""
        cut = [None if t is None else self.chunks(t) for t in texts]
        ids = self.encode_words(list({c for cs in cut if cs for c in cs}))
        return [None if cs is None else b"".join([ids[c] for c in cs]) for cs in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CHUNK_LINES = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, dtype=np.int64)


def char_width(first: int) -> int:
    return int(WIDTH[first])


def build_trie(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array over sorted keys: child = base[state] + byte, valid if owner[child] = state; value: the key's id or -1.

    A state with one child takes the first free cell; one with more is placed near the end, where cells are mostly free.
    """
    cells = 512 + 6 * sum(len(k) for k, _ in keys)
    base, owner, value = np.zeros(cells, np.int64), np.full(cells, -1, np.int64), np.full(cells, -1, np.int64)
    used = bytearray(cells)
    used[0] = 1
    top, tail = 1, 1                                        # cells in use end before top
    first_free = 1
    todo = [(0, 0, len(keys), 0)]                           # state, keys from, to, depth
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[lo][0]) == depth:
            value[state] = keys[lo][1]
            lo += 1
        if lo == hi:
            continue
        kids: list[tuple[int, int, int]] = []
        while lo < hi:
            byte, end = keys[lo][0][depth], lo
            while end < hi and keys[end][0][depth] == byte:
                end += 1
            kids.append((byte, lo, end))
            lo = end
        if len(kids) == 1:
            first_free = max(first_free, kids[0][0])
            while used[first_free]:
                first_free += 1
            b = first_free - kids[0][0]
        else:
            b = max(tail, 1)
            while any(used[b + k[0]] for k in kids):
                b += 1
            tail = max(tail, b - 256)
        base[state] = b
        for byte, i, j in kids:
            used[b + byte], owner[b + byte] = 1, state
            todo.append((b + byte, i, j, depth + 1))
            top = max(top, b + byte + 1)
    return base[:top].copy(), owner[:top].copy(), value[:top].copy()


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The input's columns and __ids, an array of piece ids (null for a null text); input names that begin with ``__`` are not carried."""
    docs = plain(docs)
    bounded_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pieces.value.encode(b.column(at).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 if x else 0 for x in ids)])
            offsets = pa.array(ends, type=pa.int32(), mask=np.array([*(x is None for x in ids), False]))
            values = pa.array(np.frombuffer(b"".join(x for x in ids if x), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, values)], names=[*b.schema.names, "__ids"])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The input's columns and __decoded, the text that __ids stand for."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    at = encoded.columns.index("__ids")
    schema = T.StructType([*encoded.schema.fields, T.StructField("__decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [pieces.value.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, type=pa.string())], names=[*b.schema.names, "__decoded"])

    return encoded.mapInArrow(run, schema)


def piece_digest(decoded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers and digests of the ids and of the decoded text, and whether that is the text (a literal marker counts as a space)."""
    text = F.replace(F.col(f"`{text_col}`"), F.lit(MARK), F.lit(" "))
    return decoded.select(F.col(f"`{id_col}`"), F.coalesce(F.size("__ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("__ids").alias("ids_hash"),
                          F.sha2("__decoded", 256).alias("decoded_sha256"), (F.col("__decoded") == text).alias("round_trip"))
