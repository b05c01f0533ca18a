"""Secret scan: fixed patterns, plus credential-context values that are costly to guess.

A value that stands in a credential context (``passphrase: ...``, ``Authorization:
Bearer ...``) is priced by the cheapest way to write it as consecutive words,
dates, repeats, keyboard walks and brute-force characters: a shortest path over
its characters, with repeats and walks of every length.  Values that need at
least ``10 ** min_log10`` guesses are reported as ``guess`` spans.

Words are a short list of usual password words and, after them, the corpus's own
most frequent words (all documents are counted, outside credential contexts), so
the ranks speak the corpus's languages.  At most ``words`` of them go to the tasks.

Null and empty texts have no spans; ids may be null or repeated (rows are
handled one by one); other columns of the input take no part.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.tables import documents, written
from surveyspark.llm.words import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "guess")

#: The base patterns, with the least length of what must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")      # AKIA[A-Z0-9]+ of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")             # [0-9a-f]+ of 24 or more

#: Names that announce a credential, and the value after them.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|bearer|authorization|(?:api|access|private|session)[_-]?key)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?(?:(?:bearer|basic|token)[\x20\t]+)?["']?([^\s"'<>,;]{6,})""", re.I | re.A)

#: Common password words, most usual first; the place in the list is the number of guesses.
COMMON_WORDS = (
    "password qwerty dragon monkey letmein baseball football master shadow michael jennifer superman trustno "
    "sunshine princess welcome login admin flower hello freedom whatever starwars batman summer winter spring "
    "autumn secret access love angel ninja killer pepper cookie cheese coffee silver golden orange purple "
    "banana computer internet server system root user guest test default changeme example sample token key "
    "pass word my the one two three four five six seven eight nine ten blue red green black white"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SUBSTITUTES = str.maketrans("4@3!10$57", "aaeiiosst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
MAX_PERIOD = 8
NEXT_SEGMENT = math.log10(2)


def _neighbours() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for r, row in enumerate(KEYBOARD):
        for c, key in enumerate(row):
            near = {row[c - 1]} if c else set()
            if c + 1 < len(row):
                near.add(row[c + 1])
            for rr in (r - 1, r + 1):
                if 0 <= rr < len(KEYBOARD):
                    near.update(KEYBOARD[rr][max(0, c - 1):c + 2])
            out[key] = near
    return {k: frozenset(v) for k, v in out.items()}


NEIGHBOURS = _neighbours()
LONGEST_WORD = 24
START_KEYS = math.log10(len(NEIGHBOURS))
TURN = math.log10(sum(map(len, NEIGHBOURS.values())) / len(NEIGHBOURS))


def char_cost(c: str) -> float:
    """log10 of the alphabet that a guesser must try for this character."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def ranked(words: list[str]) -> dict[str, float]:
    """log10 of the guesses that a word takes: its place, after the words before it."""
    out: dict[str, float] = {}
    for w in words:
        out.setdefault(w, math.log10(len(out) + 2))
    return out


RANKS = ranked(COMMON_WORDS)
#: Corpus words: at most this many, with at least so many occurrences.
WORDS, LEAST_COUNT = 20_000, 10
#: Steps of the counts' logarithmic scale to a doubling (64 doublings at most).
COUNT_STEPS = 32


def corpus_words(docs: DataFrame, text_col: str = "text", words: int = WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The ``words`` most frequent words (3 to ``LONGEST_WORD`` letters, lower case) of all documents, most frequent first, ties by
    word; values in a credential context aren't counted, so that copies of a leaked one do not make it a word."""
    text = F.lower(F.regexp_replace(F.col(f"`{text_col}`").cast("string"), "(?i)" + CONTEXT.pattern, " "))
    split = docs.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, LONGEST_WORD))
    counts = written(split.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "words")
    # the step of a fine logarithmic scale that holds the last of them: tasks send no more than what lies on or above it
    step = F.floor(F.log2(F.col("n").cast("double")) * COUNT_STEPS)
    above = 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        above += r["n"]
        if above >= words:
            counts = counts.where(step >= r["step"])
            break
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def folded(value: str) -> str:
    """Lower case, with as many characters."""
    lower = value.lower()
    return lower if len(lower) == len(value) else "".join(c.lower()[0] for c in value)


def pattern_segments(value: str, ranks: dict[str, float]) -> list[list[tuple[int, float]]]:
    """For each start, the (end, log10 guesses) of every word and date that begins there."""
    n = len(value)
    lower = folded(value)
    plain = lower.translate(SUBSTITUTES)
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            cost = ranks.get(lower[i:j])
            if cost is None and (cost := ranks.get(plain[i:j])) is not None:
                cost += math.log10(2)
            if cost is not None:
                out[i].append((j, cost + (math.log10(2) if value[i:j] != lower[i:j] else 0)))
        if value[i].isdigit() and (m := DATE.match(value, i)):
            year = abs(int((re.findall(r"(?:19|20)\d\d", m[0]) or ["2000"])[0]) - 2020)
            days = 0 if m.end() - i == 4 else math.log10(365)
            out[i].append((m.end(), math.log10(max(20, year)) + days + (math.log10(4) if m[1] or m[2] else 0)))
    return out


class Starts:
    """The places where a repeat or walk that is still going on may have begun, each with its cost without the length.

    The price of length, log10(end - start), grows ever more slowly: a start that costs no more than a later one at some
    end does so at every end after it, and one that is later and costs no more is always the better.  Starts that lose
    in either way are dropped, which leaves few however long the run.
    """

    def __init__(self) -> None:
        self.kept: list[tuple[int, float]] = []

    def add(self, start: int, cost: float) -> None:
        while self.kept and self.kept[-1][1] >= cost:
            self.kept.pop()
        self.kept.append((start, cost))

    def least(self, end: int) -> float:
        best, kept = math.inf, []
        for start, cost in self.kept:
            total = cost + math.log10(end - start)
            if total < best:
                best = total
                kept.append((start, cost))
        self.kept = kept
        return best


def log10_guesses(value: str, ranks: dict[str, float] = RANKS) -> float:
    """The least log10 cost over all ways to cut the value into segments; each segment after the first doubles it.

    Segments: words and dates; repeats of 1 to ``MAX_PERIOD`` characters, twice or more (one character: three times);
    walks over at least three neighbouring keys, priced by their straight runs and length; brute-force characters,
    of which those that follow one another are one segment.  Repeats and walks count at every length.
    """
    n = len(value)
    if not n:
        return 0.0
    lower = folded(value)
    patterns = pattern_segments(value, ranks)
    chars = [char_cost(c) for c in value]
    before = [0.0]                                          # cost of the first i characters one by one
    for c in chars:
        before.append(before[-1] + c)
    closed = [math.inf] * (n + 1)                           # best cost of the first i characters, ending with a pattern
    brute = [math.inf] * (n + 1)                            # ... ending with a brute-force character
    open_at = [0.0] * (n + 1)                               # ... before a next segment
    closed[0] = -NEXT_SEGMENT
    run = [0] * (MAX_PERIOD + 1)                            # run[p]: characters up to here that equal the one p before
    repeats: list[list[Starts]] = [[] for _ in range(MAX_PERIOD + 1)]
    walk_start, walks, turns = 0, Starts(), [0] * n         # turns[k]: changes of direction up to the step from k to k + 1
    for j in range(n + 1):
        if j:
            k = j - 2                                       # the step that ends with the last character
            if k >= 0 and lower[k + 1] in NEIGHBOURS.get(lower[k], ()):
                ahead = ord(lower[k + 1]) - ord(lower[k])
                turns[k] = turns[k - 1] + (ahead != ord(lower[k]) - ord(lower[k - 1])) if k > walk_start else 0
                if j - 3 >= walk_start:
                    walks.add(j - 3, open_at[j - 3] - TURN * turns[j - 3])
                    closed[j] = min(closed[j], START_KEYS + (1 + turns[k]) * TURN + walks.least(j))
            else:
                walk_start, walks = j - 1, Starts()
            for p in range(1, MAX_PERIOD + 1):
                if j - 1 < p or value[j - 1] != value[j - 1 - p]:
                    run[p], repeats[p] = 0, []
                    continue
                run[p] += 1
                first = j - (3 if p == 1 else 2) * p
                if first < j - run[p] - p:
                    continue
                if not repeats[p]:
                    repeats[p] = [Starts() for _ in range(p)]
                repeats[p][j % p].add(first, open_at[first])
                closed[j] = min(closed[j], before[j] - before[j - p] - math.log10(p) + repeats[p][j % p].least(j))
        open_at[j] = min(closed[j], brute[j]) + NEXT_SEGMENT
        if j < n:
            brute[j + 1] = min(brute[j], open_at[j]) + chars[j]
            for end, cost in patterns[j]:
                closed[end] = min(closed[end], open_at[j] + cost)
    return min(closed[n], brute[n])


def spans_of(text: str, min_log10: float, ranks: dict[str, float] = RANKS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses or None), by start, then kind in the order of KINDS."""
    out: list[tuple[str, int, int, float | None]] = []
    out += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        if (cost := log10_guesses(m[1], ranks)) >= min_log10:
            out.append(("guess", m.start(1), m.end(1), cost))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 10.0, words: int = WORDS) -> DataFrame:
    """One row per input row: the id and ``spans``, an array of (kind, start, end, log10_guesses), in code points."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(COMMON_WORDS + (corpus_words(docs, text_col, words) if words else []))
    src = documents(docs, id_col, text_col)
    schema = T.StructType([src.schema[id_col], T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("log10_guesses", T.DoubleType())])))])
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranked(known.value)
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "log10_guesses": g} for k, s, e, g in spans_of(t.as_py() or "", min_log10, ranks)]
                     for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, type=spans_type)], names=[id_col, "spans"])

    return src.mapInArrow(scan, schema)


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("guess").alias("n_guess"),
        F.array_max(F.transform("spans", lambda s: s["log10_guesses"])).alias("max_log10_guesses"))
