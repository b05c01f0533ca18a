"""Quality rules in DataFrame functions only: plain text statistics, then a language-model ratio.

The model compares two multinomials over hashed word unigrams and bigrams: one
counted over trusted documents (label quality = 1), one over the whole corpus.
The number of hash buckets grows with the corpus (with the cube root of its
bytes).  Counts are combined in every task before they are shuffled.  The count
table is sent to the documents in slices of at most ``SLICE`` buckets, and their
n-grams are added up in the task that made them: no n-gram of a document is
shuffled.  The mean log ratio does not depend on a document's length.  A trusted
document is scored without its own counts (nor those of trusted copies of its text).

Labelled rows (trusted ones, and those that set the threshold) are a sample by
hash of the id of at most about ``LABELLED_BOUND`` rows of the label table; corpus
counts, scores and verdicts cover all documents.

The threshold is taken anew for every table: where the held-out ratios of rows
labelled 1 and of rows labelled 0 (with at least ``MIN_WORDS`` words) part best.
Scores are given relative to it, so what is below ``MIN_SCORE`` is rejected.
Without rows labelled 0 it is the least held-out ratio of a trusted document;
without any trusted document every score is 0 and only the plain rules decide.

Null and empty texts have no words and fail the plain rules; null ids are never
trusted; repeated rows each count and are each scored; extra columns of the
input are carried by :func:`keep_good`, but for names that begin with ``__``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from surveyspark.llm.tables import plain, written

#: Fixed by the contract.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Hash buckets: the power of two from BUCKETS_PER_ROOT times the cube root of the corpus's bytes on.
BUCKETS_PER_ROOT = 256
LEAST_BUCKETS = 1 << 12
#: Buckets that are sent to all tasks at once.
SLICE = 1 << 21
SMOOTHING = 1.0
#: Labelled rows that are used, chosen by hash.
LABELLED_BOUND = 200_000
#: Tasks for each core of the session that combine counts.
TASKS_PER_CORE = 4
#: Scores are relative to the threshold of the table at hand.
MIN_SCORE = 0.0
#: The threshold is looked for in steps of this size.
STEP = 0.001



def words_of(text: F.Column) -> F.Column:
    """Words between white space; an empty array if there are none."""
    body = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, WHITE + "+"))


def plain_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __words and the contract's statistics in __-named columns; the input's columns stay.

    For the 3-word windows each becomes one long: a hash whose low bits give way to the window's place, as many bits
    as the text needs.  After sorting, equal windows are neighbours.
    """
    text = F.col(f"`{text_col}`").cast("string")
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    df = docs.withColumns({"__words": words_of(text), "__lines": lines})
    n = F.size("__words")
    room = F.pow(F.lit(2.0), F.ceil(F.log2(n + 1.0))).cast("long")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__windows", F.when(n >= 3, windows).otherwise(none))
    codes = F.transform("__windows", lambda h, i: h.bitwiseAND(-F.col("__room")).bitwiseOR(i.cast("long")))
    df = df.withColumn("__room", room)
    # most texts repeat no window and need no sorting
    df = df.withColumn("__codes", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(codes)).otherwise(none))

    def same(a: F.Column, b: F.Column) -> F.Column:
        return a.bitwiseAND(-F.col("__room")) == F.coalesce(b, F.bitwise_not(a)).bitwiseAND(-F.col("__room"))

    again = F.filter("__codes", lambda c, i: same(c, F.get("__codes", i + 1)) | (i > 0) & same(c, F.get("__codes", F.greatest(i - 1, F.lit(0)))))
    df = df.withColumn("__again", F.sort_array(F.transform(again, lambda c: c.bitwiseAND(F.col("__room") - 1))))
    covered = F.aggregate(F.transform("__again", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__again", i + 1), p + 3) - p)),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumns({
        "__n_words": n.cast("long"),
        "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_repeat_words": covered})
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return df.withColumn("__base_failed", failed).drop("__lines", "__room", "__windows", "__codes", "__again")


def bucket(width: int, *words: F.Column) -> F.Column:
    return F.xxhash64(*words).bitwiseAND(width - 1).cast("int")


def exploded_grams(rows: DataFrame, width: int) -> DataFrame:
    """One row for each unigram and bigram of __words, with its hash bucket b; the other columns are repeated.

    The outer explode keeps Spark from testing the array's size ahead of the projection that makes it.
    """
    others = [c for c in rows.columns if c != "__words"]
    at = rows.select(*others, "__words", F.posexplode_outer("__words").alias("__at", "__word")).where("__word is not null")
    pairs = at.select(*others, "__word", F.get("__words", F.col("__at") + 1).alias("__next"))
    both = F.array(bucket(width, F.col("__word")), F.when(F.col("__next").isNotNull(), bucket(width, F.col("__word"), F.col("__next"))))
    return pairs.select(*others, F.explode(both).alias("b")).where("b is not null")


def counted_grams(rows: DataFrame, width: int) -> DataFrame:
    """The distinct buckets of each row's n-grams as b, with n, how often they occur; the other columns are repeated."""
    others = [c for c in rows.columns if c != "__words"]
    uni = F.transform("__words", lambda x: bucket(width, x))
    bi = F.transform(F.slice("__words", 2, F.greatest(F.size("__words") - 1, F.lit(0))), lambda x, i: bucket(width, F.get("__words", i), x))
    rows = rows.withColumn("__sorted", F.concat(uni, bi)).withColumn("__sorted", F.sort_array("__sorted"))
    n = F.size("__sorted")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("__sorted", i) != F.get("__sorted", F.greatest(i - 1, F.lit(0)))))
    rows = rows.withColumn("__first", F.when(n > 0, first))
    runs = F.transform("__first", lambda at, i: F.struct(F.get("__sorted", at).alias("b"), (F.coalesce(F.get("__first", i + 1), n) - at).cast("long").alias("n")))
    return rows.select(*others, F.explode_outer(runs).alias("x")).where("x is not null").select(*others, "x.b", "x.n")


def n_buckets(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(BUCKETS_PER_ROOT * max(size, 1) ** (1 / 3))))


def text_key(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def labelled_ids(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int = LABELLED_BOUND) -> DataFrame:
    """(__of, __quality, __copies): labelled ids, 1 or 0, and how many trusted documents have the text of a trusted one."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("long").alias("__of")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("__quality"))
    share = min(1.0, bound / max(known.count(), 1))
    chosen = written(known.where(F.pmod(F.xxhash64("__of"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))), "labelled")
    trusted = docs.join(F.broadcast(chosen.where("__quality = 1")), F.col(f"`{id_col}`").cast("long") == F.col("__of"))
    keys = written(trusted.select("__of", text_key(F.col(f"`{text_col}`")).alias("__key")), "trusted-texts")
    copies = written(keys.groupBy("__key").agg(F.count("*").alias("__copies")).where("__copies > 1"), "trusted-copies")
    most = keys.join(copies, "__key").groupBy("__of").agg(F.max("__copies").alias("__copies"))
    return written(chosen.join(most, "__of", "left").na.fill(1, ["__copies"]), "labelled-copies")


def with_label(docs: DataFrame, labelled: DataFrame, id_col: str) -> DataFrame:
    """Adds __label (1: trusted, 0, or -1: none) and __own, how often trusted copies of the document count in the target.

    ``labelled`` has at most about LABELLED_BOUND rows, so it is sent to every task.
    """
    joined = docs.join(F.broadcast(labelled), F.col(f"`{id_col}`").cast("long") == F.col("__of"), "left")
    own = F.when(F.col("__quality") == 1, F.col("__copies")).otherwise(F.lit(0).cast("long"))
    return joined.withColumns({"__label": F.coalesce("__quality", F.lit(-1)), "__own": own}).drop("__of", "__quality", "__copies")


def with_words(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__label, __own, __key (of the text), __n_text (words) and __words of every document."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = with_label(docs.select(F.col(f"`{id_col}`"), text.alias(text_col)), labelled, id_col)
    rows = rows.select("__label", "__own", text_key(F.col(f"`{text_col}`")).alias("__key"), words_of(F.col(f"`{text_col}`")).alias("__words"))
    return rows.withColumn("__n_text", F.size("__words"))


def ngram_counts(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(b, raw, target) of every bucket that occurs.  A few tasks per core read the corpus, so equal buckets meet before the shuffle."""
    tasks = TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    rows = with_words(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).coalesce(tasks), labelled, id_col, text_col)
    grams = exploded_grams(rows.select((F.col("__label") == 1).cast("long").alias("good"), "__words"), width)
    return written(grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "ngram-counts")


def mean_ratios(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__key, __label, __own, __n_text and __ratio of every text that has words; one row for all its copies under one label."""
    width = n_buckets(docs, text_col)
    counts = ngram_counts(docs, labelled, id_col, text_col, width)
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    n_raw, n_target = total["raw"] or 0, total["target"] or 0

    # only trusted documents need equal buckets together: their own counts leave the target
    words, who = with_words(docs, labelled, id_col, text_col), ("__key", "__label", "__own", "__n_text")
    row = F.monotonically_increasing_id()
    grams = exploded_grams(words.where("__own = 0").withColumn("__row", row), width).withColumn("n", F.lit(1).cast("long"))
    grams = grams.unionByName(counted_grams(words.where("__own > 0").withColumn("__row", row), width))
    part = F.log(F.col("target") - F.col("n") * F.col("__own") + SMOOTHING) - F.log(F.col("raw") + SMOOTHING)
    parts = []
    for start in range(0, width, SLICE):
        inside = F.col("b").between(start, start + SLICE - 1)
        met = grams.where(inside).join(F.broadcast(counts.where(inside)), "b")
        one = met.groupBy("__row", *who).agg(F.sum(F.col("n") * part).alias("part"))
        parts.append(one.groupBy(*who).agg(F.max("part").alias("part")))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    n_grams = 2 * F.col("__n_text") - 1
    base = math.log(n_raw + SMOOTHING * width) - F.log(F.lit(n_target + SMOOTHING * width) - n_grams * F.col("__own"))
    ratio = F.col("part") / n_grams + base if n_target else F.lit(0.0)
    return written(whole.groupBy(*who).agg(F.sum("part").alias("part")).select(*who, ratio.alias("__ratio")), "ngram-ratios")


def threshold(ratios: DataFrame) -> DataFrame:
    """One row: the cut with the greatest difference between the shares of rows labelled 1 and 0 above it, halfway to the next lower ratio."""
    held = ratios.where((F.col("__label") >= 0) & (F.col("__n_text") >= MIN_WORDS))
    steps = held.groupBy(F.floor(F.col("__ratio") / STEP).alias("at")).agg(F.sum("__label").alias("good"), F.sum(1 - F.col("__label")).alias("bad"))
    every, up = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("at")
    lost, gone = (F.sum(c).over(up) - F.col(c) for c in ("good", "bad"))
    won = F.coalesce(F.try_divide(gone, F.sum("bad").over(every)), F.lit(0.0)) - F.try_divide(lost, F.sum("good").over(every))
    at = steps.select("at", "good", won.alias("won"), F.lag("at").over(up).alias("below")).where("won is not null and good > 0")
    cut = F.when(F.col("below").isNull(), F.col("at").cast("double")).otherwise((F.col("at") + F.col("below") + 1) / 2)
    return at.agg((F.max_by(cut, F.struct("won", -F.col("at"))) * STEP).alias("cut"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The input's columns and, in __-named columns, the statistics, __score (mean log ratio above the threshold; 0 without words) and __kept."""
    docs = plain(docs)
    labelled = labelled_ids(docs, labels, id_col, text_col)
    ratios = mean_ratios(docs, labelled, id_col, text_col)
    cut = threshold(ratios).first()["cut"] or 0.0
    df = plain_stats(with_label(docs, labelled, id_col).withColumn("__text", text_key(F.col(f"`{text_col}`"))), text_col).drop("__words")
    each = ratios.select("__key", F.col("__label").alias("__as"), F.col("__own").alias("__times"), "__ratio")
    df = df.join(each, (F.col("__text") == F.col("__key")) & (F.col("__label") == F.col("__as")) & (F.col("__own") == F.col("__times")), "left")
    df = df.withColumn("__score", F.coalesce(F.col("__ratio") - F.lit(cut), F.lit(0.0)))
    df = df.withColumn("__kept", ~F.col("__base_failed") & (F.col("__score") >= min_score))
    return df.drop("__text", "__label", "__own", "__key", "__as", "__times", "__ratio")


def quality_digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return scored.select(F.col(f"`{id_col}`"), *[F.col(f"__{c}").alias(c) for c in names])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with.

    A filter on a row number is not pushed below the projection, where the score's array functions would be copied
    into the condition and evaluated many times.
    """
    scored = score(docs, labels, id_col, text_col).withColumn("__row", F.monotonically_increasing_id())
    return scored.where("__kept and __row >= 0").select(*[F.col(f"`{c}`") for c in plain(docs).columns])
