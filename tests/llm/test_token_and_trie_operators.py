"""Byte-pair encoding, the prefix trie and fill-in-middle against the library or plain versions, with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.llm import byte_pairs, fill_middle, prefix_trie

SCHEMA = "doc_id long, text string, n long, conv long, __ids string"
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "'ll", "1", "23", "!", "--", " ", "౜", "\U00011de0", "<|endoftext|>", "<|endof", "ß", "\r\n",
         "zz", "=", "\x1c", "<P>", "<S", ">", "<M>"]


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(4)
    texts = [None, "", " ", "x" * 40_000, "\n" * 5_000, "é漢" * 30_000, "same text", "same text"]
    return texts + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 30))) for _ in range(150)]


@pytest.fixture(scope="module")
def odd_docs(spark, odd_texts):
    rows = [(None if i == 5 else 6 if i == 7 else i - 20, t, 1, 2, "x") for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# -- byte pairs -----------------------------------------------------------------------------------

def test_ids_and_texts_are_those_of_the_library(spark, odd_docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(byte_pairs.MODEL)
    out = byte_pairs.decode(byte_pairs.encode(odd_docs))
    assert set(out.columns) == {"doc_id", "text", "n", "conv", "__ids", "__decoded", "__ids_sha256"}
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["__ids"] == want
        assert r["__decoded"] == lib.decode(want, skip_special_tokens=False)
        assert r["__ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()


def test_segment_trees_merge_like_a_plain_search(monkeypatch):
    rnd = random.Random(8)
    alphabet = "abcd"
    symbols = byte_pairs.byte_symbols()
    vocab = {s: b for s, b in symbols.items()}
    tokens, merges = list(alphabet), []
    while len(merges) < 40:
        pair = rnd.choice(tokens), rnd.choice(tokens)
        if pair not in merges and len(pair[0] + pair[1]) <= 6:
            merges.append(pair)
            if pair[0] + pair[1] not in vocab:
                vocab[pair[0] + pair[1]] = len(vocab)
                tokens.append(pair[0] + pair[1])
    model = byte_pairs.Merges(vocab, merges, {})
    ranks = {p: k for k, p in enumerate(merges)}

    def plainly(word):
        parts = list(word)
        while True:
            found = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            if not found:
                return [vocab[p] for p in parts]
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    words = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in [1, 2, 3, 7, 8, 9, 31, 64, 128] for _ in range(20)]
    for w in words:
        table = np.frombuffer(w.encode(), dtype=np.uint8).reshape(1, -1)
        assert np.frombuffer(model.encode_table(table)[0], dtype=np.int32).tolist() == plainly(w)
        assert np.frombuffer(model.encode_long(w.encode()), dtype=np.int32).tolist() == plainly(w)
    many = [words[k:k + 20] for k in range(0, len(words), 20)]
    for same_length in many:
        table = np.frombuffer("".join(same_length).encode(), dtype=np.uint8).reshape(20, -1)
        assert [np.frombuffer(x, dtype=np.int32).tolist() for x in model.encode_table(table)] == [plainly(w) for w in same_length]
    monkeypatch.setattr(byte_pairs, "CACHED_WORDS", 3)                  # the cache is emptied again and again
    monkeypatch.setattr(byte_pairs, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(byte_pairs, "WORDS_AT_ONCE", 2)
    texts = [" ".join(words[:9]), "", words[0], " ".join(words[50:])]
    got = byte_pairs.Merges(vocab, merges, {}).encode(texts)
    assert got == [b"".join(byte_pairs.Merges(vocab, merges, {}).look_up([[w] for ws in model.words_of(t) for w in ws])) for t in texts]


def test_ids_off_the_vocabulary_and_empty_tables(spark):
    model = byte_pairs.Merges.load(byte_pairs.MODEL)
    assert model.decode(np.array([-1, 10**6, model.byte_id[65]], dtype=np.int32)) == "A"
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_pairs.token_digest(byte_pairs.decode(byte_pairs.encode(empty))).count() == 0
    assert fill_middle.middle_digest(fill_middle.fill_in_middle(empty)).count() == 0


# -- fill in the middle -----------------------------------------------------------------------------

def test_boundary_sets_select_like_a_sorted_list():
    kinds = collections.Counter()
    for case, (n, share) in enumerate([(n, p) for n in (1, 5, 65_536, 65_537, 200_000) for p in (0.0, 0.001, 0.03, 0.3, 0.99, 1.0)]):
        mask = np.random.default_rng(case).random(n) < share
        if case % 4 == 1:
            mask = np.repeat(mask, 40)[:n]
        bounds, want = fill_middle.Boundaries(mask), np.flatnonzero(mask)
        kinds.update(type(c).__name__ for c in bounds.containers)
        assert len(bounds) == len(want)
        for k in {0, len(want) // 3, len(want) - 1, *range(0, len(want), 997)} if len(want) else ():
            assert bounds.select(k) == want[k]
    assert set(kinds) == {"Array", "Bitmap", "Runs"}


def test_cuts_are_those_of_the_contract(spark, odd_docs):
    cut = fill_middle.fill_in_middle(odd_docs)
    assert set(cut.columns) == {"doc_id", "text", "n", "conv", "__n", "__form", "__prefix_chars", "__middle_chars", "__output"}
    rows = cut.withColumn("back", fill_middle.restored(F.col("__output"), F.col("__form"))).collect()
    assert len(rows) == odd_docs.count()
    forms = collections.Counter()
    for r in rows:
        t = r["text"] or ""
        h = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r["__n"], r["__form"], r["__output"], r["back"]) == (len(t), form, out, t)
        assert (r["__prefix_chars"], r["__middle_chars"]) == ((None, None) if form == "plain" else (a, b - a))
        forms[form] += 1
    assert set(forms) == {"plain", "psm", "spm"}


def test_line_units_cut_between_lines(spark):
    docs = spark.createDataFrame([(i, "éa\nbb\n\nlast" if i % 2 else "one line") for i in range(40)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(docs, unit="line").collect():
        assert r["__n"] == (4 if r["doc_id"] % 2 else 1)
        if r["__form"] != "plain":
            t, a, m = r["text"], r["__prefix_chars"], r["__middle_chars"]
            assert all(k in (0, len(t)) or t[k - 1] == "\n" for k in (a, a + m))


# -- prefix trie --------------------------------------------------------------------------------------

def plain_trie(rows, openings=True):
    """Nodes of a small table by definition: every distinct beginning of a rebuilt conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x for *_, x in sorted(t, key=lambda t: t[:2])] for c, t in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:]) if openings else tuple(own[c])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
    ends = {k: ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(k)))) for k, cs in members.items()}
    return sorted((min(cs), len(k), min(members[k[:-1]]) if k else -1, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, cs in members.items())


def found_nodes(nodes):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in nodes.collect())


def conversation_rows():
    rnd = random.Random(12)
    rows = []
    for c in [*range(-7, 60), *range(1000, 1012)]:
        if c % 10 == 3 and c > 0:
            continue                                                         # some families have no first conversation
        for t in range(rnd.choice((1, 2, 5, 9, 14))):
            rows.append((c, None if rnd.random() < 0.1 else t, rnd.choice(("user", "assistant", None)), rnd.choice(("hi", "é" * 3, "", None, "a" + "b" * t))))
    rows += [(c, t, "user", f"turn {t // 2}") for c in range(2000, 2200) for t in range(6)]     # many copies
    rows += [(c, t, "user", "turn 0" if t < 9 else f"{c % 7} {t}") for c in range(2200, 2240) for t in range(13)]
    rows += [(3000, t, "user", f"long {t % 5}") for t in range(500)]         # one conversation over several partitions
    rows += [(3004, t, "user", f"long {t % 5}") for t in range(450)]
    rows += [(None, 1, "user", "nobody's"), (50, 1, "user", "again"), (50, 1, "user", "again"), (50, 1, "user", "again")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in conversation_rows()], "conv_id long, turn int, role string, text string, depth string, n_convs int").repartition(5)


@pytest.fixture()
def many_partitions(spark):
    """Conversations and ends of nodes are dealt over 23 partitions, however small."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_trie_equals_the_plain_one(conversations, monkeypatch, many_partitions):
    monkeypatch.setattr(prefix_trie, "IDS_IN_CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "ROWS_OUT", 5)
    turns = prefix_trie.ordered_turns(conversations)
    blocks = prefix_trie.path_blocks(prefix_trie.paths_as_given(turns)[1])
    assert blocks.where("conv = 3000").count() == 125 and blocks.where("conv = 3000").select("end").distinct().count() == 125
    assert found_nodes(prefix_trie.prefix_trie(*prefix_trie.paths_with_openings(turns))) == plain_trie(conversation_rows())
    assert found_nodes(prefix_trie.prefix_trie(*prefix_trie.paths_as_given(turns), block=3)) == plain_trie(conversation_rows(), openings=False)


def test_block_size_does_not_matter(conversations):
    turns = prefix_trie.ordered_turns(conversations.where("conv_id < 2500"))
    paths = prefix_trie.paths_with_openings(turns)
    assert found_nodes(prefix_trie.prefix_trie(*paths, block=1)) == found_nodes(prefix_trie.prefix_trie(*paths, block=50))


def test_trie_of_no_turns_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"

    def trie(rows):
        return found_nodes(prefix_trie.prefix_trie(*prefix_trie.paths_with_openings(prefix_trie.ordered_turns(spark.createDataFrame(rows, schema)))))

    assert trie([]) == [] and trie([(None, 1, "user", "x")]) == []
    one = [(4, None, None, None)]                                            # h = 0 or more: its only turn may be replaced by nothing
    assert trie(one) == plain_trie(one)
    assert trie([(11, 0, "user", "x")]) == plain_trie([(11, 0, "user", "x")])
