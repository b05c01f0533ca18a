"""The registered queries of this subpackage, and SQL where it can state the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import (byte_pairs, decontaminate, fill_middle, html_text, licenses, line_dedup, minhash, prefix_trie, quality, secrets, sharding,
                             substring_dedup, unigram_pieces)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and credential values that are costly to guess."""
    return secrets.secret_digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return licenses.license_digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rules and the language-model ratio for every document."""
    return quality.quality_digest(quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in many documents dropped from every document."""
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.line_digest(line_dedup.LineIndex(spark).add(docs).drop(docs))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces and decoded again."""
    model = unigram_pieces.MODEL
    coded = unigram_pieces.decode(unigram_pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model=model), model)
    return unigram_pieces.piece_digest(coded)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of nearly equal bytes, equal texts together."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word repeats of smaller documents removed from every document."""
    return substring_dedup.repeat_digest(substring_dedup.drop_repeats(_table(spark, sf_dir, "documents")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more."""
    return minhash.near_components(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with the benchmark items that it holds at a small edit distance."""
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.leak_digest(found)


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by byte-level BPE and decoded again."""
    coded = byte_pairs.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return byte_pairs.token_digest(byte_pairs.decode(coded.drop("text")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with the openings that families of them share."""
    turns = prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie_digest(prefix_trie.prefix_trie(*prefix_trie.paths_with_openings(turns)))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, put in another order, and rebuilt from that."""
    return fill_middle.middle_digest(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")))


for _f in (op1_secret_scan, op2_license_scan, op3_quality_rules, op4_line_dedup, op5_sentencepiece, op6_html_extraction,
           op7_sharding, op8_substring_dedup, op9_minhash_near_dedup, op10_benchmark_decontamination, op11_byte_pairs, op12_prefix_trie,
           op13_fill_middle):
    QUERIES[_f.__name__] = _f


ORACLE["op4_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT r, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM d),
k AS (SELECT r, doc_id, i, s[i] AS line, translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key AS hot_key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot_key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON key = hot_key GROUP BY r, doc_id"""

ORACLE["op8_substring_dedup"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least_doc AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least_doc USING (g) WHERE f < doc_id),
words AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
marked AS (SELECT words.doc_id, words.i, word, gone.i IS NOT NULL AS out FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i),
edges AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM marked),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept,
         count(*) FILTER (WHERE edge) AS n_repeats FROM edges GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats
FROM w LEFT JOIN sums ON w.doc_id = sums.doc_id"""

ORACLE["op9_minhash_near_dedup"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM both_have JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
near AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) LEFT JOIN n USING (doc_id)"""

ORACLE["op12_prefix_trie"] = """
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))
    || ':' || coalesce(role, '') || coalesce(text, ''))) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, s, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::BIGINT)),
    lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::BIGINT))), 4294967295::BIGINT) % 9 AS h FROM own),
p AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) AS s FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
n AS (SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d) AS ends,
      bool_and(len(s) = d) AS leaf FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM p) GROUP BY 1, 2),
up AS (SELECT k, d, leaf, (n - 1) * CASE WHEN d > 0 THEN strlen(k[d].t) ELSE 0 END AS saved, unnest(range(0, d + 1)) AS e FROM n),
sub AS (SELECT k[1:e] AS k, sum(saved)::BIGINT AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE d = e + 1) AS kids FROM up GROUP BY 1)
SELECT n.conv_id, n.d AS depth, above.conv_id AS parent_conv_id, n.n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens,
       sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sub USING (k) LEFT JOIN n above ON above.d = n.d - 1 AND above.k = n.k[1:n.d - 1]"""

ORACLE["op13_fill_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
      ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
o AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END)
       AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
