"""The corpus pipeline, stage by stage, against plain versions of the stages."""

import itertools

import corpus_pipeline
import duckdb
from surveyspark.llm import quality
from surveyspark.llm.queries import ORACLE, QUERIES

from tests.llm.test_text_operators import LOWER, WORD, naive_leaks, without_hot

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_digest(quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r["kept"]}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "decontamination", "pieces"]
    want = {i: t for i, t in texts.items() if i in good}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        if k == 1:
            want = {i: "\n".join(x) for i, x in zip(want, without_hot(list(want.values()), 10))}
        if k == 2:
            sets = {}
            for i, t in want.items():
                w = WORD.findall(t.translate(LOWER))
                sets[i] = set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set()
            least = {i: i for i in want}
            for _ in want:                                   # spread least ids along links until nothing changes
                before = dict(least)
                for i, j in itertools.combinations(sorted(want), 2):
                    if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        least[i] = least[j] = min(least[i], least[j])
                if before == least:
                    break
            want = {i: t for i, t in want.items() if least[i] == i}
        if k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {i: t for i, t in want.items() if not naive_leaks(t, items, 0.2)}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want), k
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(want) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in last)


def test_every_operator_has_its_query_and_sql_runs():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        assert name in QUERIES and con.sql(sql).fetchall()
