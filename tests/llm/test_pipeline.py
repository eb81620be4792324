"""The pipeline's stages against plain-Python and SQL versions, each on what its predecessor kept."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataframe.llm.sql import QUALITY_CTES, SQL

from .test_ops import by_hand_components, by_hand_gone, by_hand_hits, words


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """documents, and what each stage returned, as written and read again."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/out"
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    assert all(x.columns == steps[0].columns for x in steps[:-1])


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_quality_rules(steps, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"with {QUALITY_CTES} select doc_id from verdict where kept order by 1").fetchall()
    assert ids(steps[1]) == [x for (x,) in want]


def test_line_dedup(steps):
    """Whatever goes is a later occurrence by all pairs, and of those all but a twentieth at most go."""
    rows = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    want = by_hand_gone(sorted(rows.items()))
    left = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert all(words(t) for t in left.values())
    n = 0
    for d, t in rows.items():
        kept = left.get(d, "").split("\n") if d in left else []
        for i, line in enumerate(t.split("\n")):
            if kept[:1] == [line]:
                kept.pop(0)
            elif words(line):
                n += 1
                assert (d, i) in want
        assert not kept
    assert n >= 0.95 * len(want)
    assert steps[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_ngram_join(steps):
    want = by_hand_components([(r["doc_id"], r["text"]) for r in steps[2].collect()])
    assert ids(steps[3]) == sorted(int(k) for k, _, c in want if k == c)


def test_decontaminate(spark, sf, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = by_hand_hits([(r["doc_id"], r["text"]) for r in steps[3].collect()], items)
    assert ids(steps[4]) == sorted(int(k) for k, n, h, _ in hits if not (h and 20 * h >= n))


def test_mixing(steps):
    con = duckdb.connect()
    documents = steps[4].toPandas()  # noqa: F841  (DuckDB reads it by name)
    con.execute("create table documents as select * from documents")
    want = con.execute(SQL["op4_mixing"]).df()
    key = lambda df: sorted(map(tuple, df[["doc_id", "source", "n_tokens", "pass", "block_key", "doc_key"]].astype(str).itertuples(index=False)))
    assert key(steps[5].toPandas()) == key(want)


def test_run_is_the_stages(spark, sf, steps):
    key = lambda df: sorted((r["doc_id"], r["pass"], r["block_key"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(steps[-1])
