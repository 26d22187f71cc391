"""Every query with SQL against it, and the stages of the pipeline."""

import pytest

from tests.llm.helpers import SF001, edge_docs, edge_rows, empty_docs
from tests.oracle_check import compare, duck
from txguard.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF001).toPandas(), duck(SF001).sql(ORACLE[name]).df()) is None


def test_entry_lists_them():
    import __spark_entry__ as e
    names = set(e.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from txguard.llm.scratch import Scratch
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen = [docs]
    for _, stage in p.STAGES:
        seen.append(scratch.write(stage(spark, seen[-1], SF001)))
    for before, after in zip(seen, seen[1:-1]):
        assert after.columns == docs.columns
        assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    assert seen[1].count() >= 0.99 * docs.count()
    assert seen[3].count() < seen[2].count()
    assert seen[4].count() < seen[3].count()
    assert {r["doc_id"] for r in seen[5].collect()} == {r["doc_id"] for r in seen[4].collect()}
    assert p.run(spark, SF001).count() == seen[5].count()


def test_pipeline_edges(spark):
    import corpus_pipeline as p
    for docs in (edge_docs(spark, extra=False), empty_docs(spark)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns
            assert out.count() <= len(edge_rows())


def test_stages_hand_texts_to_workers_in_small_batches(spark):
    """What a worker has in hand does not follow the size of a partition."""
    import pyarrow as pa

    import corpus_pipeline as p
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 5000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 700) AS text", "'en' AS lang",
                                                 "'s' AS source", "1L AS n_chars")

    def held(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    def most():
        return max(r["n"] for r in docs.mapInArrow(held, "n long").collect())

    spark.conf.unset(name)
    try:
        assert most() > 16 << 20
        for _, stage in p.STAGES[:-1]:
            spark.conf.unset(name)
            stage(spark, docs.limit(10), SF001)
            assert most() < 5 << 20
        spark.conf.set(name, "1m")      # a size that the session was given stays
        p.line_cleaning(spark, docs.limit(10), SF001)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
