"""Rows with texts reach Python in batches of bounded size, however many rows a task has."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cindergrid.llm import decontam, minhash, packing, quality

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def largest(df):
    def run(it):
        for batch in it:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])
    return df.mapInArrow(run, "n long").agg(F.max("n"), F.sum("n")).first()


@pytest.fixture
def bound(spark):
    before = spark.conf.get(BATCH)
    yield lambda n: spark.conf.set(BATCH, n)
    spark.conf.set(BATCH, before)


@pytest.mark.parametrize("call", [
    lambda d: minhash.sign(d),
    lambda d: minhash.with_units(d.select(F.col("doc_id").alias("id"), "text")),
    lambda d: quality.kept(d, quality.train([], []), .0),
    lambda d: quality.score(d, quality.train([], [])),
    lambda d: packing.pack(d, ids=False),
    lambda d: decontam.aligned(d.selectExpr("cast(text as binary) key", "doc_id item_id", "text", "array(1L) words", "array(0) places")),
])
def test_batches_of_texts_are_bounded(spark, bound, call):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "concat('one two three four five six ', id) text")
    bound("10000")
    out = call(docs)
    assert largest(docs) == (1000, 3000)
    assert out.count() in (0, 3000)


def test_smaller_bound_of_the_session_stays(spark, bound):
    docs = spark.range(0, 30, 1, 1).selectExpr("id doc_id", "'a b' text")
    bound("7")
    minhash.sign(docs)
    assert largest(docs) == (7, 30)
    bound("0")
    minhash.sign(docs)
    assert largest(docs) == (30, 30)
