"""Every training token gives a gradient."""

import numpy as np
from pyspark.sql import functions as F

from cindergrid.llm import lm


def test_each_token_has_one_round():
    row = np.repeat(np.arange(4), [1, 9, 2, 700])
    assert sorted(np.concatenate([lm.turn(row, t) for t in range(lm.ROUNDS)]).tolist()) == list(range(len(row)))


def test_weights_of_all_histories_move(spark):
    """Words of odd places within blocks of eight, too, are learned from."""
    text = " ".join(f"w{k}" for k in range(160))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    share, weights = spark.sparkContext.broadcast, np.zeros((lm.D, lm.C), np.float32)
    for t in range(lm.ROUNDS):
        weights = lm.update(docs, share(weights), share(np.zeros(0, np.uint64)), share(np.zeros(0, np.int64)), t)
    data = np.frombuffer(text.encode(), np.uint8)
    feats = lm.features(*lm.tokens(data, np.array([0, len(data)])))
    assert (weights[feats].any(2)).all()
    assert lm.score(docs, F.lit(False)).count() == 1
