"""Large groups of near copies: pairs that are compared follow the rows, not the square of a group."""

import numpy as np

from cindergrid.llm import minhash
from cindergrid.llm.graph import components


def test_pairs_of_a_large_bucket_follow_its_rows(spark, monkeypatch):
    """Twelve groups of near copies in one bucket, whose first leader is like one of them only."""
    groups, size, n = 12, 50, 80
    base = [f"w{i}" for i in range(n)]
    texts = [" ".join(base[:6 * g + 5] + [f"x{g}y{k}"] + base[6 * g + 6:]) for g in range(groups) for k in range(size)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    units = [len(minhash.elements(x, np.array([0, len(x)]))[0]) for x in (np.frombuffer(t.encode(), np.uint8) for t in texts)]
    nodes = docs.withColumn("key", minhash.text_key()).join(spark.createDataFrame([(i, u, [7]) for i, u in enumerate(units)], "id long, n long, bands array<long>"), "id").drop("text")
    pairs, plain = [], minhash.similar

    def similar(found, units):
        pairs.append(found.count())
        return plain(found, units)
    monkeypatch.setattr(minhash, "similar", similar)
    got = {r.node: r["class"] for r in components(minhash.linked(docs, nodes)).collect()}
    assert got == {i: i - i % size for i in range(len(texts)) if i % size}
    assert sum(pairs) <= 8 * len(texts), pairs
