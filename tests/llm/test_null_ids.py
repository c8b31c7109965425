"""Rows without doc_id keep their texts, and are near copies as others are."""

from cindergrid.llm import minhash


def test_near_copies_without_ids(spark):
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in own]
    rows = [(1, own[0]), (None, near[0]), (None, own[1]), (None, own[1]), (None, near[1]), (None, own[2]), (7, own[3]), (None, own[3]), (9, own[4]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0)] * 6 + [(0, 1), (0, 7), (1, 1), (7, 7), (9, 9)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = [r.n for r in kept.collect()]
    assert len(kept) == 6 and {0, 5, 6, 8} <= set(kept) and len({2, 3, 4} & set(kept)) == 1 and len({9, 10} & set(kept)) == 1


def test_repeated_and_null_ids_in_the_models(spark, tmp_path):
    """A repeated id is one labelled text, however many rows it has; rows without an id are never held out."""
    from cindergrid.llm import quality, registry
    own = [(i, f"good text number {i} of the corpus" if i % 2 else "zz# " * (i + 1), "en" if i % 2 else "de") for i in range(24)]
    rows = own + [(5, f"copy {k}", "en") for k in range(30)] + [(None, "no id here", "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen, train = [], quality.train
    quality.train = lambda texts, marks: seen.append(list(zip(texts, marks))) or train(texts, marks)
    try:
        got = registry.op5_byte_cnn_quality(spark, str(tmp_path)).collect()
    finally:
        quality.train = train
    fold = {r.doc_id for r in docs.filter("doc_id is not null").filter(registry.remainder(4) != 2).collect()}
    assert len(seen[0]) == len(fold) and sum(t.startswith("copy") for t, _ in seen[0]) == (5 in fold)
    assert len(got) == len(rows) and all(r.held_out is False for r in got if r.doc_id is None)
    assert all(r.held_out is not None for r in registry.op2_error_correcting_language(spark, str(tmp_path)).collect())
