"""Operators and the pipeline against plain loops over all pairs or all segmentations."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cindergrid.llm import decontam, minhash, pii, quality, registry
from cindergrid.llm.textkit import words

DIR = "/root/testdata/sf0.001"


def hashes(t):
    raw = np.frombuffer((t or "").encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def leaking(docs, items, least=decontam.THRESHOLD):
    return {(d, i) for d, t in docs for i, x in items if len(hashes(x)) and len(hashes(t)) and decontam.align(hashes(x), hashes(t))[0] >= least}


def test_leaks_are_those_of_all_alignments(spark):
    docs = [tuple(r) for r in registry.read(spark, DIR, "documents").select("doc_id", "text").collect()]
    bench = registry.read(spark, DIR, "benchmark").orderBy("item_id").limit(25)
    small = [(d, t) for d, t in docs if len(t or "") < 6000]
    own = spark.createDataFrame(small, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(own, bench).collect()}
    assert got == leaking(small, [(r.item_id, r.text) for r in bench.collect()])


def test_families_of_like_items(spark):
    """Items that differ in one word; a copy is edited in just that word."""
    rng = random.Random(3)
    shared = [f"s{rng.randint(0, 9999)}" for _ in range(40)]
    items = [(k, " ".join([*shared[:20], f"only{k}", *shared[20:]])) for k in range(9)]
    docs = [(1, " ".join(["a"] * 30 + shared[:20] + ["edited"] + shared[20:] + ["b"] * 30)), (2, " ".join(shared[:6])), (None, items[3][1]), (4, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == {(x, k) for x in (1, None) for k in range(9)} == leaking([x for x in docs if x[1]], items)
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [2, 4]


@pytest.mark.parametrize("text", ["415 555 2671", "1.2.3.4", "a@b.c", "x (at) y", "+1 (2)", "4 4 4", "12-34-5"])
def test_decoder_finds_the_best_segmentation(text):
    W = np.random.default_rng(len(text)).normal(size=(4, 20))
    cut, segs = pii.lattice(text)
    n, best = len(cut) - 1, {}
    for i, j, f in segs:
        best[i, j] = (W @ f).max()
    top = -np.inf
    for marks in itertools.product([0, 1], repeat=n - 1):
        ends = [0, *[k + 1 for k, m in enumerate(marks) if m], n]
        total = 0.0
        for a, b in zip(ends, ends[1:]):
            total += max(best.get((a, b), -np.inf), 0.0 if b == a + 1 else -np.inf)
        top = max(top, total)
    got = sum((W @ np.array(next(f for i, j, f in segs if (cut[i], cut[j]) == (a, b)), float))[pii.KINDS.index(k)] for k, a, b in pii.decode(text, W))
    assert got == pytest.approx(max(top, 0))


def units(t):
    w = [x for x in re.split(r"[ \t\n\r\x0b\f]+", (t or "").lower()) if x]
    rows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return {(x, rows[:k].count(x)) for k, x in enumerate(rows)}


def plain_lines(rows):
    """rows (doc_id, text) without the lines that match an earlier one; in order of doc_id, nulls first."""
    seen, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        keep = []
        for line in (t or "").split("\n"):
            w = set(re.findall(r"[^ \t\r\x0b\f]+", line))
            if not w or not any(10 * len(w & s) >= 8 * len(w | s) for s in seen):
                keep.append(line)
            if w:
                seen.append(w)
        out.append((i, None if t is None else "\n".join(keep)))
    return out


def classes(rows):
    top, own = list(range(len(rows))), [units(t) for _, t in rows]

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or own[a] and own[b] and 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(8)
    vocab = [f"{c}{k}" for c in ("sun", "rain", "leaf", "road", "hill") for k in range(60)]
    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    item = " ".join(f"q{k}" for k in range(30))
    docs = [(k, "\n".join(prose(25) for _ in range(4))) for k in range(1, 25)]
    docs += [(30, docs[2][1].replace("sun", "sun", 1) + " more"), (31, docs[3][1]), (32, prose(20) + "\n" + prose(20) + "\n" + docs[4][1].split("\n")[1])]
    docs += [(40, prose(10) + " " + item + " " + prose(10)), (50, "!#$ %% 00 11 22 " * 40), (51, "!! ## $$ 99 " * 60), (60, None), (61, ""), (62, " \n\n"), (70, prose(3000)), (None, prose(50))]
    d = tmp_path_factory.mktemp("corpus")
    extra = {"lang": ["x"] * len(docs), "source": ["s"] * len(docs), "n_chars": [len(t or "") for _, t in docs], "score": [.5] * len(docs), "key": [1] * len(docs), "row": [2] * len(docs)}
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), **extra}), d / "documents.parquet")
    marks = [(i, int(i not in (50, 51))) for i, _ in docs if i is not None]
    pq.write_table(pa.table({"doc_id": [i for i, _ in marks], "quality": [q for _, q in marks], "toxic": [0] * len(marks)}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [item, None]}), d / "benchmark.parquet")
    empty = tmp_path_factory.mktemp("none")
    for n in ("documents", "labels", "benchmark"):
        t = pq.read_table(d / f"{n}.parquet")
        pq.write_table(t.slice(0, 0), empty / f"{n}.parquet")
    return str(d), str(empty), docs, item


def test_pipeline_stage_by_stage(spark, folder):
    d, _, docs, item = folder
    now = registry.read(spark, d, "documents")
    names = now.columns
    net = quality.fit(now, registry.read(spark, d, "labels"), registry.remainder(4) != 2)
    want = [(i, t) for i, t in docs if quality.probability(net, quality.pooled(net, np.frombuffer((t or "").encode(), np.uint8))) >= .7]
    key = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "lines":
            want = plain_lines(want)
        elif name == "minhash":
            order = key(want)
            own = classes(order)
            parts = {c: [r for r, x in zip(order, own) if x == c] for c in set(own)}
            want = [min(p, key=lambda r: (r[0] is None, r[0] or 0)) for p in parts.values()]
        elif name == "decontam":
            want = [(i, t) for i, t in want if not leaking([(i, t)], [(1, item)])]
        out = stage(spark, now, d)
        assert out.columns == names or sorted(out.columns) == sorted(names)
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name == "minhash":  # of equal null and empty texts either stays
            got, want = ([(i, t or "") for i, t in v] for v in (got, want))
        assert key(got) == key(want), name
        want, now = got, spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    assert sorted({r.doc_id for r in packed if r.doc_id is not None}) == sorted({i for i, _ in want if i is not None})
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {i for i, _ in want}


def test_pipeline_of_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder[1]).count() == 0


def test_one_row_of_each_class(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(2, text), (3, text), (3, text + " x"), (3, "other words here for a fact"), (3, "other words here for a fact"), (None, text + " y"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, key int")
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(2, text), (3, "other words here for a fact"), (7, "")], key=str)
    assert minhash.keep_one(docs).columns == docs.columns


def test_held_out_language_is_that_of_the_nearest_codeword(spark):
    from cindergrid.llm import langid
    d = registry.read(spark, DIR, "documents")
    model = langid.fit(d, F.lit(True))
    texts = [r.text for r in d.limit(40).collect()]
    got = [r.lang_pred for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for t, name in zip(texts, got):
        raw = np.frombuffer(t.encode(), np.uint8)
        m = langid.margins(model["W"], raw, np.array([0, len(raw)]))[0]
        loss = [sum(w * np.logaddexp(0, -x * b) for w, x, b in zip(model["weight"], m, c)) for c in model["code"]]
        assert name == model["langs"][int(np.argmin(loss))]
