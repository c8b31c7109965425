"""Cases on the edges of the queries' contracts."""

import random
import time

import numpy as np
import pytest

from cindergrid.llm import ann, chat, pii


@pytest.mark.parametrize("n", [1, 19, 20, 21, 40])
def test_few_candidates_are_all_found(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 20 = 0")).collect()
    for q in range(0, n, 20):
        assert sorted(r["rank"] for r in got if r.query_id == q) == list(range(1, min(20, n - 1) + 1))


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:30] + rows[:1], "vec_id long, embedding array<double>")
    got = sorted((r for r in ann.search(df, df.filter("vec_id = 0")).collect()), key=lambda r: r["rank"])
    s = x @ x[0]
    want = sorted(range(1, 60), key=lambda i: (-s[i], i))[:20]
    assert [r.vec_id for r in got] == want and [r["rank"] for r in got] == list(range(1, 21))


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    v, q = [float(z) for z in rng.normal(size=33)], [float(z) for z in rng.normal(size=33)]
    if np.dot(v, q) < 0:
        v = [-z for z in v]
    df = spark.createDataFrame([(0, q), *[(i, v) for i in range(500, 0, -1)]], "vec_id long, embedding array<double>")
    got = sorted(ann.search(df, df.filter("vec_id = 0")).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(1, 21)) and len({r.score for r in got}) == 1


def brute(t):
    o = [("email", *m.span()) for m in pii.EMAIL.finditer(t)]
    o += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(z.lstrip("0") or "0") < 256 for z in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = "".join(c for c in m[0] if c.isdigit())
        o += [("card", *m.span())] if 16 <= len(d) <= 19 and pii.luhn(d) else []
    return o + [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.mark.parametrize("signs", ["a1.@", "ab_.-@c", "0123456789.", "1.2 +()-", "4 1-", "@.a_b%"])
def test_base_spans_are_those_of_the_patterns(signs):
    rng = random.Random(signs)
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("0" * 5000 + ".1.1.1", "1" * 1_000_000, "x" * 1_000_000 + "@", "1." * 500_000, "a@" * 300_000, "+1(" * 200_000):
        start = time.time()
        pii.base_spans(t)
        assert time.time() - start < 8, t[:20]
    assert [s[0] for s in pii.base_spans("0" * 5000 + ".1.1.1")] == ["ip"]


@pytest.mark.parametrize("role, text", [("a\nb", "c"), ("a", "b\nc"), ("␛n", "␛"), ("␛\nn␛", "n"), ("<|turn|>\n", "<|end|>\n"), ("\n\n", "")])
def test_roles_with_line_ends(spark, role, text):
    df = spark.createDataFrame([(1, 0, role, text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df).collect()
    assert [t for p in parts for t in chat.read_back(p.formatted)] == [(role, text), ("assistant", text)]


def test_checksums_and_hashes(spark):
    """The digest columns of op4 and op10, from the operators' real outputs."""
    import hashlib
    import zlib

    from cindergrid.llm import packing, registry
    d = "/root/testdata/sf0.001"
    docs = registry.read(spark, d, "documents")
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in packing.pack(docs).collect()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id, r.piece]) and r.length * 4 == len(ids[r.doc_id, r.piece]) for r in registry.op10_best_two_fit_packing(spark, d).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.op4_semi_markov_pii(spark, d).collect():
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_recall_on_the_test_vectors(spark):
    from cindergrid.llm import registry
    d = "/root/testdata/sf0.01"
    rows = registry.read(spark, d, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in registry.op1_learned_partitions(spark, d).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own) and len(own) == 20
        hit += len({r.vec_id for r in own} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit >= .9 * 20 * len(got)
