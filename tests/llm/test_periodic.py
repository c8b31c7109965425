"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from cindergrid.llm import periodic, registry


def brute(w):
    """Runs by the definition: for each period, the stretches whose words are equal one period on; then the least period of each."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def left(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in drop]


@pytest.mark.parametrize("signs", ["a", "ab", "abc", "abcdefghij"])
def test_random_words(signs):
    rng = random.Random(signs)
    texts = [[rng.choice(signs) for _ in range(rng.randint(0, 40))] for _ in range(400)]
    for _ in range(400):
        t = []
        for _ in range(rng.randint(1, 5)):
            t += [rng.choice(signs) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        texts.append(t)
    got = periodic.runs_of(texts)
    assert got == [brute(t) for t in texts]
    assert [periodic.collapsed(t, r) for t, r in zip(texts, got)] == [left(t, brute(t)) for t in texts]


def test_each_text_by_itself():
    rng = random.Random(2)
    for n in range(60):
        t = (["x", "y", "z", "x", "w"][:1 + n % 5] * 20)[:n]
        assert periodic.runs_of([t]) == [brute(t)]
        t = [rng.choice("ab") for _ in range(n)]
        assert periodic.runs_of([t]) == [brute(t)]


def test_self_similar_words():
    """Words whose hashes without a modulus would collide, and those of most runs."""
    thue, fib = [0], ["a", "ab"]
    while len(thue) < 3000:
        thue += [1 - x for x in thue]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    texts = [[str(x) for x in thue], list(fib[-1]), list(fib[-1] * 5), ["x"] * 500 + ["y"] + ["x"] * 499]
    assert periodic.runs_of(texts) == [brute(t) for t in texts]


def test_long_text():
    own = [f"w{i}" for i in range(50000)]
    t = own + own[:12000] * 5 + ["x"] * 300000
    assert periodic.runs_of([t]) == [[(len(own), 60000, 12000), (110000, 300000, 1)]]


def test_failed_hashes_are_met(monkeypatch):
    """With bases of tiny moduli runs are wrong at first; the search goes on to other bases until each is verified."""
    monkeypatch.setattr(periodic, "PRIMES", ((1 << 31) - 1,))
    seeds = []
    whole = periodic.Prefixes

    def bad(w, seed):
        seeds.append(seed)
        made = whole(w, seed)
        if seed < 2:
            made.equal = lambda a, b, n: [True] * len(a)
        return made
    monkeypatch.setattr(periodic, "Prefixes", bad)
    t = list("abcabcabcabcabcx") * 2
    assert periodic.runs_of([t]) == [brute(t)] and max(seeds) == 2


def test_rows(spark):
    texts = [(1, None), (2, ""), (None, "a " * 7), (3, "a b " * 4), (3, "a b " * 4), (3, " \n\t"), (4, "\x0ba\x0ca\ra\ta\na a"), (5, "a a  a　a")]
    docs = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in texts], "doc_id long, text string, n_words int, runs string, n_runs int")
    got = periodic.find_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got.collect())
    assert got == [(0, 7, [(0, 7, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (3, 8, [(0, 8, 2)], "a b"), (3, 8, [(0, 8, 2)], "a b"), (4, 6, [(0, 6, 1)], "a"), (5, 3, [], "a a a　a")]
    assert periodic.find_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text or "" for r in registry.read(spark, d, "documents").collect()}
    got, some = registry.op11_repeated_gram_runs(spark, d).collect(), 0
    assert len(got) == len(texts)
    for r in got:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        some += bool(runs)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert tuple(r)[:6] == (r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(" ".join(left(w, runs)).encode()).hexdigest()
    assert some > 5
