"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid.llm import ann, chat, decontam, langid, linededup, lm, minhash, packing, pii, quality, registry

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id long"


def made(seed=3, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    out = []
    for i in range(n):
        ls = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(base).split()
            if rng.random() < .5 and len(w) > 3:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            ls.append((" " if rng.random() < .8 else "\t ").join(w))
        out.append((i, "\n".join(ls)))
    return out + [(100, None), (101, ""), (102, "  \n\n"), (103, "x " * 30000), (104, out[3][1]), (104, out[3][1]), (None, out[5][1])]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", "s", 1, 0.5, 9) for i, t in made()], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lines(docs, empty):
    got = {(r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()}
    seen, want = [], set()
    for i, t in sorted({(-2**63 if i is None else i, t) for i, t in made()}, key=lambda x: x[0]):
        keep = []
        for line in (t or "").split("\n"):
            w = set(re.findall(r"[^ \t\r\x0b\f]+", line))
            if not w or not any(10 * len(w & s) >= 8 * len(w | s) for s in seen):
                keep.append(line)
            if w:
                seen.append(w)
        want.add((None if i == -2**63 else i, None if t is None else "\n".join(keep)))
    assert got == want
    assert linededup.dedup_lines(docs).columns == docs.columns and linededup.dedup_lines(docs).count() == docs.count()
    assert linededup.dedup_lines(empty, counts=True).count() == 0
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def units(t):
    w = [x for x in re.split(r"[ \t\n\r\x0b\f]+", (t or "").lower()) if x]
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    return {(k, j) for k, n in c.items() for j in range(n)}


def test_near_duplicates(spark, empty):
    rows = [(r.doc_id, r.text) for r in registry.read(spark, DIR, "documents").collect()] + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a b")]
    docs = spark.createDataFrame([(i, t, "x", "s", 1, 0.5, 9) for i, t in rows], SCHEMA)
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    own, by = {i: units(t) for i, t in rows}, {}
    for i, u in own.items():
        c = Counter(j for x in u for j in by.get(x, ()))
        for j, k in c.items():
            if 10 * k >= 8 * (len(u) + len(own[j]) - k):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for x in u:
            by.setdefault(x, []).append(i)
    top[9001] = 9000
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i, _ in rows}
    kept = minhash.keep_one(docs)
    assert set(kept.columns) == set(docs.columns) and {r.doc_id for r in kept.collect()} == set(map(find, top))
    assert minhash.near_duplicates(empty).count() == 0


def test_signature_agreement_is_weighted_jaccard():
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:360])
    def sig(t):
        x = np.frombuffer(t.encode(), np.uint8)
        u, row = minhash.elements(x, np.array([0, len(x)]))
        return minhash.signatures(u, row, 1, 1024)[0]
    assert abs((sig(a) == sig(b)).mean() - minhash.similarity(a, b)) < .05


def test_decontamination(spark, docs, empty):
    rng = random.Random(1)
    item = " ".join(f"k{rng.randint(0, 999)}" for _ in range(40))
    edited = item.split()
    for k in (5, 17, 30):
        edited[k] = "changed"
    del edited[22]
    rows = [(1, "pre " * 50 + item + " post" * 50), (2, "pre " * 5 + " ".join(edited)), (3, "nothing here"), (4, None), (5, ""), (6, " ".join(item.split()[:10]))]
    d = spark.createDataFrame([(i, t, "x", "s", 1, 0.5, 9) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "far other words entirely")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7].score == 1 and (got[1, 7].start, got[1, 7].end) == (50, 90)
    assert {r.doc_id for r in decontam.clean(d, bench).collect()} == {3, 4, 5, 6} and decontam.clean(d, bench).columns == d.columns
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(d, bench.limit(0)).count() == 0


def test_alignment():
    a = np.arange(1, 9, dtype=np.uint64)
    assert decontam.align(a, np.concatenate([[99, 98], a, [97]]).astype(np.uint64)) == (1, 2, 10)
    assert decontam.align(a, np.delete(a, 3))[0] == pytest.approx((2 * 7 - 1) / 16)


def brute_spans(t):
    o = [("email", *m.span()) for m in pii.EMAIL.finditer(t)]
    o += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(z) < 256 for z in m[0].split("."))]
    o += [("card", *m.span()) for m in pii.CARD.finditer(t) if 16 <= len(g := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(g)]
    return o + [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark, empty):
    texts = [None, "", "a.b@c.de, x@y", "ip 10.2.3.4.5 300.1.1.1 1.2.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 123-4567 +1", "é 1.2.3.4 a@b.c@d.e", "0" * 6000, "x" * 5000 + "@" + "y" * 10 + ".z",
             "4111111111111111 4111111111111111", "call 415-555-1234 or mail jo.doe (at) mail (dot) com"]
    d = spark.createDataFrame([(i, t, "x", "s", 1, 0.5, 9) for i, t in enumerate(texts)], SCHEMA)
    for r in pii.find(d).collect():
        base = [tuple(s) for s in r.base]
        if len(texts[r.doc_id] or "") < 5000:
            assert base == brute_spans(texts[r.doc_id] or "")
        assert set(base) <= {tuple(s) for s in r.spans}
        if r.doc_id == 9:
            assert [s.kind for s in r.spans] == ["card", "card"]
        if r.doc_id == 10:
            assert {s.kind for s in r.spans} == {"phone", "email"}
    assert pii.find(empty).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    good, bad = [" ".join(rng.choice(["plain", "words", "of", "prose"]) for _ in range(60)) for _ in range(80)], ["".join(rng.choice("!#$%&0123") for _ in range(300)) for _ in range(80)]
    net = quality.train(good[:60] + bad[:60], [1] * 60 + [0] * 60)
    d = spark.createDataFrame([(i, t, "x", "s", 1, 0.5, 9) for i, t in enumerate(good[60:] + bad[60:] + [None, "", "ok " * 60000])], SCHEMA)
    rows = quality.score(d, net).orderBy("doc_id").collect()
    assert all(r.score > .7 for r in rows[:20]) and all(r.score < .3 for r in rows[20:40]) and rows[40].score == rows[41].score and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, net).count() == 0


def test_language(spark, docs, empty):
    d = registry.read(spark, DIR, "documents")
    got = registry.op2_error_correcting_language(spark, DIR).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= .95 * len(got)
    model = langid.fit(d, F.lit(True))
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !")], "doc_id long, text string"), model).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0 and langid.predict(docs, langid.fit(empty, F.lit(True))).count() == docs.count()


def conversations(spark):
    rows = [(1, 0, "user", "a\n<|turn|>x"), (1, 1, "assistant", "␛</s>␛␛[INST]"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "assistant", "one"), (3, 0, "assistant", "one"), (3, 1, "user", "</s></s>")]
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t} " * 50) for t in range(3000)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")


def test_chat_round_trip(spark):
    rows, df = conversations(spark)
    own = {}
    for c, _, r, t in rows:
        own.setdefault(c, []).append((r or "", t or ""))
    parts = {}
    for p in chat.format_conversations(df, limit=5000).collect():
        parts.setdefault(p.conv_id, []).append(p)
    for c, turns in own.items():
        ps = sorted(parts[c], key=lambda p: p.part)
        assert [t for p in ps for t in chat.read_back(p.formatted)] == turns
        assert [chat.unescape(p.formatted[s.start:s.end]) for p in ps for s in p.loss_spans] == [t for r, t in turns if r == "assistant"]
    assert len(parts[4]) > 10
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in registry.op8_chat_templates(spark, DIR).collect()}
    own = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in registry.read(spark, DIR, "conversations").orderBy("conv_id", "turn").collect():
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    for c, turns in own.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(own)


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{% import os %}", "{{ open('x') }}", "{% if a == 'b' %}"])
def test_templates_are_closed_in(bad):
    with pytest.raises(ValueError):
        chat.compile_template(bad)


def test_template_folding():
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 'x' == 'x' %}d{% else %}e{% end %}")) == [("emit", ("const", "abcd"))]


def test_scores(spark, docs, empty):
    rows = lm.score(docs, registry.remainder(7) == 2).collect()
    own = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]) for i, t in made()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, w in own if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in own))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score(empty, registry.remainder(7) == 2).count() == 0


@pytest.mark.parametrize("size", [2048, 50])
def test_packing(spark, docs, empty, size):
    from tokenizers import Tokenizer
    tok, rows = Tokenizer.from_file(packing.default_tokenizer()), packing.pack(docs.filter("doc_id is not null and doc_id <> 104"), size=size).collect()
    pieces, seq = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in made():
        if i is None or i == 104:
            continue
        ids, own = tok.encode(t or "", add_special_tokens=False).ids + [0], sorted(pieces[i], key=lambda r: r.piece)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == ids and [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.length == size for r in own[1:]) and (len(own) == 1) == (len(ids) <= size)
    for v in seq.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= size
    assert packing.pack(empty).count() == 0


def test_best_two_fit_replaces_the_smallest():
    bins, _ = packing.fill([60, 30, 20, 19], 100, True)
    assert sorted(sorted([60, 30, 20, 19][i] for i in b) for b in bins) == [[19, 20, 60], [30]]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype("f4")
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (705, rows_dup := [float(z) for z in x[5]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    y, ids = np.vstack([x, [rows_dup]]).astype(float), np.append(np.arange(600), 705)
    hit = 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - y[list(ids).index(r.vec_id)] @ y[q]) < 1e-9 for r in own)
        hit += len(set(top) & {r.vec_id for r in own})
    assert set(got) == set(range(0, 600, 20)) and hit >= .9 * 600
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    docs = registry.read(spark, DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert sorted(out.columns) == sorted(docs.columns) and 0 < out.count() <= docs.count(), name
        docs = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
