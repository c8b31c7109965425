"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class softmax has hashed features: a bias, the last word, the last two, the
one before the last (skip) and the third last (skip), in D buckets of C weights. Words of at least N / HOT of all N training tokens
(so at most HOT words, which are broadcast) are put in classes of like neighbours by k-means; all others are in TAIL classes by hash. The softmax within a
class has biases only, whose add-one estimate is closed: (c + 1) / (N_class + V_class + 1). Weights are trained in ROUNDS of
synchronous updates: every task runs stochastic gradient steps from the same weights, and the updates are averaged by their tokens. A round
steps over each ROUNDS-th token of every training text, each round over others, so that every training token gives a gradient once. Counts cover every training token and stay in Spark: rare words' counts are joined.
Words are known by 64-bit hashes of their bytes, lower-cased A-Z. Null and empty texts are one end token; without training rows all counts
are 0; rows without doc_id are not held out; repeated rows are scored each; an empty table gives no rows.
Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cindergrid.llm.textkit import blocks, mix, words, written

C, TAIL, D, HOT, ROUNDS, RATE, STEP, CONTEXT = 32, 4, 1 << 13, 1 << 16, 2, .1, 2048, 64
END = np.uint64(0x1F2E3D4C5B6A7988)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(data, offs):
    """Hash and row of every token, an end after each row's words."""
    h, row, _, _ = words(data, offs)
    n = len(offs) - 1
    at = np.searchsorted(row, np.arange(n), "right")
    return np.insert(h, at, END), np.insert(row, at, np.arange(n))


def tally(docs):
    """h, c: how often each token occurs in docs."""
    def run(it):
        for batch in it:
            parts = [np.unique(tokens(data, offs)[0], return_counts=True) for _, _, data, offs in blocks(batch.column(0))]
            h, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            u, at = np.unique(h, return_inverse=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(np.bincount(at, n, len(u)).astype(np.int64))], names=["h", "c"])
    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def before(tok, row, k):
    """The token k places before within the row, else 0."""
    out = np.zeros_like(tok)
    if len(tok) > k:
        out[k:] = np.where(row[k:] == row[:-k], tok[:-k], 0)
    return out


def features(tok, row, take=slice(None)):
    """Bucket of each feature of the history of each token that is taken."""
    one, two, three = (before(tok, row, k)[take] for k in (1, 2, 3))
    made = (one + GOLD, one * GOLD + two * np.uint64(3) + np.uint64(1), two * np.uint64(5) + np.uint64(2), three * np.uint64(7) + np.uint64(3))
    return np.stack([(mix(m) % np.uint64(D - 1)).astype(np.int64) + 1 for m in made] + [np.zeros(len(one), np.int64)])


def classes(tok, hot, hot_class):
    """Class of each token, and its place among the hot words or -1."""
    k = np.minimum(np.searchsorted(hot, tok), max(0, len(hot) - 1))
    found = hot[k] == tok if len(hot) else np.zeros(len(tok), bool)
    tail = (C - TAIL + (tok % np.uint64(TAIL)).astype(np.int64))
    return (np.where(found, hot_class[k], tail) if len(hot) else tail), np.where(found, k, -1)


def softmax(weights, feats):
    z = weights[feats].sum(0)
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1, keepdims=True)
    return p / total, z - np.log(total)


def neighbours(docs, hot):
    """How often each hot word follows and precedes words of each of CONTEXT buckets; at most HOT x CONTEXT numbers."""
    def run(it):
        total = np.zeros(len(hot.value) * CONTEXT, np.int64)
        for batch in it:
            for _, _, data, offs in blocks(batch.column(0)):
                tok, row = tokens(data, offs)
                k = classes(tok, hot.value, np.zeros(len(hot.value), np.int64))[1]
                b = (mix(tok) % np.uint64(CONTEXT // 2)).astype(np.int64)
                same = row[1:] == row[:-1]
                for own, other, half in ((k[1:], b[:-1], 0), (k[:-1], b[1:], CONTEXT // 2)):
                    ok = same & (own >= 0)
                    total += np.bincount(own[ok] * CONTEXT + other[ok] + half, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])
    return docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def grouped(hot, count, table, seed=3):
    """Class of each hot word: k-means of its neighbours' shares, a word weighing as the log of its count."""
    k = min(C - TAIL, len(hot))
    x = np.sqrt((table + .05) / (table + .05).sum(1, keepdims=True))
    mid = x[np.argsort(-count, kind="stable")[:4 * k:4] if len(hot) >= 4 * k else np.arange(k)].copy()
    w = np.log1p(count)
    for _ in range(12):
        own = np.concatenate([(x[i:i + 8192] @ mid.T - (mid ** 2).sum(1) / 2).argmax(1) for i in range(0, len(x), 8192)])
        for j in range(k):
            if (own == j).any():
                mid[j] = np.average(x[own == j], axis=0, weights=w[own == j])
    return own


def turn(row, t):
    """Indices of the tokens of round t, by their places within their rows: every token has one round."""
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return np.flatnonzero(place % ROUNDS == t % ROUNDS)


def steps(wt, grad2, feats, own):
    """Gradient steps of STEP tokens each, in place; a feature's rate falls with its squared gradients. The last feature is the bias of all."""
    feats = feats.astype(np.uint16)  # numbers of 16 bits are sorted in linear time
    for lo in range(0, len(own), STEP):
        f, y = feats[:-1, lo:lo + STEP], own[lo:lo + STEP]
        g = wt[f[0]]
        for k in range(1, len(f)):
            g += wt[f[k]]
        g += wt[0]
        g -= g.max(1, keepdims=True)
        np.exp(g, out=g)
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        flat = f.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        at, step, bias = flat[first], np.add.reduceat(g[order % len(y)], first, axis=0), g.sum(0)
        grad2[0] += (bias * bias).mean()
        wt[0] -= RATE * bias / np.sqrt(grad2[0])
        grad2[at] += np.einsum("ij,ij->i", step, step) / C
        wt[at] -= step * (RATE / np.sqrt(grad2[at]))[:, None]


def update(docs, weights, hot, hot_class, t):
    """The mean of all tasks' weights after their steps of round t, weighed by their tokens."""
    def run(it):
        wt, seen = weights.value.astype(np.float32).copy(), 0
        grad2 = np.full(D, 1e-2, np.float32)
        for batch in it:
            for _, _, data, offs in blocks(batch.column(0), 1 << 18):
                tok, row = tokens(data, offs)
                take = turn(row, t)
                steps(wt, grad2, features(tok, row, take), classes(tok[take], hot.value, hot_class.value)[0])
                seen += len(take)
        if seen:
            moved = np.flatnonzero((wt != weights.value).any(1))
            total = np.zeros((len(moved) + 1, C))
            total[0, 0], total[1:] = seen, (wt - weights.value)[moved].astype(np.float64) * seen
            yield rows_of(np.append(-1, moved), total)

    def add(it):
        total, met = np.zeros((D + 1, C)), np.zeros(D + 1, bool)
        for batch in it:
            b = batch.column(0).to_numpy()
            np.add.at(total, b, batch.column(1).flatten().to_numpy().reshape(len(b), C))
            met[b] = True
        at = np.flatnonzero(met)
        yield rows_of(np.where(at == D, -1, at), total[at])

    def rows_of(b, d):
        return pa.record_batch([pa.array(b), pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * C), pa.array(d.ravel()))], names=["b", "d"])
    kind = "b long, d array<double>"
    sums = docs.select("text").mapInArrow(run, kind).repartition("b").mapInArrow(add, kind)
    new, rows = weights.value.astype(np.float64).copy(), sums.collect()
    total = next((r.d[0] for r in rows if r.b < 0), 1.0)
    for r in rows:
        if r.b >= 0:
            new[r.b] += np.array(r.d) / total
    return new.astype(np.float32)


def score(docs, held):
    """Scores of all docs by a model of those that aren't held."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    held = F.coalesce(held, F.lit(False))
    train = docs.filter(~held)
    counts = written(tally(train))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = sorted((r.h % 2**64, r.c) for r in counts.filter(F.col("c") * HOT >= n).collect())
    hot, count = np.array([x[0] for x in top], np.uint64), np.array([x[1] for x in top], np.float64)
    h = share(hot)
    table = np.zeros((len(hot), CONTEXT))
    for r in neighbours(train, h).groupBy(F.floor(F.col("at") / CONTEXT).alias("k")).agg(F.collect_list((F.col("at") % CONTEXT).cast("int")).alias("c"), F.collect_list("n").alias("n")).collect():
        table[r.k, r.c] = r.n
    own = grouped(hot, count, table) if len(hot) else np.zeros(0, np.int64)
    hc, weights = share(own), np.zeros((D, C), np.float32)
    for t in range(ROUNDS):
        weights = update(train, share(weights), h, hc, t)
    tail = (F.lit(C - TAIL) + F.col("h").bitwiseAND(F.lit(TAIL - 1)))
    size, kinds = np.bincount(own, count, C), np.bincount(own, minlength=C).astype(float)
    for r in counts.filter(F.col("c") * HOT < n).groupBy(tail.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        size[r.k], kinds[r.k] = r.n, r.v
    below = np.log10(size + kinds + 1)
    base_below = math.log10(n + v + 1)
    wt, model = share(weights), share((np.log10(count + 1), below))

    def run(it):
        for batch in it:
            ids, docs_, flags = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, data, offs in blocks(batch.column(3)):
                tok, row = tokens(data, offs)
                k, at = classes(tok, h.value, hc.value)
                feats = features(tok, row)
                logp = np.concatenate([softmax(wt.value, feats[:, i:i + 65536])[1][np.arange(len(k[i:i + 65536])), k[i:i + 65536]] for i in range(0, len(tok), 65536)]) / math.log(10)
                is_hot = at >= 0
                top_ = model.value[0][at[is_hot]]
                m = hi - lo
                add = lambda w, x: np.bincount(row if x is None else row[x], w, m)
                total = add(None, None)
                value = add(logp.astype(np.float64) - model.value[1][k], None) + add(top_, is_hot)
                base = add(top_, is_hot) - total * base_below
                cold = np.flatnonzero(~is_hot)
                order = cold[np.lexsort((tok[cold], row[cold]))]
                first = np.flatnonzero(np.append(True, (np.diff(tok[order]) != 0) | (np.diff(row[order]) != 0))) if len(order) else order
                times = np.diff(np.append(first, len(order)))
                crow = row[order[first]]
                own_ids = np.append(np.arange(m), crow)
                null = len(first)
                yield pa.record_batch([
                    ids.slice(lo, m).take(pa.array(own_ids)), docs_.slice(lo, m).take(pa.array(own_ids)), flags.slice(lo, m).take(pa.array(own_ids)),
                    pa.array(np.append(np.zeros(m, np.int64), tok[order[first]].view(np.int64)), mask=np.arange(m + null) < m), pa.array(np.append(total.astype(np.int64), times)),
                    pa.array(np.append(add(None, is_hot).astype(np.int64), np.zeros(null, np.int64))), pa.array(np.append(base, np.zeros(null))), pa.array(np.append(value, np.zeros(null)))],
                    names=["rid", "doc_id", "held_out", "h", "n", "known", "base", "value"])
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held.alias("held_out"), "text")
    parts = written(rows.mapInArrow(run, "rid long, doc_id long, held_out boolean, h long, n long, known long, base double, value double"))
    rare = parts.filter("h is not null").select("rid", "h", "n").join(counts, "h")
    rare = rare.select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n"), F.col("n").alias("known"), (F.col("n") * F.log10(F.col("c") + 1)).alias("base"))
    whole = parts.filter("h is null").select("rid", "doc_id", "held_out", "n", "known", "base", "value").unionByName(rare.withColumn("value", F.col("base")))
    return (whole.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("value").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
