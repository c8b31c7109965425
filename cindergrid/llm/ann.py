"""Nearest neighbours with learned partitions.

A neighbour graph of at most SAMPLE vectors (drawn by a hash of the id) is cut into PARTS balanced parts: median splits along principal
directions, then moves of nodes to the part that holds most of their neighbours while sizes allow. A softmax classifier learns which parts hold
a vector's neighbours. Every row is indexed in its most probable part, every query goes to its PROBES most probable parts, and candidates
are scored exactly in double precision. Parts are split into chunks of ROWS rows and QUERIES queries, so a hot part is many bounded groups.
A query whose parts hold too few rows goes on to further parts, so that it gets K or all there are. Scores are summed for each pair by itself, in one
order, so that equal vectors have equal scores. A repeated vec_id is one query, with its least vector, and counts once, with its best score, among the neighbours.
Null, zero and non-finite vectors and vectors of another length than the first sampled take no part; ties go to the smaller vec_id; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from cindergrid.llm.textkit import written

SAMPLE, PARTS, PROBES, NEAR, ROWS, QUERIES, K = 4096, 16, 12, 10, 8192, 4096, 20


def valid(rows):
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.select("vec_id", v.alias("vec")).filter("vec is not null and vec_id is not null").filter(ok)


def balanced_parts(X, near):
    """Part of each node of the neighbour graph."""
    part, n = np.zeros(len(X), int), len(X)
    for _ in range(int(np.log2(PARTS))):
        new = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                c = X[at] - X[at].mean(0)
                side = c @ np.linalg.svd(c, full_matrices=False)[2][0]
                new[at[np.argsort(side, kind="stable")[len(at) // 2:]]] += 1
        part = new
    size, cap = np.bincount(part, minlength=PARTS), int(1.1 * n / PARTS) + 1
    for _ in range(8):
        for i in range(n):
            to = np.bincount(part[near[i]], minlength=PARTS).argmax()
            if to != part[i] and size[to] < cap:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
    return part


def router(X, target, rounds=250, rate=.5):
    Wt, b = np.zeros((X.shape[1], PARTS)), np.zeros(PARTS)
    Z = X / np.linalg.norm(X, axis=1, keepdims=True)
    for _ in range(rounds):
        p = np.exp(8 * (Z @ Wt + b))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(Z)
        Wt -= rate * 8 * Z.T @ g
        b -= rate * 8 * g.sum(0)
    return Wt, b


def fit(vectors):
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    rows = [r.vec for r in rows if len(r.vec) == len(rows[0].vec)]
    if not rows:
        return None
    X = np.array(rows)
    near = []
    for lo in range(0, len(X), 512):
        s = X[lo:lo + 512] @ X.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        near.append(np.argsort(-s, axis=1)[:, :min(NEAR, max(1, len(X) - 1))])
    near = np.concatenate(near)
    part = balanced_parts(X, near)
    target = (np.eye(PARTS)[part[near]].mean(1) + np.eye(PARTS)[part]) / 2
    return router(X, target)


def routed(vectors, model, probes, counts=None):
    """vec_id, vec, part: a row for each of the most probable parts, and for more of them until their counts hold over K rows."""
    Wt, b = model
    size = np.array([counts.get(p, 0) for p in range(PARTS)]) if counts else np.full(PARTS, 1 << 40)

    def run(it):
        for batch in it:
            vecs, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            keep = [i for i, v in enumerate(vecs) if len(v) == len(Wt)]
            if not keep:
                continue
            X = np.array([vecs[i] for i in keep])
            order = np.argsort(-(X / np.linalg.norm(X, axis=1, keepdims=True) @ Wt + b), axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            row, at = np.nonzero((np.arange(PARTS) < probes) | (before <= K))
            yield pa.record_batch([pa.array([ids[keep[i]] for i in row], pa.int64()), pa.array([vecs[keep[i]] for i in row], pa.list_(pa.float64())), pa.array(order[row, at], pa.int32())], names=["vec_id", "vec", "part"])
    return vectors.mapInArrow(run, "vec_id long, vec array<double>, part int")


def chunked(df, part_counts, own, other, name):
    """Each row once for each chunk of the other side; own chunk by hash."""
    table = F.create_map(*[F.lit(x) for p in range(PARTS) for x in (p, max(1, -(-part_counts.get(p, 0) // own)))])
    count = F.create_map(*[F.lit(x) for p in range(PARTS) for x in (p, max(1, other.get(p, 1)))])
    mine = F.pmod(F.xxhash64("vec_id"), table[F.col("part")])
    return df.withColumn(name, mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count[F.col("part")].cast("long") - 1)))


def rerank(key, rows, queries):
    q, x = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
    out = [[], [], []]
    if len(q) and len(x):
        repeated = True if len(np.unique(x)) < len(x) else None

        def matrix(t):
            return np.array(t.column("vec").to_pylist(), float)
        order = np.argsort(x, kind="stable")
        x, X, Y = x[order], matrix(rows)[order], matrix(queries)
        for lo in range(0, len(q), 256):
            s = Y[lo:lo + 256] @ X.T
            s[q[lo:lo + 256, None] == x[None]] = -np.inf
            # All that may be among the first K whatever the rounding, and the same ids' other rows.
            least = np.partition(s, max(0, s.shape[1] - K), axis=1)[:, max(0, s.shape[1] - K)]
            for i in range(len(s)):
                t = np.flatnonzero((s[i] >= least[i] - 1e-9 * (1 + abs(least[i]))) & np.isfinite(s[i])) if np.isfinite(least[i]) and repeated is None else np.flatnonzero(np.isfinite(s[i]))
                exact = (X[t] * Y[lo + i]).sum(1)
                t, exact = (v[np.lexsort((x[t], -exact))] for v in (t, exact))
                if repeated is not None:
                    first = np.sort(np.unique(x[t], return_index=True)[1])
                    t, exact = t[first], exact[first]
                t, exact = t[:K], exact[:K]
                out[0].append(np.full(len(t), q[lo + i])), out[1].append(x[t]), out[2].append(exact)
    cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
    return pa.table({"query_id": pa.array(cat[0].astype("i8")), "vec_id": pa.array(cat[1].astype("i8")), "score": pa.array(cat[2].astype("f8"))})


def search(rows, queries):
    """The K nearest rows by inner product for each query vector, other than itself."""
    rows, queries = valid(rows), valid(queries)
    model = fit(rows)
    if model is None:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "1.0D as score").filter("false")
    index = written(routed(rows, model, 1))
    n = {r.part: r["count"] for r in index.groupBy("part").count().collect()}
    ask = written(routed(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")), model, PROBES, n))
    m = {r.part: r["count"] for r in ask.groupBy("part").count().collect()}
    chunks = lambda c, size: {p: -(-k // size) for p, k in c.items()}
    a = chunked(index, n, ROWS, chunks(m, QUERIES), "rc").withColumnRenamed("other", "qc")
    b = chunked(ask, m, QUERIES, chunks(n, ROWS), "qc").withColumnRenamed("other", "rc")
    key = ["part", "rc", "qc"]
    near = a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", best).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
