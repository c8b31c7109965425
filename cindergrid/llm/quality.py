"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; filters of WIDTH bytes at every place (STRIDE = 1) of overlapping chunks cover the whole text; the maxima and
means of the chunks' filters are combined into one probability. It is trained on the driver by gradient descent on at most
SAMPLE labelled rows (drawn by a hash of the id, so few that their ids are broadcast), on their whole texts, and scores whole texts.
A label is a doc_id's highest quality; rows of one doc_id share it. A column named score is replaced by score(); kept() returns the columns as they are. Null and empty texts get the score of an all-zero pooling; repeated rows get equal scores; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cindergrid.llm.textkit import blocks, mapped

WIDTH, STRIDE, DIM, FILTERS, CHUNK, SAMPLE, EPOCHS = 8, 1, 8, 24, 1024, 2000, 6


def pooled(net, data, keep=False):
    """Max and mean over chunks of the filters' maxima."""
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
    at = np.arange(0, len(data) - WIDTH + 1, STRIDE)
    if at[-1] != len(data) - WIDTH:
        at = np.append(at, len(data) - WIDTH)
    step = CHUNK // STRIDE // 2
    best, where = [], []
    for lo in range(0, len(at), step * 16):
        own = at[lo:lo + step * 16 + step]
        x = net["E"][data[own[:, None] + np.arange(WIDTH)]].reshape(len(own), -1)
        z = x @ net["W"] + net["b"]
        for k in range(0, min(len(own), step * 16), step):
            part = z[k:k + 2 * step]
            i = part.argmax(0)
            best.append(part[i, np.arange(FILTERS)])
            if keep:
                where.append(own[k + i])
    best = np.maximum(np.array(best), 0)
    top = best.argmax(0)
    feats = np.concatenate([best.max(0), best.mean(0)])
    return (feats, best, top, where) if keep else feats


def probability(net, feats):
    return 1 / (1 + np.exp(-np.clip(feats @ net["u"] + net["c"], -30, 30)))


def train(texts, labels, seed=7):
    rng = np.random.default_rng(seed)
    net = {"E": rng.normal(0, .5, (256, DIM)).astype("f4"), "W": rng.normal(0, .2, (WIDTH * DIM, FILTERS)).astype("f4"), "b": np.zeros(FILTERS, "f4"), "u": rng.normal(0, .1, 2 * FILTERS).astype("f4"), "c": np.float32(0)}
    labels = np.asarray(labels)
    share = labels.mean() if len(labels) else .5
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    seen = {k: np.zeros_like(v) for k, v in net.items()}
    for _ in range(EPOCHS if 0 < share < 1 else 0):
        for i in rng.permutation(len(data)):
            feats, best, top, where = pooled(net, data[i], True)
            d = (probability(net, feats) - labels[i])
            g = {"u": d * feats, "c": np.float32(d)}
            dz = np.tile(d * net["u"][FILTERS:] / len(best), (len(best), 1))
            dz[top, np.arange(FILTERS)] += d * net["u"][:FILTERS]
            dz *= best > 0
            raw = np.concatenate([data[i], np.zeros(max(0, WIDTH - len(data[i])), np.uint8)])
            idx = raw[np.array(where)[:, :, None] + np.arange(WIDTH)]
            x = net["E"][idx].reshape(len(best), FILTERS, -1)
            g["W"], g["b"] = np.einsum("cf,cfx->xf", dz, x), dz.sum(0)
            gx = (dz[:, :, None] * net["W"].T[None]).reshape(-1, DIM)
            g["E"] = np.zeros_like(net["E"])
            np.add.at(g["E"], idx.reshape(-1), gx)
            for k in net:
                seen[k] = seen[k] + g[k] ** 2
                net[k] = (net[k] - .03 * g[k] / np.sqrt(seen[k] + 1e-6)).astype("f4")
    logit = np.log(share / (1 - share)) if 0 < share < 1 else 30 * (2 * share - 1)
    if not 0 < share < 1:
        net["c"] = np.float32(logit)
    return net


def fit(docs, labels, fold):
    """A network from at most SAMPLE labelled ids for which fold is true; of an id's rows the least text counts, once."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = docs.filter(fold).select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    names = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in drawn], "doc_id long, quality long")
    # Names are at most SAMPLE rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(names), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).collect()
    rows = sorted(rows, key=lambda r: (r.text or "", r.quality))
    return train([r.text for r in rows], [r.quality for r in rows])


def kept(docs, net, least):
    """The rows that score at least so much, with all their columns and no other."""
    i = docs.columns.index("text")

    def run(it):
        for batch in it:
            yield batch.filter(pa.array(probabilities(batch.column(i), net) >= least))
    return mapped(docs, run, docs.schema)


def probabilities(texts, net):
    p = np.empty(len(texts))
    for lo, hi, data, offs in blocks(texts):
        for k in range(hi - lo):
            p[lo + k] = probability(net, pooled(net, data[offs[k]:offs[k + 1]]))
    return p


def score(docs, net):
    """docs with a score, in place of a column of that name if there is one."""
    names = [c for c in docs.columns if c != "score"]
    i = names.index("text")

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probabilities(batch.column(i), net))], names=[*names, "score"])
    kept_ = docs.select(*names)
    return mapped(kept_, run, StructType(list(kept_.schema.fields)).add("score", "double"))
