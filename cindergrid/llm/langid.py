"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (1 to 3) gives a margin, trained on counts that
one distributed pass gathers from all labelled texts (languages x buckets numbers reach the driver). Decoding weighs each bit's logistic loss
by the bit's accuracy over all labelled texts, which a second pass counts, and takes the nearest codeword; a small gap to the second is flagged as ambiguous.
Texts are counted in blocks of at most ROWS rows, so that memory is bounded for short ones too. Repeated rows count, and are predicted, each; null texts and texts without a letter are `und` with score 0; ties go to the first language by name; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cindergrid.llm.textkit import LOWER, blocks

BUCKETS, ROWS = 1 << 13, 512


def grams(data, offs):
    """Counts of hashed n-grams, a row for each text; n-grams across two texts don't count."""
    n, low = len(offs) - 1, LOWER[data].astype(np.uint32)
    low[(low >= 48) & (low < 58)] = 48
    row = np.repeat(np.arange(n), np.diff(offs))
    out, code = np.zeros(n * BUCKETS, np.float32), low
    for k in (1, 2, 3):
        if k > 1:
            code = code[:-1] * np.uint32(257) + low[k - 1:]
        own = row[:len(code)]
        ok = own == row[k - 1:]
        h = (code * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64)
        out += np.bincount((own * BUCKETS + h)[ok], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def codewords(n):
    """n rows of +-1 of 4 * ceil(log2 n) + 7 bits with wide distances; no bit is constant."""
    rng, bits = np.random.default_rng(11), 4 * max(1, int(np.ceil(np.log2(max(n, 2))))) + 7
    best, far = None, -1
    for _ in range(300):
        c = rng.choice([-1, 1], (n, bits))
        if n > 1:
            c[0, np.abs(c.sum(0)) == n] *= -1
            gap = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        else:
            gap = 0
        if gap > far:
            best, far = c, gap
    return best


def counts(labelled):
    """lang, bucket, n and the number of texts over all rows."""
    def run(it):
        total = {}
        for batch in it:
            lang = np.array(batch.column(0).to_pylist())
            for lo, hi, data, offs in blocks(batch.column(1), 1 << 19, ROWS):
                g = grams(data, offs)
                for x in set(lang[lo:hi]):
                    total[x] = total.get(x, 0) + g[lang[lo:hi] == x].sum(0, dtype=np.float64)
        for x, g in total.items():
            at = np.flatnonzero(g)
            yield pa.record_batch([pa.array([x] * len(at)), pa.array(at), pa.array(g[at])], names=["lang", "bucket", "n"])
    return labelled.select("lang", "text").mapInArrow(run, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def margins(W, data, offs):
    """Each text's margin of each bit; short texts weigh less."""
    g = grams(data, offs)
    return g @ W * (60 / np.maximum(g.sum(1, keepdims=True), 60))


def hits(labelled, langs, W, code):
    """How many labelled texts each bit gets right, of how many: a row for each bit."""
    place = {x: i for i, x in enumerate(langs)}

    def run(it):
        right, n = np.zeros(code.shape[1], np.int64), 0
        for batch in it:
            own = np.array([place[x] for x in batch.column(0).to_pylist()])
            for lo, hi, data, offs in blocks(batch.column(1), 1 << 19, ROWS):
                right += (margins(W, data, offs) * code[own[lo:hi]] > 0).sum(0)
                n += hi - lo
        yield pa.record_batch([pa.array(np.arange(len(right))), pa.array(right), pa.array(np.full(len(right), n))], names=["bit", "right", "n"])
    return labelled.select("lang", "text").mapInArrow(run, "bit long, right long, n long").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))


def fit(docs, fold):
    labelled = docs.filter(fold & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = counts(labelled).collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return {"langs": [], "W": np.zeros((BUCKETS, 0), "f4"), "code": np.zeros((0, 0)), "weight": np.zeros(0)}
    table = np.zeros((len(langs), BUCKETS))
    for r in rows:
        table[langs.index(r.lang), r.bucket] = r.n
    table = (table + .5) / (table + .5).sum(1, keepdims=True)
    code = codewords(len(langs))
    up, down = (code > 0).T @ table + 1e-9, (code < 0).T @ table + 1e-9
    W = (np.log(up / up.sum(1, keepdims=True)) - np.log(down / down.sum(1, keepdims=True))).T.astype("f4")
    right = np.full(code.shape[1], .5)
    for r in hits(labelled.filter(F.col("lang").isin(langs)), langs, W, code).collect():
        right[r.bit] = r.right / max(1, r.n)
    weight = np.log((right + .001) / (1.001 - right)).clip(.01)
    return {"langs": langs, "W": W, "code": code, "weight": weight / weight.sum()}


def predict(docs, model):
    """doc_id, lang_pred, score, ambiguous for each row."""
    langs = np.array(model["langs"], object)

    def run(it):
        for batch in it:
            text, name, score, unsure = batch.column(1), [], [], []
            letter = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in blocks(text, 1 << 19, ROWS):
                m = margins(model["W"], data, offs)
                loss = np.stack([(np.logaddexp(0, -m * c) * model["weight"]).sum(1) for c in model["code"]], 1) if len(langs) else np.zeros((hi - lo, 0))
                for k in range(hi - lo):
                    if not letter[lo + k] or not len(langs):
                        name.append("und"), score.append(0.0), unsure.append(True)
                        continue
                    p = np.exp(loss[k].min() - loss[k])
                    p /= p.sum()
                    name.append(langs[loss[k].argmin()]), score.append(float(p.max()))
                    unsure.append(bool(len(p) > 1 and np.sort(p)[-1] < 2 * np.sort(p)[-2]))
            yield pa.record_batch([batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
