"""Gradient-boosted trees that grow leaf by leaf, for a label of 0 and 1.

Values are put to bins once. In each round every task sums gradients by node, feature and bin for the nodes that are asked for, Spark adds the tasks' sums, and
the driver, which holds the trees alone, picks the splits: always the leaf of the greatest gain next, up to a number of leaves. To need few rounds, all nodes that
this order would split by what is known are opened at once; what it doesn't take in the end is dropped, so the tree is that of one split at a time. Models of all folds grow in
the same jobs. Rows of equal bins, label, fold and use have equal gradients in all rounds, so they are one row with a count. A table that has at most ALONE of these isn't worth a job
for each round: there each model is grown by one task, to the same trees, as sums are whole numbers (gradients times SCALE) and their order doesn't matter. Missing values have a bin of their own and go to the better side of each split.
"""

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cindergrid.operators.state import written

SCALE, MISSING, KEEP, ALONE, TABLE = 1 << 26, 255, 20, 1 << 20, 1 << 14


def cuts_of(df, features, bins=MISSING):
    """At most bins - 1 cuts of each feature, from its approximate quantiles; a value is in the first bin whose cut it doesn't exceed."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = df.agg(*[F.percentile_approx(value(c), shares, 100_000).alias(c) for c in features]).first()
    return [np.unique(np.array(found[c] or [], float)) for c in features]


def binned(values, cuts):
    """Bins of a matrix of numbers, with NaN for missing ones."""
    out = np.empty(values.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(values[:, f]), MISSING, np.searchsorted(c, values[:, f]))
    return out


def numbers(batch, features):
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in features]) if features else np.zeros((batch.num_rows, 0))


class Tree:
    """Arrays of nodes; feature is -1 in a leaf. Values of up to cut go left, missing ones where missing_left says."""

    def __init__(self, feature, cut, missing_left, left, value):
        self.feature, self.cut, self.missing_left, self.left, self.value = (np.array(x) for x in (feature, cut, missing_left, left, value))

    def place(self, bins):
        """The leaf of each row."""
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        while len(rows):
            rows = rows[self.feature[node[rows]] >= 0]
            at = node[rows]
            b = bins[rows, self.feature[at]]
            node[rows] = self.left[at] + np.where(b == MISSING, ~self.missing_left[at], b > self.cut[at])
        return node

    def add(self, bins):
        return self.value[self.place(bins)]


class Model:
    """Features, their cuts, the first score and trees."""

    def __init__(self, features, cuts, start, trees):
        self.features, self.cuts, self.start, self.trees, self.all = features, cuts, start, trees, None

    def of_bins(self, bins):
        return 1 / (1 + np.exp(-(self.start + sum((t.add(bins) for t in self.trees), np.zeros(len(bins))))))

    def tabled(self):
        """The model with the probabilities of all bins, where they are few."""
        sizes = [len(c) + 2 for c in self.cuts]
        if self.all is None and self.cuts and math.prod(sizes) <= TABLE:
            at = np.indices(sizes).reshape(len(sizes), -1).T
            self.all = self.of_bins(np.where(at == np.array(sizes) - 1, MISSING, at).astype(np.uint8))
        return self

    def probability(self, values):
        """Of each row; rows of equal bins are scored once."""
        bins, sizes = binned(values, self.cuts), [len(c) + 2 for c in self.cuts]
        if not self.cuts or math.prod(sizes) >= 1 << 62:
            return self.of_bins(bins)
        code = np.ravel_multi_index(tuple(np.where(b == MISSING, n - 1, b) for b, n in zip(bins.T.astype(int), sizes)), sizes)
        if self.all is not None:
            return self.all[code]
        _, first, own = np.unique(code, return_index=True, return_inverse=True)
        return self.of_bins(bins[first])[own]


def scored(df, models, fold=None):
    """df with score, the probability of label 1. models: one model, or one for each value of the column fold; rows of a value without a model have a null score."""
    names = df.columns
    for m in [models] if fold is None else models.values():
        m.tabled()

    def run(batches):
        for batch in batches:
            if fold is None:
                score = models.probability(numbers(batch, models.features))
            else:
                own, score = batch.column(names.index(fold)), np.full(batch.num_rows, np.nan)
                for k, m in models.items():
                    at = np.flatnonzero(pc.equal(own, pa.scalar(k, own.type)).fill_null(False).to_numpy(zero_copy_only=False))
                    score[at] = m.probability(numbers(batch.take(pa.array(at)), m.features)) if len(at) else []
            yield pa.record_batch([*batch.columns, pa.array(score, pa.float64(), from_pandas=True)], names=[*names, "score"])
    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, ("score", "double")]))


def best_split(g, h, n, l2, least):
    """(gain, feature, cut, missing_left) of sums by feature and bin, or None."""
    total = [x.sum(1)[0].astype(float) for x in (g, h, n)]
    base, found = total[0] ** 2 / (total[1] + l2), None
    for left in (True, False):
        lg, lh, ln = (np.cumsum(x[:, :MISSING], axis=1) + (x[:, MISSING:] if left else 0) for x in (g, h, n))
        rg, rh, rn = total[0] - lg, total[1] - lh, total[2] - ln
        gain = np.where((ln >= least) & (rn >= least), lg ** 2 / (lh + l2) + rg ** 2 / (rh + l2) - base, -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[f, b] > 1e-9 and (found is None or gain[f, b] > found[0] + 1e-12):
            found = (float(gain[f, b]), int(f), int(b), left)
    return found


class Growing:
    """A tree while it grows: sums and best split of each node that is known."""

    def __init__(self, leaves, l2, least):
        self.leaves, self.l2, self.least = leaves, l2, least
        self.sums, self.split, self.left = [None], [None], [-1]
        self.asked = [0]

    def tell(self, node, g, h, n):
        self.sums[node] = (g.sum(1)[0], h.sum(1)[0], n.sum(1)[0])
        self.split[node] = best_split(g, h, n, self.l2, self.least)

    def order(self):
        """The nodes that are split, always the greatest gain next (the earlier node of equals)."""
        heap, taken = [], []
        push = lambda k: self.split[k] and heapq.heappush(heap, (-self.split[k][0], k))
        push(0)
        while heap and len(taken) < self.leaves - 1:
            k = heapq.heappop(heap)[1]
            taken.append(k)
            if self.left[k] >= 0:
                push(self.left[k]), push(self.left[k] + 1)
        return taken

    def open(self):
        """Opens the nodes that are due, and returns their children, whose sums are asked for next; none when the tree is done."""
        self.asked = []
        for k in self.order():
            if self.left[k] < 0:
                self.left[k] = len(self.left)
                self.asked += [self.left[k], self.left[k] + 1]
                self.sums += [None, None]
                self.split += [None, None]
                self.left += [-1, -1]
        return self.asked

    def tree(self, rate=None):
        """With a rate the finished tree; without one that of all opened nodes, whose values are the nodes' numbers."""
        taken = set(self.order()) if rate is not None else {k for k, x in enumerate(self.left) if x >= 0}
        cut = [self.split[k] if k in taken else (0, -1, 0, False) for k in range(len(self.left))]
        value = [-rate * s[0] / (s[1] + self.l2) if s else 0.0 for s in self.sums] if rate is not None else range(len(self.left))
        return Tree([c[1] for c in cut], [c[2] for c in cut], np.array([c[3] for c in cut], bool), [max(0, x) for x in self.left], value)


def gradients(raw, y, count):
    """Whole numbers: first and second derivatives times SCALE, and ones, each times the row's count."""
    p = 1 / (1 + np.exp(-raw))
    return [np.rint(v).astype(np.int64) * count for v in (SCALE * (p - y), SCALE * p * (1 - p), np.ones(len(y)))]


def loss_of(raw, y, count):
    return int((np.rint(SCALE * np.logaddexp(0, np.where(y == 1, -raw, raw))).astype(np.int64) * count).sum())


def added(code, values, size):
    """Sums of whole numbers by code; in two parts where doubles could not hold them."""
    if np.abs(values).sum(dtype=float) < 1 << 52:
        return np.bincount(code, values, size).astype(np.int64)
    return (added(code, values >> 24, size) << 24) + added(code, values & (1 << 24) - 1, size)


def done_at(losses, patience):
    return len(losses) - 1 - int(np.argmin(losses)) >= patience


def grown_alone(bins, y, valid, count, start, trees, rate, leaves, least, l2, patience):
    """The trees of one model whose rows are all here."""
    raw, losses, made = np.full(len(y), start), [], []
    train, wide = np.flatnonzero(~valid), np.arange(bins.shape[1]) * 256

    def sums(rows, values):
        code = (bins[rows] + wide).ravel()
        return [added(code, np.repeat(v[rows], len(wide)), 256 * len(wide)).reshape(-1, 256) for v in values]
    for turn in range(trees + 1):
        losses.append(loss_of(raw[valid], y[valid], count[valid]) / count[valid].sum() if valid.any() else -turn)
        if turn == trees or done_at(losses, patience) or turn and (made[-1].feature < 0).all():
            break
        values, tree, rows = gradients(raw, y, count), Growing(leaves, l2, least), {0: train}
        known = {0: sums(train, values)}
        while tree.asked:
            for node in tree.asked:
                g, h, n = known[node]
                tree.tell(node, g / SCALE, h / SCALE, n)
            before = len(tree.left)
            tree.open()
            for k in [k for k, x in enumerate(tree.left) if x >= before]:
                _, f, cut, missing_left = tree.split[k]
                b = bins[rows[k], f]
                left = np.where(b == MISSING, missing_left, b <= cut)
                i, j = tree.left[k], tree.left[k] + 1
                rows[i], rows[j] = rows[k][left], rows.pop(k)[~left]
                # The larger child has what the smaller one leaves of its parent.
                i, j = (i, j) if len(rows[i]) <= len(rows[j]) else (j, i)
                known[i] = sums(rows[i], values)
                known[j] = [x - y for x, y in zip(known.pop(k), known[i])]
        made.append(tree.tree(rate))
        raw += made[-1].add(bins)
    return made[:int(np.argmin(losses))]


def task_sums(rows, models, growing, recent):
    """model, node, feature, bin and sums of g, h, n over the rows of each task, and (as node -1) the loss of the validation rows."""
    asked = {m: t.asked for m, t in growing.items()}
    trees = {m: t.tree() for m, t in growing.items()}

    def run(batches):
        sums, loss = {}, {m: [0, 0] for m in asked}
        for batch in batches:
            fold, valid, y, bins, count, raws = arrays(batch, models)
            for m, nodes in asked.items():
                raw, other = raws[:, m] + sum((t.add(bins) for t in recent[m]), np.zeros(len(y))), fold != m
                if nodes == [0]:
                    at = other & valid
                    loss[m][0] += loss_of(raw[at], y[at], count[at])
                    loss[m][1] += int(count[at].sum())
                at = np.flatnonzero(other & ~valid)
                where = trees[m].place(bins[at])
                slot = np.full(len(trees[m].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at, where = at[slot[where] >= 0], slot[where[slot[where] >= 0]]
                code = ((where[:, None] * bins.shape[1] + np.arange(bins.shape[1])) * 256 + bins[at]).ravel()
                for k, v in enumerate(gradients(raw[at], y[at], count[at])):
                    sums[m, k] = sums.get((m, k), 0) + added(code, np.repeat(v, bins.shape[1]), len(nodes) * bins.shape[1] * 256)
        out = [([m], [-1], [0], [0], [a], [b], [0]) for m, (a, b) in loss.items()]
        for m in {m for m, _ in sums}:
            some = np.flatnonzero(sums[m, 2])
            wide = len(sums[m, 2]) // (256 * len(asked[m]))
            out.append((np.full(len(some), m), np.array(asked[m])[some // (256 * wide)], some // 256 % wide, some % 256, *[sums[m, k][some] for k in range(3)]))
        yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["model", "node", "feature", "bin", "g", "h", "n"])
    return rows.mapInArrow(run, "model long, node long, feature long, bin long, g long, h long, n long")


KIND = "f int, v boolean, y int, bins binary, n long, raw array<double>"


def arrays(batch, models):
    """fold, validation flag, label, bins, count and scores so far of a batch of KIND."""
    fold, valid, y, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(y), -1)
    return fold, valid, y, bins, count, batch.column(5).flatten().to_numpy().reshape(len(y), models)


def with_trees(rows, recent):
    """rows with the recent trees in their scores."""
    def run(batches):
        for batch in batches:
            *_, bins, _, raw = arrays(batch, len(recent))
            raw = np.column_stack([raw[:, m] + sum((t.add(bins) for t in trees), np.zeros(len(raw))) for m, trees in recent.items()])
            yield pa.record_batch([*batch.columns[:5], pa.array(list(raw), pa.list_(pa.float64()))], names=["f", "v", "y", "bins", "n", "raw"])
    return rows.mapInArrow(run, KIND)


def grown_apart(rows, start, trees, rate, leaves, least, l2, patience):
    """The trees of each model of start (by its number), by jobs over all rows."""
    count = 1 + max(start)
    rows = rows.persist()
    done, recent, losses, live = {m: [] for m in range(count)}, {m: [] for m in range(count)}, {m: [] for m in start}, set(start)
    for turn in range(trees + 1):
        growing = {m: Growing(leaves, l2, least) for m in live}
        while any(t.asked for t in growing.values()):
            sums = task_sums(rows, count, {m: t for m, t in growing.items() if t.asked}, recent)
            found = sums.groupBy("model", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
            cols = [found.column(i).to_numpy() for i in range(7)]
            for m, t in list(growing.items()):
                if t.asked == [0]:
                    at = (cols[0] == m) & (cols[1] == -1)
                    # Without validation rows each tree counts as better than the one before.
                    losses[m].append(cols[4][at].sum() / cols[5][at].sum() if cols[5][at].sum() else -turn)
                    if done_at(losses[m], patience) or turn and (done[m][-1].feature < 0).all():
                        live.discard(m)
                        del growing[m]
                        continue
                wide = int(cols[2].max()) + 1
                for node in t.asked:
                    at = (cols[0] == m) & (cols[1] == node)
                    own = np.zeros((3, wide, 256), np.int64)
                    for k in range(3):
                        own[k][cols[2][at], cols[3][at]] = cols[4 + k][at]
                    t.tell(node, own[0] / SCALE, own[1] / SCALE, own[2])
                t.open()
        if turn == trees or not live:
            break
        for m, t in growing.items():
            done[m].append(t.tree(rate))
            recent[m].append(done[m][-1])
        if max(map(len, recent.values())) >= KEEP:
            before, rows, recent = rows, written(with_trees(rows, recent)).persist(), {m: [] for m in recent}
            before.unpersist()
    rows.unpersist()
    return {m: done[m][:int(np.argmin(losses[m]))] for m in start}


def boost(df, features, label, fold, trees=400, rate=.06, leaves=31, least=40, l2=1.0, share=.15, patience=30, seed=42, key=None):
    """A model for each value k of fold (whole numbers from 0), trained on the rows of other folds; with fold None one model of all rows.

    A share of the training rows, drawn by a hash of key (of all features if None), is left out to stop: a model ends when their loss hasn't fallen for so many trees, and keeps the trees
    up to the least. Rows with a null label are not used. Training rows with one label give a model without trees.
    """
    df = df.filter(F.col(label).isNotNull())
    group = F.lit(-1) if fold is None else F.col(fold).cast("int")
    cuts = cuts_of(df, features)
    counts = {r.f: (r.n, r.p) for r in df.groupBy(group.alias("f")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).collect()}
    models = sorted(k for k in counts if k is not None) if fold is not None else [0]
    start = []
    for m in models:
        n, p = (sum(v[i] for k, v in counts.items() if fold is None or k != m) for i in (0, 1))
        start.append(float(np.log(p / (n - p))) if 0 < p < n else float("inf") if n and p == n else float("-inf"))
    draw = F.pmod(F.xxhash64(F.lit(seed), *([key] if key else features)), F.lit(10_000)) < int(10_000 * share)
    base = df.select(group.alias("f"), draw.alias("v"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    first = [x if np.isfinite(x) else 0.0 for x in start]

    def put(batches):
        for batch in batches:
            bins = binned(numbers(batch, [f"x{i}" for i in range(len(features))]), cuts)
            f = pc.index_in(batch.column(0), value_set=pa.array(models, pa.int32())).fill_null(-1)
            ends = np.arange(len(bins) + 1, dtype=np.int32) * len(features)
            texts = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(bins.tobytes())])
            yield pa.record_batch([f, batch.column(1), batch.column(2), texts], names=["f", "v", "y", "bins"])
    rows = base.mapInArrow(put, "f int, v boolean, y int, bins binary").groupBy("f", "v", "y", "bins").agg(F.count("*").alias("n"))
    rows = written(rows.withColumn("raw", F.array(*map(F.lit, first)).cast("array<double>")))
    how = {"trees": trees, "rate": rate, "leaves": leaves, "least": least, "l2": l2, "patience": patience}
    able = {i: x for i, x in enumerate(start) if np.isfinite(x)}

    def alone(key, table):
        m, parts = key[0].as_py(), [arrays(b, len(models)) for b in table.select(["f", "v", "y", "bins", "n", "raw"]).to_batches()]
        _, valid, y, bins, count, _ = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"m": pa.array([m], pa.int32()), "made": pa.array([pickle.dumps(grown_alone(bins, y, valid, count, able[m], **how))], pa.binary())})
    if not able:
        made = {}
    elif rows.count() <= ALONE:
        # A task for each model; a count that is given isn't merged again.
        each = rows.withColumn("m", F.explode(F.array(*map(F.lit, able)))).filter("f <> m").repartitionByRange(len(able), "m")
        made = {r.m: pickle.loads(r.made) for r in each.groupBy("m").applyInArrow(alone, "m int, made binary").collect()}
    else:
        made = grown_apart(rows, able, **how)
    out = {k: Model(features, cuts, start[i], made.get(i, [])) for i, k in enumerate(models)}
    return out if fold is not None else out[0]
