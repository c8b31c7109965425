"""Hard negatives by dual-tree search: the rows of another label that score just under an anchor's positives.

Vectors are made whole numbers, floor(SCALE * x), so scores are exact. A tree of cuts, fitted on at most SAMPLE rows, deals the rows to parts, and another one the
anchors; each part has the box of its vectors. For two boxes the inner products lie in an interval; a pair of parts whose interval misses what all
anchors of the one ask for is left out. Of the pairs that stay, each block of anchors meets each block of rows in a task of its own: trees
over both are walked together, pairs of nodes are left out by the same intervals, and leaf pairs are scored exactly, those of the greatest upper bound first,
until no leaf can hold a better row. First the positives are found (in the likeliest part, then wherever their scores leave room), then
the negatives, whose scores have to lie in a window under each positive's.

Rows with a null vec_id, label or vector, or a null or non-finite component take no part; zero and empty vectors do. Vectors of different lengths form no pair. A repeated
vec_id is one row, that of its least label and then least vector. Ties go to the smaller vec_id; an anchor without positives, a negative positive score, and an empty table
give no rows. Other columns are ignored. Components over 2**55 and scores over 2**63 raise an error.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from cindergrid.llm.textkit import written

SCALE, SAMPLE, PART_ROWS, PART_ASKS, DEPTH = 256, 4096, 4096, 512, 8
#: Rows and asks in a block at most (about), in a leaf, and leaves scored at once.
ROWS, ASKS, LEAF, AT_ONCE = 1024, 512, 32, 8
FOUND = "anchor_id long, positive_id long, hi long, vec_id long, score long"


def whole(rows):
    """vec_id, label, vec (whole numbers) of the rows that take part, one for each vec_id."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ok)
    vec = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    return rows.select("vec_id", F.struct(F.col("label").cast("long").alias("label"), vec.alias("vec")).alias("own")).groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.*")


def cuts(rows, part_rows):
    """A tree of cuts at medians along principal directions, so deep that a part has about so many rows; None where there is nothing to cut."""
    n = rows.count()
    X = [r.vec for r in rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()] if n > part_rows else []
    X = np.array([v for v in X if len(v) == len(X[0])], float)
    if X.size == 0:
        return None
    depth = min(DEPTH, int(np.ceil(np.log2(n / part_rows))))
    way, at, own = np.zeros((2 ** depth - 1, X.shape[1])), np.zeros(2 ** depth - 1), np.zeros(len(X), int)
    for node in range(len(way)):
        Y = X[own == node]
        if len(Y) > 1:
            way[node] = np.linalg.svd(Y - Y.mean(0), full_matrices=False)[2][0]
            at[node] = np.median(Y @ way[node])
        inside = own == node
        own[inside] = 2 * node + 1 + (X[inside] @ way[node] > at[node])
    return depth, way, at


def matrix(column, dim):
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def dealt(rows, tree):
    """rows with dim (the vector's length) and part; vectors of another length than the tree's are one part."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            vec = batch.column(names.index("vec"))
            dim = np.array([len(v) for v in vec], np.int32)
            part = np.zeros(len(dim), np.int32)
            if tree:
                depth, way, at = tree
                mine = np.flatnonzero(dim == way.shape[1])
                X = np.array([vec[i].as_py() for i in mine], float).reshape(-1, way.shape[1])
                node = np.zeros(len(mine), int)
                for _ in range(depth):
                    node = 2 * node + 1 + ((X * way[node]).sum(1) > at[node])
                part[mine] = node - len(way)
            yield pa.record_batch([*batch.columns, pa.array(dim), pa.array(part)], names=[*names, "dim", "part"])
    return rows.mapInArrow(run, ", ".join([*[f"{c} {t}" for c, t in rows.dtypes], "dim int, part int"]))


def boxes(rows):
    """dim, part, n and box: the least and greatest component in each place."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            own = {}
            for d, p, v in zip(*[batch.column(names.index(c)).to_pylist() for c in ("dim", "part", "vec")]):
                own.setdefault((d, p), []).append(v)
            ends = [(d, p, len(v), np.min(v, 0).astype(float).tolist(), np.max(v, 0).astype(float).tolist()) for (d, p), v in own.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ends), (pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 2))], names=["dim", "part", "n", "lo", "hi"]) if ends else pa.RecordBatch.from_pylist([], pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))
    some = rows.mapInArrow(run, "dim int, part int, n long, lo array<double>, hi array<double>")
    some = some.select("dim", "part", "n", F.posexplode_outer(F.arrays_zip("lo", "hi")).alias("place", "end"))
    some = some.groupBy("dim", "part", "place").agg(F.sum("n").alias("n"), F.min("end.lo").alias("lo"), F.max("end.hi").alias("hi"))
    return some.groupBy("dim", "part").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("box"))


def blocks(parts, most):
    """dim, part, blocks: how many blocks of about so many rows each part has."""
    return parts.select("dim", "part", F.ceil(F.col("n") / most).cast("int").alias("blocks"))


def summed(a, c, f):
    return F.aggregate(F.zip_with(a, c, lambda x, y: f(*[u * v for u in (x["lo"], x["hi"]) for v in (y["lo"], y["hi"])])), F.lit(0.0), lambda s, v: s + v)


def part_pairs(asked, held):
    """dim, apart, cpart, lower and upper bound of their inner products (with room for rounding), and likeliest: the place of cpart for apart by their boxes' middles."""
    both = asked.select("dim", F.col("part").alias("apart"), F.col("box").alias("abox")).join(held.select("dim", F.col("part").alias("cpart"), F.col("box").alias("cbox")), "dim")
    upper, lower, middle = (summed(F.col("abox"), F.col("cbox"), f) for f in (F.greatest, F.least, lambda *p: sum(p[1:], p[0])))
    room = summed(F.col("abox"), F.col("cbox"), lambda *p: F.greatest(*map(F.abs, p))) * 1e-9
    both = both.select("dim", "apart", "cpart", (lower - room).alias("lower"), (upper + room).alias("upper"), middle.alias("middle"))
    return both.withColumn("likeliest", F.row_number().over(W.partitionBy("dim", "apart").orderBy(F.desc("middle"), "cpart"))).drop("middle")


class Tree:
    """Halves along the widest side of each box down to leaves of at most LEAF rows."""

    def __init__(self, X):
        self.order, self.left, ends = np.arange(len(X)), [], [(0, len(X))]
        boxes = []
        for k in range(1 << 62):
            if k == len(ends):
                break
            a, b = ends[k]
            own = self.order[a:b]
            boxes.append((X[own].min(0), X[own].max(0)))
            self.left.append(len(ends) if b - a > LEAF else -1)
            if b - a > LEAF:
                m = (a + b) // 2
                if X.shape[1]:
                    side = X[own, np.argmax(boxes[k][1] - boxes[k][0])]
                    self.order[a:b] = own[np.argpartition(side, m - a)]
                ends += [(a, m), (m, b)]
        self.left, self.ends = np.array(self.left), ends
        self.lo, self.hi = (np.array(x) for x in zip(*boxes))

    def rows(self, node):
        return self.order[slice(*self.ends[node])]


def leaf_pairs(A, C, low, high):
    """Pairs of leaves that may hold a wanted score, and the upper bounds of their scores. low, high: the window of each node of A."""
    a = c = np.zeros(1, int)
    out = []
    while len(a):
        four = [x[a] * y[c] for x in (A.lo, A.hi) for y in (C.lo, C.hi)]
        upper, lower, room = np.max(four, 0).sum(1), np.min(four, 0).sum(1), np.abs(four).max(0).sum(1) * 1e-9
        ok = (upper + room >= low[a]) & (lower - room <= high[a])
        a, c, upper = a[ok], c[ok], (upper + room)[ok]
        la, lc = A.left[a], C.left[c]
        leaf = (la < 0) & (lc < 0)
        out.append((a[leaf], c[leaf], upper[leaf]))
        a, c, la, lc = (x[~leaf] for x in (a, c, la, lc))
        opened = [((la >= 0) | (i == 0)) & ((lc >= 0) | (j == 0)) for i in (0, 1) for j in (0, 1)]
        nexts = [(np.where(la < 0, a, la + i), np.where(lc < 0, c, lc + j)) for i in (0, 1) for j in (0, 1)]
        a, c = (np.concatenate([x[k][o] for x, o in zip(nexts, opened)]) for k in (0, 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def products(a, c):
    """Inner products of whole numbers, exactly."""
    most = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(c).max(initial=0))
    if most < 1 << 53:
        return (a.astype(float) @ c.T.astype(float)).astype(np.int64)
    return a @ c.T if most < 1 << 63 else (a.astype(object) @ c.T.astype(object))


def answers(same, k):
    """Of each ask of a block the first k rows of the other block, of the same or of other labels, with scores from lo to hi."""
    def run(key, asks, rows):
        out = []
        if len(asks) and len(rows):
            dim = asks.column("dim")[0].as_py()
            X, Y = matrix(asks.column("vec"), dim), matrix(rows.column("vec"), dim)
            low, high = (np.array([x if y is None else y for y in asks.column(c).to_pylist()], float) for c, x in (("lo", -np.inf), ("hi", np.inf)))
            lo, hi = asks.column("lo").to_pylist(), asks.column("hi").to_pylist()
            own, label = asks.column("anchor_id").to_numpy(), asks.column("label").to_numpy()
            ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            A, C = Tree(X.astype(float)), Tree(Y.astype(float))
            a, c, upper = leaf_pairs(A, C, *(np.array([f(v[A.rows(n)]) for n in range(len(A.ends))]) for f, v in ((np.min, low), (np.max, high))))
            for leaf in np.unique(a):
                mine = A.rows(leaf)
                best, floor = [([], []) for _ in mine], [-np.inf if lo[i] is None else lo[i] for i in mine]
                order = np.flatnonzero(a == leaf)
                order = order[np.argsort(-upper[order], kind="stable")]
                for at in range(0, len(order), AT_ONCE):
                    if upper[order[at]] < min(floor):
                        break
                    theirs = np.concatenate([C.rows(n) for n in c[order[at:at + AT_ONCE]]])
                    score = products(X[mine], Y[theirs])
                    for j, i in enumerate(mine):
                        fit = (score[j] >= floor[j]) & ((labels[theirs] == label[i]) == same) & (ids[theirs] != own[i])
                        if hi[i] is not None:
                            fit &= score[j] <= hi[i]
                        fit = np.flatnonzero(fit)
                        if len(fit):
                            s, t = np.concatenate([best[j][0], score[j][fit]]).astype(score.dtype), np.concatenate([best[j][1], ids[theirs[fit]]]).astype(np.int64)
                            first = np.lexsort((t, -s))[:k]
                            best[j] = s[first], t[first]
                            if len(first) == k:
                                floor[j] = best[j][0][-1]
                out += [(int(own[i]), asks.column("positive_id")[int(i)].as_py(), hi[i], int(t), int(s)) for i, b in zip(mine, best) for s, t in zip(*b)]
        cols = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "positive_id", "hi", "vec_id", "score"])
    return run


def met(asks, rows, pairs, same, k):
    """The answers of all pairs of blocks. pairs: dim, apart, cpart; asks and rows have dim, part, block and the number of their part's blocks."""
    key = ["dim", "apart", "ablock", "cpart", "cblock"]
    ends = pairs.join(asks.select("dim", F.col("part").alias("apart"), F.col("blocks").alias("ablocks")).distinct(), ["dim", "apart"]).join(rows.select("dim", F.col("part").alias("cpart"), F.col("blocks").alias("cblocks")).distinct(), ["dim", "cpart"])
    left = asks.withColumnsRenamed({"part": "apart", "block": "ablock"}).join(ends.select("dim", "apart", "cpart", F.explode(F.sequence(F.lit(0), F.col("cblocks") - 1)).alias("cblock")), ["dim", "apart"])
    right = rows.withColumnsRenamed({"part": "cpart", "block": "cblock"}).join(ends.select("dim", "apart", "cpart", F.explode(F.sequence(F.lit(0), F.col("ablocks") - 1)).alias("ablock")), ["dim", "cpart"])
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(answers(same, k), FOUND)


def blocked(df, parts, most):
    """df with the block of each row, by its id, and its part's number of blocks."""
    return df.join(blocks(parts, most), ["dim", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))


def first(found, k):
    """rank and the first k rows of each ask."""
    best = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def mine(rows, chosen, positives=5, negatives=5, least=80):
    """anchor_id, positive_id, rank, negative_id and both scores: for each anchor and each of its first positives (other rows of its label)
    the first rows of other labels whose scores are from least % of the positive's up to it. chosen: which rows are anchors, a condition on vec_id and label."""
    own = written(whole(rows))
    anchors = own.filter(chosen)
    index = written(dealt(own, cuts(own, PART_ROWS)))
    asks = written(dealt(anchors, cuts(anchors, PART_ASKS)))
    held, asked = written(boxes(index)), written(boxes(asks))
    index = blocked(index, held, ROWS)
    pairs = written(part_pairs(asked, held))

    asks = blocked(asks, asked, ASKS).withColumnRenamed("vec_id", "anchor_id").withColumn("positive_id", F.lit(None).cast("long"))
    none = F.lit(None).cast("long")
    start = written(met(asks.withColumns({"lo": none, "hi": none}), index, pairs.filter("likeliest = 1"), True, positives))
    floor = first(start, positives).groupBy("anchor_id").agg(F.when(F.count("*") == positives, F.min("score")).alias("lo"))
    known = written(asks.join(floor, "anchor_id", "left"))
    room = known.groupBy("dim", F.col("part").alias("apart")).agg(F.when(F.count("lo") == F.count("*"), F.min("lo")).alias("lo"))
    others = pairs.filter("likeliest > 1").join(room, ["dim", "apart"]).filter("lo is null or upper >= lo")
    more = met(known.withColumn("hi", none), index, others.select("dim", "apart", "cpart"), True, positives)
    good = first(start.union(more), positives).filter("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("hi"))

    # The least whole number of at least so many percent, without products beyond a long number.
    lo = F.expr(f"hi - (hi div 100) * {100 - least} - ((hi % 100) * {100 - least}) div 100")
    wanted = written(asks.drop("positive_id", "blocks", "block").join(good, "anchor_id").withColumn("lo", lo))
    count = wanted.groupBy("dim", "part").agg(F.count("*").alias("n"))
    room = wanted.groupBy("dim", F.col("part").alias("apart")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = pairs.join(room, ["dim", "apart"]).filter("upper >= lo and lower <= hi").select("dim", "apart", "cpart")
    spread = wanted.join(blocks(count, ASKS), ["dim", "part"]).withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.col("blocks")).cast("int"))
    found = first(met(spread, index, near, False, negatives), negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("hi").alias("positive_score"), F.col("score").alias("negative_score"))
