"""Near-duplicates by DartMinHash over five-word shingles weighted by their counts.

Every unit of an element's weight is a column onto which a hashed Poisson process throws darts; a dart has a rank, a place within the unit and
a coordinate. Darts under a document's rank bound that fall inside its region count, and each coordinate keeps the earliest, so two
signatures agree at a coordinate with the probability of weighted Jaccard similarity. Signatures join in BANDS bands; equal texts are one
node. What can't be linked is left out before pairs are formed: two nodes share at most the units that are not theirs alone, so a node with too many
units of its own (among all nodes that share a bucket with another) has no partner, or none in buckets of nodes as large as these; and two nodes differ in at least as many units as the bits of their parities. Of what is left, the node
of each bucket with the fewest units of its own leads, and is compared with all others. While the pairs across classes of buckets, or those of them
that a round's leaders let expect, are more than the nodes of all buckets, LEADERS nodes drawn from each bucket (four times as many each round) are compared with all
its others and leave it. At last come all pairs of a bucket that are left and whose nodes are not yet connected. So large groups cost pairs by their rows, not by the square of them. A link holds at similarity 0.8 or more, computed on the units themselves, and every pair of a bucket is compared, excluded by its
bounds or already connected. Texts of under five words have one shingle, all their words; null,
empty and wordless texts have none and match only their equals (null as empty). Rows of equal texts are one node whatever their doc_ids, null or repeated. Returns
doc_id and class_id (the class's least doc_id; null if none of its rows has one) for all rows; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cindergrid.llm.graph import components
from cindergrid.llm.textkit import blocks, discard, mapped, marked, mix, shingles, words, written

K, BANDS, N, BITS, LEADERS = 120, 24, 5, 1024, 4
GOLD = np.uint64(0x9E3779B97F4A7C15)


def elements(data, offs):
    """Unit hashes and rows: the c-th copy of a shingle in a row is a unit of its own, of weight 1."""
    h, row, _, _ = words(data, offs)
    s, at = shingles(h, row, N)
    srow = row[at]
    count = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < N))
    if len(short):
        first = np.searchsorted(row, short)
        whole = np.array([np.bitwise_xor.reduce(mix(h[f:f + count[r]] + GOLD * np.arange(1, count[r] + 1, dtype=np.uint64))) for r, f in zip(short, first)], np.uint64)
        s, srow = np.concatenate([s, whole]), np.concatenate([srow, short])
    order = np.lexsort((s, srow))
    s, srow = s[order], srow[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (srow[1:] != srow[:-1])
    start = np.flatnonzero(new)
    copy = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return mix(s + GOLD * copy.astype(np.uint64)), srow


def unit(h):
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def signatures(units, row, n, k=K):
    """n x k: the hash of each coordinate's earliest dart; rows without elements are zero."""
    sig, rank = np.zeros((n, k), np.uint64), np.full((n, k), np.inf)
    weight = np.bincount(row, minlength=n)
    open_rows = weight > 0
    bound = np.where(open_rows, k * (np.log(k) + 3) / np.maximum(weight, 1), 0)
    while open_rows.any():
        live = np.flatnonzero(open_rows[row])
        u, r, at, step = units[live], row[live], np.zeros(len(live)), 0
        while len(u):
            step += 1
            d = mix(u + np.uint64(step * int(GOLD) % 2**64))
            at = at - np.log(unit(d))
            ok = at <= bound[r]
            u, r, at, d = u[ok], r[ok], at[ok], d[ok]
            j = (mix(d + GOLD) % np.uint64(k)).astype(np.int64)
            order = np.lexsort((d, at, r * k + j))
            cell = (r * k + j)[order]
            first = order[np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))] if len(cell) else order
            better = at[first] < rank[r[first], j[first]]
            first = first[better]
            rank[r[first], j[first]], sig[r[first], j[first]] = at[first], d[first]
        open_rows &= np.isinf(rank).any(1)
        bound *= 2
    return sig


def bands(sig):
    r = sig.shape[1] // BANDS
    h = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(r):
        h = mix(h * GOLD + sig[:, k::r][:, :BANDS])
    return h.view(np.int64)


def text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def sign(docs):
    """doc_id, key (of equal texts), n (number of units), bands (empty without words)."""
    def run(it):
        for batch in it:
            for lo, hi, data, offs in blocks(batch.column(2), 1 << 20):
                u, row = elements(data, offs)
                b, count = bands(signatures(u, row, hi - lo)), np.bincount(row, minlength=hi - lo)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array([x if y else [] for x, y in zip(b, count)], pa.list_(pa.int64()))], names=["doc_id", "key", "n", "bands"])
    return mapped(docs.select("doc_id", text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, key binary, n long, bands array<long>")


def parities(units, row, n):
    """n x BITS / 64 longs: the parity of how many units of each row fall on each of BITS places; two rows differ in at least as many units as places."""
    out = np.zeros((n, BITS // 64), np.int64)
    for lo in range(0, n, 1024):
        a, b = np.searchsorted(row, [lo, lo + 1024])
        m = min(1024, n - lo)
        odd = np.bincount((row[a:b] - lo) * BITS + (units[a:b] % np.uint64(BITS)).astype(np.int64), minlength=m * BITS) % 2
        out[lo:lo + m] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(m, -1)
    return out


def with_units(texts):
    """id, units and parity of texts (id, text)."""
    def run(it):
        for batch in it:
            for lo, hi, data, offs in blocks(batch.column(1), 1 << 20):
                u, row = elements(data, offs)
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                width = np.arange(hi - lo + 1, dtype=np.int32) * (BITS // 64)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(u.view(np.int64))), pa.ListArray.from_arrays(pa.array(width), pa.array(parities(u, row, hi - lo).ravel()))], names=["id", "units", "parity"])
    return mapped(texts, run, "id long, units array<long>, parity array<long>")


def similarity(a, b):
    """Weighted Jaccard of two texts' units."""
    x, y = (elements(t, np.array([0, len(t)]))[0] for t in (np.frombuffer(v.encode(), np.uint8) for v in (a, b)))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


#: What nodes of na and nb units, qa and qb of which no other node has, can have in common: at most na - qa and nb - qb.
POSSIBLE = "9 * qa <= 5 * na - 4 * nb and 9 * qb <= 5 * nb - 4 * na and 9 * (qa + qb) <= na + nb"
#: They differ in as many units as bits of their parities at least.
NEAR = "9 * aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v) <= na + nb"


def similar(pairs, units):
    """The pairs (a, b) of similarity 0.8 or more."""
    both = pairs.join(units.toDF("a", "ua"), "a").join(units.toDF("b", "ub"), "b")
    both = both.select("a", "b", F.size("ua").alias("na"), F.size("ub").alias("nb"), F.size(F.array_intersect("ua", "ub")).alias("both"))
    return both.filter("9 * both >= 4 * (na + nb)").select("a", "b")


def several(rows):
    """Buckets whose nodes are of several classes c: h, k nodes, the largest class (big) and the pairs across classes."""
    own = rows.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.sum("m").alias("k"), F.max(F.struct("m", "c")).alias("of"), F.sum(F.expr("m * m")).alias("same"), F.count("*").alias("classes"))
    return own.filter("classes > 1").selectExpr("h", "k", "of.c big", "(k * k - same) / 2 across")


def linked(docs, nodes):
    """Links (a, b) between ids of nodes, or None where no bucket has two nodes."""
    rows = nodes.select("id", "n", "key", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("h"), "id", "n", "key")
    shared = rows.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    rows = written(rows.join(shared, "h"))
    if rows.isEmpty():
        return None
    own = rows.groupBy("id").agg(F.any_value("key").alias("key"))
    texts = docs.select(text_key().alias("key"), "text").filter(marked(own, "key")).groupBy("key").agg(F.any_value("text").alias("text"))
    units = written(with_units(texts.join(own, "key").select("id", "text")))
    alone = units.select("id", F.explode("units").alias("u")).groupBy("u").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("q"))
    able = rows.select("h", "id", "n").join(alone, "id", "left").select("h", "id", "n", F.coalesce("q", F.lit(0)).alias("q")).filter("5 * q <= n")
    bucket = able.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("k")).filter("k > 1")
    able = able.join(bucket, "h").filter("5 * n - 9 * q >= 4 * least").select("h", "id", "n", "q")
    able = written(able.join(units.select("id", F.col("parity").alias("s")), "id"))
    units = units.select("id", "units")
    first = able.groupBy("h").agg(F.min(F.struct("q", F.xxhash64("id").alias("x"), "id", "n")).alias("of")).selectExpr("h", "of.id b", "of.n nb", "of.q qb")
    pairs = able.selectExpr("h", "id a", "n na", "q qa").join(first, "h").filter("a <> b and " + POSSIBLE)
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = written(similar(pairs, units))
    discard(pairs, rows)
    limit, count, more, old = able.count(), LEADERS, None, []
    rows = able
    while True:
        rows = rows.join(components(links).toDF("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        rows = written(rows.join(several(rows), "h"))
        if (more is not None and more <= limit) or (rows.agg(F.sum(F.expr("across / k"))).first()[0] or 0) <= limit:
            break
        lead = rows.groupBy("h", F.pmod(F.xxhash64("id", F.lit(count)), F.lit(count)).alias("part")).agg(F.min(F.struct(F.xxhash64("id", F.lit(-count)).alias("x"), "id", "n", "q", "s", "c")).alias("of"))
        lead = written(lead.selectExpr("h", "of.id b", "of.n nb", "of.q qb", "of.s sb", "of.c cb"))
        pairs = rows.selectExpr("h", "id a", "n na", "q qa", "s sa", "c ca", "k").join(lead, "h").filter(f"ca <> cb and {POSSIBLE} and {NEAR}")
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "k"))
        old += [links, rows, lead, pairs]
        links = written(links.union(similar(pairs.select("a", "b").distinct(), units)))
        rows = rows.join(lead.selectExpr("h", "b id"), ["h", "id"], "left_anti").select("h", "id", "n", "q", "s")
        more = pairs.agg(F.sum(F.expr(f"k / (2 * least({count}, k))"))).first()[0] or 0
        count *= 4
    least = rows.filter("c <> big").selectExpr("h", "id a", "n na", "q qa", "s sa", "c ca", "big")
    pairs = least.join(rows.selectExpr("h", "id b", "n nb", "q qb", "s sb", "c cb"), "h").filter(f"ca <> cb and (cb = big or a < b) and {POSSIBLE} and {NEAR}")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = written(links.union(similar(pairs, units)))
    discard(pairs, links, rows, able, *old)
    return out


def classes(docs):
    """doc_id, key, class (an id of its own), class_id (its least doc_id) of all rows."""
    docs = docs.select("doc_id", "text")
    signed = written(sign(docs))
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.any_value(F.struct("n", "bands")).alias("own"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "key", "least", "own.*"))
    links = linked(docs, nodes)
    own = nodes.select("id", "key", "least")
    if links is None:
        own = own.withColumn("class", F.col("id")).withColumn("class_id", F.col("least"))
    else:
        own = own.join(components(links).toDF("id", "c"), "id", "left").select("key", "least", F.coalesce("c", "id").alias("class"))
        named = own.groupBy("class").agg(F.min("least").alias("class_id"))
        own = own.join(named, "class")
    return signed.select("doc_id", "key").join(own.select("key", "class", "class_id"), "key")


def near_duplicates(docs):
    return classes(docs).select("doc_id", "class_id")


def keep_one(docs):
    """One row of each class, with all columns: one of least doc_id, or of none if none of its rows has one."""
    least = classes(docs).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key")).alias("of")).select("of.doc_id", "of.key")
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("bare"), text_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = least.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("bare"), "key")
    out = rows.join(kept, ["d", "bare", "key"], "left_semi").groupBy("d", "bare", "key").agg(F.any_value("row").alias("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
