"""Benchmark decontamination: rare n-gram seeds join texts to test items, then Smith-Waterman aligns words.

Seeds are runs of SEED words of an item (all its words, if it has fewer). How many items have a run is counted over all items in Spark. Of each stretch of
STRETCH runs an item keeps those that are in at most RARE items, or all if the stretch has none so rare, so that an item of a family of like ones keeps seeds
everywhere. Documents are scanned whole against a bit table of the seeds, of BITS bits however many there are (a fuller one lets more runs through), and what it lets through
joins with the seeds themselves; only texts with such runs are shuffled, equal ones once. Windows around the seeds' places are aligned; the score is the alignment's score over the item's best
possible, and a document leaks an item at THRESHOLD or more. Null and empty texts and items match nothing; repeated rows
are reported for each; rows without ids are reported without, and clean() finds them by their texts; columns of any names stay; an empty table gives no rows. Returns doc_id, item_id, score, start, end (words), the best window of each pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from cindergrid.llm.textkit import blocks, discard, mapped, shingles, words, written

SEED, STRETCH, RARE, BITS, PROBES, THRESHOLD, MATCH, MISS, GAP = 4, 12, 3, 1 << 24, 3, 0.6, 2, -1, -1


def align(item, text):
    """Best local alignment (linear gaps): score over 2 * len(item), first and last word in text."""
    m = len(text)
    row, begin = np.zeros(m + 1, np.int32), np.arange(m + 1)
    best, step = (0, 0, 0), np.arange(m + 1, dtype=np.int32)
    for w in item:
        diag = row[:-1] + np.where(text == w, MATCH, MISS).astype(np.int32)
        up = row[1:] + GAP
        new, nb = np.zeros(m + 1, np.int32), np.arange(m + 1)
        take = (diag >= up) & (diag > 0)
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        nb[1:] = np.where(take, begin[:-1], np.where(up > 0, begin[1:], nb[1:]))
        lead = new - GAP * step
        at = np.maximum.accumulate(np.where(lead == np.maximum.accumulate(lead), step, 0))
        run = lead[at] + GAP * step
        better = run > new
        new, nb = np.where(better, run, new), np.where(better, nb[at], nb)
        row, begin = new, nb
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best[0] / (MATCH * max(1, len(item))), best[1], best[2]


def words_of(benchmark):
    """item (a row of the benchmark), item_id, words (their hashes) of items that have some."""
    def run(it):
        for batch in it:
            out = []
            for lo, hi, data, offs in blocks(batch.column(2)):
                h, row, _, _ = words(data, offs)
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                out.append(pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["item", "item_id", "words"]))
            yield from out
    own = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return own.mapInArrow(run, "item long, item_id long, words array<long>").filter("size(words) > 0")


def seeds_of(items):
    """item, n, s of the runs of n words that seed each item."""
    def run(it):
        for batch in it:
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = own.values.to_numpy().view(np.uint64)
                n = min(SEED, len(h))
                s, at = shingles(h, np.zeros(len(h), np.int64), n)
                yield pa.record_batch([pa.array(np.full(len(s), item)), pa.array(np.full(len(s), n, np.int32)), pa.array(s.view(np.int64)), pa.array(at // STRETCH)], names=["item", "n", "s", "stretch"])
    runs = written(items.select("item", "words").mapInArrow(run, "item long, n int, s long, stretch long"))
    kinds = runs.select("item", "n", "s").distinct().groupBy("n", "s").agg(F.count("*").alias("c"))
    least = F.min("c").over(W.partitionBy("item", "stretch"))
    return runs.join(kinds, ["n", "s"]).withColumn("least", least).filter(f"c <= {RARE} or least > {RARE}").select("item", "n", "s").distinct()


def probe(s, k):
    return F.shiftrightunsigned(s, 20 * k).bitwiseAND(F.lit(BITS - 1).cast("bigint"))


def bit_table(seeds):
    """The seeds' bits as 64-bit words: at most BITS / 64 numbers reach the driver."""
    place = seeds.select(F.explode(F.array(*[probe(F.col("s"), k) for k in range(PROBES)])).alias("p"))
    rows = place.groupBy((F.col("p") / 64).cast("int").alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("v")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for r in rows:
        out[r.k] = r.v
    return out.view(np.uint64)


def hits(docs, seeds):
    """doc_id, key (of the text), text, runs (n, s, at) of documents with runs that the bit table lets through."""
    table, lengths = docs.sparkSession.sparkContext.broadcast(bit_table(seeds)), [r.n for r in seeds.select("n").distinct().collect()]
    kind = pa.list_(pa.struct([("n", pa.int32()), ("s", pa.int64()), ("at", pa.int64())]))

    def run(it):
        bits = table.value
        for batch in it:
            for lo, hi, data, offs in blocks(batch.column(2)):
                h, row, _, _ = words(data, offs)
                first, found = np.searchsorted(row, np.arange(hi - lo + 1)), [[] for _ in range(3)]
                for n in lengths:
                    s, at = shingles(h, row, n)
                    ok = np.ones(len(s), bool)
                    for k in range(PROBES):
                        p = (s >> np.uint64(20 * k)) & np.uint64(BITS - 1)
                        ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
                    for v, x in zip(found, (np.full(int(ok.sum()), n, np.int32), s[ok].view(np.int64), at[ok])):
                        v.append(x)
                n, s, at = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
                if not len(s):
                    continue
                order = np.argsort(row[at], kind="stable")
                n, s, at = n[order], s[order], at[order]
                own, size = np.unique(row[at], return_counts=True)
                runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(s), pa.array(at - first[row[at]])], fields=list(kind.value_type)))
                pick = pa.array(own + lo)
                yield pa.record_batch([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), runs], names=["doc_id", "key", "text", "runs"])
    return mapped(docs.select("doc_id", text_key().alias("key"), "text"), run, "doc_id long, key binary, text string, runs array<struct<n:int,s:long,at:long>>")


def text_key():
    return F.unhex(F.md5("text"))


def best_window(item, text, places):
    """Score, first and last word of the item's best alignment around places of its seeds in the text."""
    reach, best = len(item) + len(item) // 2 + 4, (0.0, 0, 0)
    a = max(0, places[0] - reach)
    for p, q in zip(places, [*places[1:], None]):
        if q is None or q - p > 2 * reach:
            score, x, y = align(item, text[a:p + reach])
            best = max(best, (score, a + x, a + y), key=lambda z: z[0])
            a = max(0, q - reach) if q is not None else 0
    return best


def aligned(pairs):
    """key, item_id, score, start, end of pairs (key, item_id, text, words, places) at THRESHOLD or more."""
    def run(it):
        for batch in it:
            out = []
            for k in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[k].as_py().encode(), np.uint8)
                found = best_window(batch.column(3)[k].values.to_numpy().view(np.uint64), words(raw, np.array([0, len(raw)]))[0], batch.column(4)[k].as_py())
                if found[0] >= THRESHOLD:
                    out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), *found))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["key", "item_id", "score", "start", "end"])
    return mapped(pairs.select("key", "item_id", "text", "words", "places"), run, "key binary, item_id long, score double, start long, end long")


def leaks(docs, benchmark):
    """(doc_id, key of documents with seeds, key, item_id, score, start, end of leaking texts)."""
    items = written(words_of(benchmark))
    seeds = written(seeds_of(items))
    found = written(hits(docs, seeds))
    texts = found.groupBy("key").agg(F.any_value(F.struct("text", "runs")).alias("of")).select("key", "of.*")
    places = texts.select("key", F.inline("runs")).join(seeds, ["n", "s"]).groupBy("key", "item").agg(F.sort_array(F.collect_list("at")).alias("places"))
    out = written(aligned(places.join(items, "item").join(texts.select("key", "text"), "key")))
    discard(items, seeds)
    return found.select("doc_id", "key"), out


def contaminated(docs, benchmark):
    """Leaking (document, item) pairs."""
    found, out = leaks(docs, benchmark)
    return found.join(out, "key").select("doc_id", "item_id", "score", "start", "end")


def clean(docs, benchmark):
    """docs without those that leak an item."""
    bad = leaks(docs, benchmark)[1].select("key").distinct()
    rows = docs.select(F.coalesce(text_key(), F.lit(b"")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(bad, "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
