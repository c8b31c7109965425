"""Periodic runs of words: repeated k-gram masking, then Main and Lorentz's divide and conquer on what survives.

A run is a stretch of words with smallest period q (words q apart are identical), of at least max(LEAST, TIMES * q) words, that no neighbouring word
extends. The two copies of a run, q apart, share at least max(LEAST, TIMES * q) - q words, least for q = 1: K = LEAST - 1. So each word of a run lies in a
K-gram that occurs twice in its document; the others are masked, and no run crosses a masked word, nor is extended by one. Surviving segments of a block
of documents, parted by signs that occur once, are searched together. A segment is halved again and again; a run that holds a half's centre has two periods
at least on one side of it, so the grams at the centre and one period away are equal: only such pairs are extended, both ways, by comparing prefix hashes
with two prime moduli in a binary search. Of the runs with the same ends the least period is kept, and each run is compared word by word;
if one fails (hashes collided), the block is searched again with other bases.

Null and empty texts, and texts of fewer than LEAST words, have no runs. Texts are searched whole, in memory that grows with the longest; rows are not compared with each other, so null and
repeated ids are rows of their own; an empty table gives no rows; of other columns, also of clashing names, none is kept.
"""

import re

import numpy as np
import pyarrow as pa

LEAST, TIMES = 6, 4
K = LEAST - 1
BLOCK = 1 << 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


def words_of(doc_id, text):
    return WORD.findall(text)


def grams(w):
    """A number for each run of K values: equal runs have equal numbers (and hardly any others have)."""
    g = np.zeros(max(0, len(w) - K + 1), np.uint64)
    for j in range(K):
        g = g * np.uint64(0x9E3779B97F4A7C15) + w[j:j + len(g)].astype(np.uint64)
    return g


def masked(w):
    """Which values lie in a K-gram that occurs twice."""
    g = grams(w)
    order = np.argsort(g)
    again = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    at = np.unique(np.concatenate([order[again], order[again + 1]]))
    cover = np.bincount(at, minlength=len(w) + 1) - np.bincount(at + K, minlength=len(w) + 1)
    return np.cumsum(cover[:-1]) > 0


class Prefixes:
    """Hashes of prefixes, with two moduli."""

    def __init__(self, w, seed):
        rng = np.random.default_rng(seed)
        self.n, self.sums, self.powers = len(w), [], []
        for p in PRIMES:
            value, base = rng.integers(1, p, int(w.max()) + 1), int(rng.integers(1 << 20, p - 1))
            power, step = np.ones(len(w) + 1, np.int64), 1
            while step <= len(w):  # doubling: the next step powers are those before, times base ** step
                power[step:2 * step] = power[:len(power[step:2 * step])] * pow(base, step, p) % p
                step *= 2
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(value[w] * power[:-1] % p) % p]))

    def equal(self, a, b, n):
        """Whether n values from a on equal those from b on; a is before b."""
        ok = np.ones(len(a), bool)
        for p, s, x in zip(PRIMES, self.sums, self.powers):
            ok &= (s[a + n] - s[a]) % p * x[b - a] % p == (s[b + n] - s[b]) % p
        return ok

    def extent(self, a, b, most, back):
        """How many values from a and b on (or before them) are equal, at most so many."""
        low, step = np.zeros(len(a), np.int64), 1 << int(self.n).bit_length()
        while step:
            now = low + step
            can = np.flatnonzero(now <= most)
            off = now[can] if back else low[can]
            good = self.equal(a[can] - off, b[can] - off, np.full(len(can), step)) if back else self.equal(a[can] + off, b[can] + off, np.full(len(can), step))
            low[can[good]] += step
            step >>= 1
        return low


def pairs(w, gram, lo, centre, hi, most):
    """Places (a, a + q) whose grams are equal, for centres of the stretches lo..hi and periods up to a fourth of them: from the centre on, and up to it."""
    out = []
    size = np.maximum(1, np.minimum(hi - lo, most) // TIMES)
    number = np.repeat(np.arange(len(lo)), size)
    q = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size) + 1
    c, lo, hi = centre[number], lo[number], hi[number]
    for first, ok in ((c, c + q < hi), (c - q - np.minimum(q, K), c - q - np.minimum(q, K) >= lo)):
        # A side of two periods holds two grams of min(q, K) words, q apart; short periods are told by their first word.
        a, d = first[ok], q[ok]
        short = d < K
        same = np.where(short, w[a] == w[a + d], gram[a] == gram[a + d])
        out.append((a[same], d[same]))
    return tuple(np.concatenate(x) for x in zip(*out))


def find(w, most, seed=0):
    """start, end, period of all runs of a row of numbers in which numbers that occur once part segments of at most so many."""
    gram = grams(np.concatenate([w, np.full(K - 1, -1)]))
    hashes, got = Prefixes(w, seed), []
    parts = 1
    while -(-len(w) // parts) >= LEAST:
        edge = np.arange(parts + 1) * len(w) // parts
        centre = (2 * np.arange(parts) + 1) * len(w) // (2 * parts)
        a, q = pairs(w, gram, edge[:-1], centre, edge[1:], most)
        after = hashes.extent(a, a + q, len(w) - a - q, False)
        before = hashes.extent(a, a + q, a, True)
        long = after + before + q >= np.maximum(LEAST, TIMES * q)
        got.append(np.stack([a - before, a + q + after, q])[:, long])
        parts *= 2
    s, e, q = np.concatenate(got, axis=1) if got else np.zeros((3, 0), int)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[first], e[first], q[first]
    if not all(np.array_equal(w[x:y - z], w[x + z:y]) for x, y, z in zip(s, e, q)):
        return find(w, most, seed + 1)
    return s, e, q


def runs_of(texts):
    """start, length, period of the runs of each list of words, by start and then period."""
    sizes = np.array([len(t) for t in texts])
    ids = pa.array([x for t in texts for x in t], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    # One sign after each text, below all words.
    place = np.cumsum(sizes + 1) - (sizes + 1)
    w = np.empty(len(ids) + len(texts), np.int64)
    ends = place + sizes
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = ids, -1 - np.arange(len(texts))
    keep = masked(w) & inner
    out = [[] for _ in texts]
    if keep.any():
        first = np.flatnonzero(keep & ~np.concatenate([[False], keep[:-1]]))
        last = np.flatnonzero(keep & ~np.concatenate([keep[1:], [False]])) + 1
        # The masked word (or sign) after each segment stands for all up to the next, as a number of its own.
        take = keep.copy()
        take[np.minimum(last, len(w) - 1)] = True
        origin = np.flatnonzero(take)
        packed = np.unique(w[origin], return_inverse=True)[1]
        part = ~keep[origin]
        packed[part] = packed.max() + 1 + np.arange(part.sum())
        s, e, q = find(packed, int((last - first).max()))
        start = origin[s]
        row = np.searchsorted(ends, start)
        for r, x, n, p in sorted(zip(row.tolist(), (start - place[row]).tolist(), (e - s).tolist(), q.tolist())):
            out[r].append((x, n, p))
    return out


def collapsed(words, runs):
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def find_runs(docs, words=words_of):
    """doc_id, n_words, runs (by start, then period) and text: the words left when each run is cut to its first period, joined by one space.

    words: makes a list of words of a doc_id and a text; white space parts them by default.
    """
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def block(ids, texts):
        found = runs_of(texts)
        left = [" ".join(collapsed(t, r)) for t, r in zip(texts, found)]
        runs = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in found]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(runs, kind), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "text"])

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(words(ids[-1], batch.column(1)[i].as_py() or ""))
                size += len(texts[-1])
                if size > BLOCK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {SCHEMA}")
