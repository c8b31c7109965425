"""Best-two-fit packing of tokenised documents into sequences.

Each task tokenises its rows and packs their pieces in pools, so nothing is shuffled: bins of a pool that stay loose go back
to the next pool, and a task leaves at most a few loose bins. Ids of words that a worker has met are kept (about KEPT short words), as
the tokenizer encodes each word by itself; texts with other scripts or with its special tokens are encoded whole. Null and empty texts are one piece (the closing id 0). A text
is never cut short; rows of equal doc_id are packed as separate documents; an empty table gives no rows.
"""

import json
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from cindergrid.llm.textkit import mapped

#: Words of at most SHORT characters are kept, with their ids, until there are more than KEPT.
SIZE, POOL, KEPT, SHORT = 2048, 20000, 1 << 17, 64
#: Scripts whose letters, digits and spaces are the same in all versions of the tables that the patterns use.
OTHER = re.compile(r"[^\u0000-\u052f]")
SPACE = "\\t-\\r \x85\xa0"
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"


def default_tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def word_pattern():
    """The byte-level pre-tokenizer's pattern, with classes written out for the scripts that OTHER lets through."""
    def class_of(kind):
        return "".join(re.escape(c) for c in map(chr, range(0x530)) if unicodedata.category(c)[0] == kind)
    letter, number = class_of("L"), class_of("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@cache
def encoder(path):
    """A function from a text to the tokenizer's ids, as little-endian bytes; one for each Python worker."""
    from tokenizers import Tokenizer

    tok, pattern = Tokenizer.from_file(path), word_pattern()
    how = json.loads(tok.to_str())
    split, special = how["pre_tokenizer"] or {}, [t["content"] for t in how["added_tokens"]]
    plain = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and not how["normalizer"]

    def whole(text):
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    merge, gap, kept = tok.model.tokenize, signs[255], {}
    # No byte of UTF-8 is 255; words can be encoded together with it between them if no token but its own holds it.
    between = tok.token_to_id(gap)
    plain = plain and between is not None and sum(gap in t for t in tok.get_vocab()) == 1

    def learn(new):
        """Keeps the ids of words, all encoded in one call."""
        ids = np.array([t.id for t in merge(b"\xff".join([w.encode() for w in new]).decode("latin-1").translate(signs))], "<u4")
        data, at = ids.tobytes(), 0
        for w, end in zip(new, [*np.flatnonzero(ids == between).tolist(), len(ids)]):
            kept[w] = data[4 * at:4 * end]
            at = end + 1

    def encode(text):
        if not plain or OTHER.search(text) or any(t in text for t in special):
            return whole(text)
        if len(kept) > KEPT:
            kept.clear()
        words = pattern.findall(text)
        new = set(words).difference(kept)
        if new:
            learn(new)
        ids = b"".join(map(kept.__getitem__, words))
        for w in new:
            if len(w) > SHORT:
                del kept[w]
        return ids
    return encode


def fill(lengths, size, final, slack=8):
    """Bins as lists of indices, and the indices put back because their bin was left loose."""
    by, mask, bins, back = {}, 0, [], []
    for i, n in enumerate(lengths):
        by.setdefault(n, []).append(i)
        mask |= 1 << n

    def take(n):
        nonlocal mask
        i = by[n].pop()
        if not by[n]:
            mask &= ~(1 << n)
        return i

    def put(i):
        nonlocal mask
        by[lengths[i]].append(i)
        mask |= 1 << lengths[i]

    def below(n):
        return (mask & ((2 << n) - 1)).bit_length() - 1 if n > 0 else -1

    while mask:
        own, gap = [take(mask.bit_length() - 1)], size - (mask.bit_length() - 1)
        gap = size - lengths[own[0]]
        while gap and (n := below(gap)) > 0:
            own.append(take(n))
            gap -= n
        if gap:
            least = min(own, key=lengths.__getitem__)
            room, best, a = gap + lengths[least], (lengths[least], 0, 0), None
            a = below(room - 1)
            while a > 0 and 2 * a >= best[0] and best[0] < room:
                b = below(min(room - a, a))
                if b == a and len(by[a]) < 2:
                    b = below(a - 1)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = below(a - 1)
            if best[1]:
                two = [take(best[1]), take(best[2])]
                own.remove(least)
                put(least)
                own += two
                gap = room - best[0]
        if gap > slack and not final:
            back += own
        else:
            bins.append(own)
    return bins, back


def packer(path, size, with_ids):
    def run(it):
        encode = encoder(path)
        pool, done = [], TaskContext.get().partitionId() << 33

        def flush(final):
            nonlocal pool, done
            bins, back = fill([p[3] for p in pool], size, final)
            rows = []
            for own in bins:
                at = 0
                for i in own:
                    *where, ids = pool[i]
                    rows.append((*where, zlib.crc32(ids), done, at, ids))
                    at += where[3]
                done += 1
            pool = [pool[i] for i in back]
            for k in range(0, len(rows), 4096):
                cols = list(zip(*rows[k:k + 4096]))[:None if with_ids else -1]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")][:len(cols)])

        for batch in it:
            doc, text = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(doc), 64):
                for d, t in zip(doc[lo:lo + 64], text.slice(lo, 64).to_pylist()):
                    ids = encode(t or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    cut = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    pool += [(d, k, a, b - a, ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
                if len(pool) >= POOL:
                    yield from flush(False)
        yield from flush(True)
    return run


def pack(docs, tokenizer=None, size=SIZE, ids=True):
    """Pieces with their places and the checksum of their ids, and the ids themselves unless they aren't asked for."""
    schema = SCHEMA if ids else SCHEMA.rpartition(",")[0]
    return mapped(docs.select("doc_id", "text"), packer(tokenizer or default_tokenizer(), size, ids), schema)
