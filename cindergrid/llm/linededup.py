"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its white-space separated words; a line is removed if an earlier one (by doc_id, hash of the text, line number) has a
Jaccard similarity of 0.8 or more. Lines of equal sets are one class, of which the first line stands for all. Words are ordered by
rarity (counts of BUCKETS hashed buckets, a bounded table; any fixed order is right, a rarer one is faster); the rarest words of a line, its
prefix, are the join keys, together with a cell of the line's size. Length, positional and bit-signature filters are part of
the join; what is left is verified on the lines' sets of word keys (56 bits of a hash and the rarity).

The join gives no pairs of a group. First, as a semi join, which stops at a line's first partner, it finds the lines that have any partner by
the filters, a few of all. Each of these is compared with a few lines of each of its keys, the earliest of LEADERS classes by hash, which removes most lines of a
group of near copies. For the lines that stand, a last semi join, which carries the word keys, looks for an earlier line that is similar indeed.
Lines without words stay. Null texts stay null, empty ones empty. Null doc_ids come first. Rows equal in doc_id and text are one document and
are treated alike. Returns all columns of docs with text replaced, whatever their names, and n_lines and n_removed on request (in place of columns of these
names); an empty table gives no rows.
"""

import math
from functools import reduce

from pyspark.sql import functions as F

from cindergrid.llm.textkit import bounded, marked, written

BUCKETS, WIDE, PARTS, LEADERS = 1 << 16, 96, 8, 8
LEAST = -(1 << 63)
PARTED = [f"fine{j}" for j in range(PARTS)]
FOLDED = [f"fold{j}" for j in range(PARTS // 2)]
#: White space within a line.
SPACE = " \t\r\x0b\f"


def number(k):
    return F.lit(k).cast("bigint")


def keyed(docs):
    """doc, h (together a document) and its text."""
    return docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), F.xxhash64("text").alias("h"), "text")


def has_word(line):
    return F.ltrim(line, F.lit(SPACE)) != ""


def words(line):
    """Words with repeats, and empty ones between. Splitting at a single sign is much faster than at a pattern, so other white space is replaced where there is some."""
    other = reduce(lambda x, y: x | y, [F.contains(line, F.lit(c)) for c in SPACE[1:]])
    return F.split(F.when(other, F.translate(line, SPACE[1:], " " * 4)).otherwise(line), " ")


def lines(keyed_docs):
    """One row for each line with words: doc, h, no, line."""
    return keyed_docs.select("doc", "h", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter(has_word(F.col("line")))


def ranks(docs):
    """Rarity of each bucket of words, 0 (rare) to 126. (Small numbers keep the plan's text short, of which the driver holds many copies.)"""
    seen = docs.select(F.explode(words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''").groupBy(F.xxhash64("w").bitwiseAND(number(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
    return bounded({r.b: min(126, int(3 * math.log2(1 + r.n))) for r in seen.collect()}, BUCKETS)


def parity(keys):
    """64 parity bits; two sets differ in at least as many words as bits."""
    return F.aggregate(keys, number(0), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", number(1), k.bitwiseAND(number(63)).cast("int"))))


def word_keys(line, rank):
    """Ordered keys of the distinct words. (A lambda's terms are worked out anew wherever they stand, so each word is hashed in a step of its own; what can be done on the hashes isn't done on the words.)"""
    def key(x):
        return F.shiftleft(F.get(rank, x.bitwiseAND(number(BUCKETS - 1)).cast("int")), 56).bitwiseOR(F.shiftrightunsigned(x, 8))
    hashes = F.array_remove(F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.array_distinct(F.transform(hashes, key)))


#: The rarest keys, one of which at least is in every set of similarity 0.8 or more.
PREFIX = "slice(keys, 1, n - (4 * n + 4) div 5 + 1)"


def signature():
    """Of all words, and for long lines also of half of them."""
    return parity("keys").alias("sig"), F.when(F.col("n") > WIDE, parity(F.filter("keys", lambda k: k.bitwiseAND(number(64)) > 0))).alias("hi")


def fine_signature():
    """The parity of the keys in each of PARTS classes by hash: closer than signature(), for the few lines that are asked for. Two classes in one (FOLDED) are a parity too, of half the width."""
    return [parity(F.filter("keys", lambda k: k.bitwiseAND(number((PARTS - 1) << 6)) == number(j << 6))).alias(c) for j, c in enumerate(PARTED)]


def represented(all_lines, rank):
    """One row for each class of lines of equal sets: id, first line, size n, signature (sig; for long lines also that of half of the words, hi) and prefix."""
    out = all_lines.select("doc", "h", "no", word_keys(F.col("line"), rank).alias("keys"))
    out = out.select(F.xxhash64("keys").alias("s1"), F.hash("keys").alias("s2"), F.struct("doc", "h", "no").alias("at"), F.size("keys").alias("n"), "keys")
    prefix = F.struct("n", *signature(), F.transform(F.expr(PREFIX), lambda k: F.hash(k)).alias("prefix"))
    out = out.select("s1", "s2", "at", prefix.alias("of")).groupBy("s1", "s2").agg(F.min("at").alias("at"), F.any_value("of").alias("of"))
    return written(out.select(F.monotonically_increasing_id().alias("id"), "at.*", "of.*"))


def spread(lines_, prefix, *more):
    """A row for each word of the prefix and cell: key, p (size n, place pos of the word, home), more.

    A row goes to the cell of its size (a doubling), its home, and, as a guest, to the next one if it may match there: the lines at home there have
    2^top words at least, and the guest's word stands early enough for one of these (PLACES).
    """
    def cell(n):
        return F.floor(F.log2(n)).cast("int")
    home, top = cell(F.col("n")), cell(F.expr("(5 * n) div 4"))
    rows = lines_.select("n", *more, F.posexplode(prefix).alias("pos", "w"), home.alias("c"), top.alias("top"))
    guest = F.expr("top > c and 9L * pos <= 5L * n - 4 * shiftleft(1L, top)")
    rows = rows.select("n", *more, "pos", "w", "c", F.explode(F.when(guest, F.array("c", "top")).otherwise(F.array("c"))).alias("cell"))
    return rows.select(F.hash("w", "cell").alias("key"), F.expr("n * 2097152L + least(pos, 524287) * 2 + if(cell = c, 1, 0)").alias("p"), *more)


#: Sizes of two lines x and y, and the places of their first common word.
NX, NY, PX, PY = "(x.p div 2097152)", "(y.p div 2097152)", "((x.p % 2097152) div 2)", "((y.p % 2097152) div 2)"
#: They meet in the home of the larger one; they share at most NX - PX and NY - PY words.
PLACES = f"(({NX} < {NY} and y.p % 2 = 1) or ({NX} > {NY} and x.p % 2 = 1) or ({NX} = {NY} and x.p % 2 = 1 and y.p % 2 = 1)) and 9 * {PX} <= 5 * {NX} - 4 * {NY} and 9 * {PY} <= 5 * {NY} - 4 * {NX}"
#: The words that they differ in are at least as many as their signatures' bits.
BITS = f"9 * if(x.hi is null or y.hi is null, bit_count(x.sig ^ y.sig), bit_count(x.hi ^ y.hi) + bit_count(x.hi ^ x.sig ^ y.hi ^ y.sig)) <= {NX} + {NY}"
def fine(columns):
    return f"9 * ({' + '.join(f'bit_count(x.{c} ^ y.{c})' for c in columns)}) <= {NX} + {NY}"


FINE = fine(PARTED)
MEET = f"x.key = y.key and {PLACES} and {BITS}"
SIMILAR = "9 * size(array_intersect(x.keys, y.keys)) >= 4 * (size(x.keys) + size(y.keys))"


def partnered(x, y, more):
    """Ids of the lines x that have a partner y."""
    return x.alias("x").join(y.alias("y"), F.expr(f"{MEET} and {more}"), "left_semi").select("x.id").distinct()


def hopeful(reps):
    """Ids of lines that have a partner by all filters."""
    rows = spread(reps, "prefix", "id", "sig", "hi")
    return partnered(rows, rows, "x.id <> y.id")


def asked_lines(asked, all_lines, rank):
    """id, at, n, signature and keys of the lines asked for.

    The lines are found by a bit table of fixed size, so that few others are shuffled; a full table only lets more through.
    """
    own = all_lines.filter(marked(asked, "doc", "h", "no", probes=3)).join(asked, ["doc", "h", "no"]).dropDuplicates(["id"])
    own = own.select("id", F.struct("doc", "h", "no").alias("at"), word_keys(F.col("line"), rank).alias("keys")).withColumn("n", F.size("keys"))
    return written(own.select("*", *signature(), *fine_signature()))


def led(own):
    """Ids of lines that are similar to an earlier one among the leaders of their keys."""
    rows = spread(own, F.expr(PREFIX), "id", "at", "sig", "hi")
    first = rows.groupBy("key", F.pmod("id", number(LEADERS)).alias("salt")).agg(F.min(F.struct("at", "id", "p", "sig", "hi")).alias("of")).select("key", "of.*")
    pairs = rows.alias("x").join(first.alias("y"), F.expr(f"{MEET} and y.at < x.at")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    keys = own.select("id", "keys")
    both = pairs.join(keys.alias("x"), F.expr("a = x.id")).join(keys.alias("y"), F.expr("b = y.id"))
    return written(both.filter(SIMILAR).select(F.col("a").alias("id")).distinct())


def matched(own):
    """Ids of the lines that have an earlier match among them."""
    done = led(own)

    def rows(of=None, *more):
        return spread(own if of is None else own.join(of, "id", "left_semi"), F.expr(PREFIX), "id", "at", "sig", "hi", *PARTED, *more)
    still = own.join(done.withColumn("off", F.lit(True)), "id", "left").withColumn("open", F.col("off").isNull())
    still = still.select("*", *[F.col(a).bitwiseXOR(F.col(b)).alias(c) for a, b, c in zip(PARTED, PARTED[PARTS // 2:], FOLDED)])
    both = spread(still, F.expr(PREFIX), "id", "at", "sig", "hi", *FOLDED, "open")
    late = written(partnered(both, both, f"x.open and y.at < x.at and {fine(FOLDED)}"))
    early = written(partnered(rows().filter(marked(rows(late), "key")), rows(late), f"x.at < y.at and {FINE}"))
    return done.union(written(partnered(rows(late, "keys"), rows(early, "keys"), f"y.at < x.at and {FINE} and {SIMILAR}")))


def dedup_lines(docs, counts=False):
    """docs without lines that match an earlier one; with counts also n_lines and n_removed."""
    own = lines(keyed(docs))
    rank = ranks(docs)
    reps = represented(own, rank)
    asked = written(reps.select("id", "doc", "h", "no").join(hopeful(reps), "id", "left_semi"))
    gone = matched(asked_lines(asked, own, rank))
    kept = reps.select("id", "doc", "h", "no").join(gone, "id", "left_anti").groupBy("doc", "h").agg(F.collect_set("no").alias("kept"))
    whole = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = whole.join(kept, ["doc", "h"], "left").withColumn("all", F.split(F.col("row")["text"], "\n"))
    stay = F.filter("all", lambda v, i: F.coalesce(F.array_contains("kept", i), F.lit(False)) | ~has_word(v))
    new = {"text": F.array_join(stay, "\n")}
    if counts:
        new |= {"n_lines": F.coalesce(F.size("all"), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("all") - F.size(stay), F.lit(0)).cast("long")}
    return out.select(*[new[c].alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in new or c == "text"], *[v.alias(c) for c, v in new.items() if c != "text"])
