"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans follow fixed patterns. The model works on lines' candidate regions: runs of number characters, of any length, and the surroundings
of at-signs and their spelled forms; what base spans cover is taken out, and each remaining part is decoded. A part is cut into atoms (digit
runs, letter runs, single signs); every segment of up to MAXLEN atoms and MAXCHARS characters (and DIGITS digits, where the part has neither letters
nor at-signs) gets whole-span features, and dynamic programming over atoms picks boundaries and types together, the empty type taking single atoms. Weights are trained on the driver by gradient steps on
the segment lattice's log-likelihood, on forms that a seeded rule writes (the four kinds, variants without their usual signs, and plain numbers).
Added spans never overlap base ones. Null and empty texts have no spans; offsets are code points of the whole text; equal rows get equal
spans; an empty table gives no rows.
"""

import re

import numpy as np
import pyarrow as pa

KINDS = ["email", "ip", "card", "phone"]
MAXLEN, MAXCHARS, DIGITS = 40, 400, 19
SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
# Fixed values of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same as IP and the end of EMAIL, without going back within a run.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9+][0-9+ ().-]*")
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
RUN = re.compile(r"[(+]?[0-9][0-9 ().+-]{5,}[0-9]")
MARK = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
BEFORE = LOCAL - {"@"}
DOMAIN = re.compile(r"[A-Za-z0-9.-]{1,300}(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9.-]{1,63})*")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text):
    """Matches of EMAIL. A match starts where its run of local characters starts, or where the last match ended; so each at-sign is tried once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in BEFORE:
            lo -= 1
        m = HOST.match(text, at + 1) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text):
    """Matches of the fixed patterns, in linear time: a run of digits is tried from its start only, as a match from within would be one from the start."""
    ip, card, phone = [], [], []
    for r in NUMBERS.finditer(text):
        a, b = r.span()
        if b - a < 7:
            continue
        ip += [("ip", m.start(), m.end()) for m in DOTTED.finditer(text, a, b) if all(len(n) < 4 and int(n or "0") < 256 for n in (p.lstrip("0") for p in m[0].split(".")))]
        for m in CARD.finditer(text, a, b):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                card.append(("card", *m.span()))
        phone += [("phone", *m.span()) for m in PHONE.finditer(text, a, b) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return emails(text) + ip + card + phone


DIGIT_RUN = re.compile(r"[0-9]+")
NATIONAL = re.compile(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(( ?(\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]+)+")
FURTHER = re.compile(r"(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9]")


def features(seg, more):
    """Whole-span features. more: a further part of a domain follows."""
    runs = DIGIT_RUN.findall(seg)
    d, groups, mail = "".join(runs), [len(g) for g in runs], "@" in seg or "at)" in seg or "at]" in seg
    n, first, last = len(d), seg[:1], seg[-1:]
    return (1, 13 <= n <= 19 and luhn(d), 16 <= n <= 19, 8 <= n <= 15, n == 10, first in "+(", mail,
            n == 10 and NATIONAL.fullmatch(seg) is not None, len(groups) == 4 and seg.count(".") == 3 and max(groups) < 4,
            bool(groups) and all(len(g) < 4 and int(g) < 256 for g in runs[:4]), groups == [4, 4, 4, 4], len(groups) == 1, not first.isalnum() and first not in "+(", not last.isalnum(),
            len(seg) > 1 and seg[-2:].isascii() and seg[-2:].isalpha(), " " in seg, not d, len(seg) < 7, mail and ADDRESS.fullmatch(seg) is not None, more)


def atoms(region):
    """Atom bounds, and the digits before each where only they bound a segment."""
    cut = [0, *(m.end() for m in ATOM.finditer(region))]
    digits = [0]
    for x, y in zip(cut, cut[1:]):
        digits.append(digits[-1] + (y - x if "0" <= region[x] <= "9" else 0))
    return cut, digits if not re.search(r"[A-Za-z@]", region) else [0] * len(cut)


def segments(region, cut, digits, i):
    """The segments (j, features) that begin at atom i."""
    if region[cut[i]] == " ":
        return []
    ends = []
    for j in range(i + 1, min(len(cut) - 1, i + MAXLEN) + 1):
        if cut[j] - cut[i] > MAXCHARS or digits[j] - digits[i] > DIGITS:
            break
        if region[cut[j] - 1] not in " .-(":
            ends.append(j)
    return [(j, features(region[cut[i]:cut[j]], FURTHER.match(region, cut[j]) is not None)) for j in ends]


def lattice(region):
    """Atom bounds and the segments (i, j, features)."""
    cut, digits = atoms(region)
    return cut, [(i, j, np.array(f, float)) for i in range(len(cut) - 1) for j, f in segments(region, cut, digits, i)]


def decode(region, W):
    """Best segmentation: (kind, start, end) in the region. Segments are scored as they are reached, so that memory grows with the atoms only."""
    cut, digits = atoms(region)
    n = len(cut) - 1
    best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
    for i in range(n):
        if best[i] >= best[i + 1]:
            best[i + 1], back[i + 1] = best[i], (i, -1)
        segs = segments(region, cut, digits, i)
        if segs:
            s = np.array([f for _, f in segs], float) @ W.T
            for (j, _), k, top in zip(segs, s.argmax(1).tolist(), s.max(1).tolist()):
                if best[i] + top > best[j]:
                    best[j], back[j] = best[i] + top, (i, k)
    out, j = [], n
    while j:
        i, k = back[j]
        if k >= 0:
            out.append((KINDS[k], cut[i], cut[j]))
        j = i
    return out[::-1]


def regions(text, taken):
    """Bounds of the parts to decode: candidate regions, joined where they overlap, without the spans taken."""
    found = [m.span() for m in RUN.finditer(text)]
    for m in MARK.finditer(text):
        lo, tail = m.start(), DOMAIN.match(text, m.end())
        while lo > max(0, m.start() - MAXCHARS) and text[lo - 1] in BEFORE:
            lo -= 1
        if tail and lo < m.start():
            found.append((lo, tail.end()))
    whole = []
    for a, b in sorted(found):
        if whole and a < whole[-1][1]:
            whole[-1][1] = max(b, whole[-1][1])
        else:
            whole.append([a, b])
    k, taken = 0, sorted(taken)
    for a, b in whole:
        while k < len(taken) and taken[k][0] < b:
            x, y = taken[k]
            if x - a > 2:
                yield a, x
            a, k = max(a, y), k + 1
        if b - a > 2:
            yield a, b


def written_form(rng, numbers):
    """A form and its kind or -1, by rule; only of number characters if asked."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8)))
    kind = int(rng.integers(1, 6)) if numbers else [0, 0, 0, 1, 2, 3, 4, 5][rng.integers(0, 8)]
    if kind == 0:
        at, dot = [("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", ".")][rng.integers(0, 4)]
        inner, own = [".", dot][rng.integers(0, 2)], [f"{w()}.{d(2)}", f"{w()}{d(2)}", w(), d(rng.integers(5, 12)), f"{w()}.{w()}-{w()}{d(1)}"][rng.integers(0, 5)]
        s = f"{own}{at}{inner.join(w() for _ in range(rng.integers(1, 4)))}{dot}com"
    elif kind == 1:
        s = ".".join(str(rng.integers(0, 256)) for _ in range(4))
    elif kind == 2:
        body = "4" + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = ["", " ", "-", "."][rng.integers(0, 4)]
        s = sep.join(body[k:k + 4] for k in range(0, 16, 4))
    elif kind == 3:
        sep = [" ", "-", "."][rng.integers(0, 3)]
        s = [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"+{d(2)} {d(3)} {d(6)}"][rng.integers(0, 4)]
    else:
        s = [d(rng.integers(5, 25)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)}.{d(2)}", f"{d(2)} {d(2)} {d(2)} {d(1)}", ".".join(d(3) for _ in range(5)), f"{d(8)}-{d(8)}", f"{w()} @ {w()}"][rng.integers(0, 7 - numbers)]
    return s, kind if kind < 4 else -1


def written_forms(rng):
    """A region and its true segments: one form, or up to five of number characters side by side."""
    k = int(rng.integers(1, 6)) if rng.random() < .5 else 1
    text, true = "", set()
    for _ in range(k):
        s, kind = written_form(rng, int(k > 1))
        text += " " if text else ""
        if kind >= 0:
            true.add((len(text), len(text) + len(s), kind))
        text += s
    return text, true


def train(rounds=1400, seed=5, rate=.3):
    """Gradient ascent on the log-likelihood of true segmentations, by forward and backward sums over the lattice."""
    rng, W = np.random.default_rng(seed), np.zeros((4, 20))
    seen = np.full_like(W, 1e-3)
    for _ in range(rounds):
        s, true = written_forms(rng)
        cut, segs = lattice(s)
        n = len(cut) - 1
        sc = [W @ f for _, _, f in segs]
        fw, bw = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fw[0] = bw[n] = 0
        tot = [np.logaddexp.reduce(x) for x in sc]
        ends, begins = {}, {}
        for q, (i, j, _) in enumerate(segs):
            ends.setdefault(j, []).append(q), begins.setdefault(i, []).append(q)
        for j in range(1, n + 1):
            fw[j] = np.logaddexp.reduce([fw[j - 1], *(fw[segs[q][0]] + tot[q] for q in ends.get(j, []))])
        for i in range(n - 1, -1, -1):
            bw[i] = np.logaddexp.reduce([bw[i + 1], *(bw[segs[q][1]] + tot[q] for q in begins.get(i, []))])
        g = -.01 * W
        for q, (i, j, f) in enumerate(segs):
            g -= np.outer(np.exp(np.minimum(0, fw[i] + sc[q] + bw[j] - fw[n])), f)
            for k in range(len(KINDS)):
                if (cut[i], cut[j], k) in true:
                    g[k] += f
        seen += g * g
        W += rate * g / np.sqrt(seen)
    return W


def find(docs, W=None):
    """Base spans and all spans of every text."""
    W = train() if W is None else W
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it):
        for batch in it:
            bases, alls = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [(k, a + x, a + y) for a, b in regions(text, [(x, y) for _, x, y in base]) for k, x, y in decode(text[a:b], W)]
                full = sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                pack = lambda v: [{"kind": k, "start": x, "end": y} for k, x, y in v]
                bases.append(pack(base)), alls.append(pack(full))
            yield pa.record_batch([batch.column(0), pa.array(bases, kind), pa.array(alls, kind)], names=["doc_id", "base", "spans"])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
