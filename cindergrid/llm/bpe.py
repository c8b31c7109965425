"""Byte-level BPE by a sentencepiece model that is made from a vocabulary of ranks; nothing is trained.

Each byte becomes one sign (the character BASE + byte), each token of the vocabulary a piece of such signs, scored by its negative rank, and the
normaliser is the identity. Sentencepiece joins the pair of best score first, the leftmost of equals, which is the order of ranks. A text is
cut by the vocabulary's pattern, each match is encoded by itself, and a match that is a token as a whole is that token. Decoding maps ids to pieces
and signs back to bytes, so that any ids of the vocabulary give bytes, whether or not they are whole characters.

Null and empty texts have no ids; a text of any length is encoded whole, in memory that grows with the longest text of a block; rows are not compared, so repeated
and null ids are rows of their own; an empty table gives no rows; of other columns, also of these names, none is kept.
The model (a few MB for 50,000 tokens) goes to each task with the code, so executors read no files.
"""

import base64
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from cindergrid.llm.packing import OTHER, SPACE

#: Matches of at most SHORT characters are kept, with their ids, until there are more than KEPT.
BASE, BLOCK, KEPT, SHORT = 0x100, 1 << 22, 1 << 17, 64
SIGNS = {b: chr(BASE + b) for b in range(256)}


def default_vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path):
    """Tokens and their ranks from lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, map(bytes.strip, f)))}


def signs(token):
    return token.decode("latin-1").translate(SIGNS)


def model_of(ranks):
    """A serialised sentencepiece model whose pieces are the tokens, in the order of their ranks, and one unknown piece after them."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    for token in sorted(ranks, key=ranks.get):
        model.pieces.add(piece=signs(token), score=-float(ranks[token]), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    train, normal = model.trainer_spec, model.normalizer_spec
    train.model_type, train.vocab_size, train.unk_id = proto.TrainerSpec.BPE, len(ranks) + 1, len(ranks)
    train.bos_id = train.eos_id = train.pad_id = -1
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


@cache
def differing(kind):
    """Ranges, as in a set of a pattern, of the characters that this pattern library has in a class and the rank files' library has not, and the reverse.

    The two libraries carry tables of different years, so newly assigned letters and digits are cut differently.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    other = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    theirs, ours = set(other.decode(other.encode_ordinary(every))), set(regex.findall(kind, every))

    def ranges(chars):
        at = np.array(sorted(map(ord, chars)), int)
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        return "".join(rf"\U{p[0]:08x}-\U{p[-1]:08x}" for p in np.split(at, cut) if len(p))
    return ranges(ours - theirs), ranges(theirs - ours)


def exactly(pattern):
    """The pattern with both classes as the rank files' library has them."""
    for kind in (r"\p{L}", r"\p{N}"):
        less, more = differing(kind)
        pattern = pattern.replace(kind, f"[{kind}{f'--[{less}]' if less else ''}{f'||[{more}]' if more else ''}]")
    return f"(?V1){pattern}"


def narrowed(pattern):
    """The pattern with its classes written out for texts in which OTHER finds nothing; the standard library is faster at that."""
    def of(kind):
        return "".join(re.escape(c) for c in map(chr, range(0x530)) if unicodedata.category(c)[0] == kind)
    classes = {r"\p{L}": of("L"), r"\p{N}": of("N"), r"\s": SPACE}
    inside = lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda k: classes[k[0]], m)
    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", lambda m: inside(m[0]) if m[0][0] == "[" else f"[^{SPACE}]" if m[0] == r"\S" else f"[{classes[m[0]]}]", pattern)


class Codec:
    """Encodes and decodes by a serialised model; one for each task's worker."""

    def __init__(self, model, exact, narrow):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.pieces.get_piece_size() - 1
        self.ids = np.array([-self.pieces.get_score(i) for i in range(n)]).round().astype("<u4")
        back = {ord(s): b for b, s in SIGNS.items()}
        tokens = [self.pieces.id_to_piece(i).translate(back).encode("latin-1") for i in range(n)]
        self.bytes_of = dict(zip(self.ids.tolist(), tokens))
        self.whole = {t: self.ids[i].tobytes() for i, t in enumerate(tokens)}
        self.exact, self.narrow, self.kept = regex.compile(exact), re.compile(narrow), {}

    def learn(self, matches):
        """Keeps the ids of matches, found in one call; a match that is a token needs no merges. No byte of UTF-8 is 255, so it can part them."""
        matches = [(m, m.encode()) for m in matches]
        self.kept.update((m, self.whole[b]) for m, b in matches if b in self.whole)
        matches = [(m, b) for m, b in matches if b not in self.whole]
        if not matches:
            return
        # A sign that no piece holds keeps the matches apart; it comes out as the unknown piece.
        joined = np.append(np.frombuffer(b"\xff".join(b for _, b in matches), "u1").astype("<u2"), np.uint16(255))
        text = np.where(joined == 255, BASE + 256, joined + BASE).astype("<u2").tobytes().decode("utf-16-le")
        found = np.array(self.pieces.encode(text))
        cut, data, at = np.flatnonzero(found == len(self.ids)), self.ids[found % len(self.ids)].tobytes(), 0
        for (m, _), end in zip(matches, cut.tolist()):
            self.kept[m] = data[4 * at:4 * end]
            at = end + 1

    def encode(self, text):
        """Ids of a text as little-endian unsigned 32-bit integers."""
        matches = (self.exact if OTHER.search(text) else self.narrow).findall(text)
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = set(matches).difference(self.kept)
        if new:
            self.learn(new)
        out = b"".join(map(self.kept.__getitem__, matches))
        for m in new:
            if len(m) > SHORT:
                del self.kept[m]
        return out

    def decode(self, ids):
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(*spec):
    return Codec(*spec)


def mapped(df, spec, names, out, kept, apply):
    """The first kept of the named columns, and the bytes that apply() makes of each last value with a task's codec; batches of about BLOCK bytes."""
    def run(batches):
        own = codec(*spec)
        for batch in batches:
            done, size, lo = [], 0, 0
            for i in range(batch.num_rows):
                done.append(apply(own, batch.column(-1)[i].as_py()))
                size += len(done[-1])
                if size > BLOCK or i + 1 == batch.num_rows:
                    yield pa.record_batch([*[c.slice(lo, i + 1 - lo) for c in batch.columns[:kept]], pa.array(done, pa.binary())], names=[*names[:kept], out])
                    done, size, lo = [], 0, i + 1
    kinds = dict(df.dtypes)
    return df.select(*names).mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in names[:kept]], f"{out} binary"]))


def codec_spec(path=None, pattern=None):
    """What makes a codec of a vocabulary file, to be sent to tasks; the file is read here, on the driver."""
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    return model_of(read_ranks(path or default_vocabulary())), exactly(pattern), narrowed(pattern)


def encode(docs, spec):
    """doc_id, ids: the ids of each text as little-endian unsigned 32-bit integers."""
    return mapped(docs, spec, ["doc_id", "text"], "ids", 1, lambda own, text: own.encode(text or ""))


def decode(encoded, spec):
    """doc_id, ids, decoded: the bytes that ids stand for; null ids stand for none. An id that the vocabulary lacks is an error."""
    return mapped(encoded, spec, ["doc_id", "ids"], "decoded", 2, lambda own, ids: own.decode(ids or b""))
