"""Chat formatting by a template compiler.

The template language has text, {{ expression }}, {% for x in name %}, {% if test %}, {% else %}, {% generation %} and {% end %}; expressions
are strings, names, fields (x.y), == and + and nothing else, so a template reaches only the values it is given. A template is parsed to a tree,
constants are folded, and the tree becomes nested Python closures that append to a list and note the spans of generation blocks.
Control strings inside texts are escaped reversibly by a backslash-like mark. Null texts and roles are empty, and may hold line ends; turns are ordered by turn, and those of an equal turn by
hashes of role and text; repeated rows stay; rows without conv_id are one conversation; a conversation of one row is fine; an empty table gives no rows.
"""

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>"]
MARK = "␛"
_CONTROL = re.compile("|".join(map(re.escape, [MARK, *CONTROL])))
TEMPLATE = ("{% for m in messages %}{{ '<|turn|>' + m.role + '\n' }}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% end %}"
            "{% else %}{{ m.text }}{% end %}{{ '<|end|>' + '\n' }}{% end %}")
TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)
PART = 1 << 18
SCHEMA = "conv_id long, part long, formatted string, loss_spans array<struct<start:long,end:long>>, n_turns long"


def escape(text):
    """A mark goes after the first character of every control string and before every mark."""
    return _CONTROL.sub(lambda m: MARK + MARK if m[0] == MARK else m[0][0] + MARK + m[0][1:], text)


def unescape(text):
    return re.sub(f"{MARK}(.?)", lambda m: MARK if m[1] == MARK else m[1], text, flags=re.S)


def escape_role(role):
    """A role ends at the line's end, so its own line ends are written as the mark and an n (which no control string has in its second place)."""
    return escape(role).replace("\n", f"{MARK}n")


def unescape_role(role):
    return re.sub(f"{MARK}(.?)", lambda m: MARK if m[1] == MARK else "\n" if m[1] == "n" else m[1], role, flags=re.S)


def parse_expression(src):
    tokens = re.findall(r"'(?:[^'\\]|\\.)*'|[A-Za-z_][\w.]*|==|\+|\S", src)

    def atom():
        t = tokens.pop(0) if tokens else ""
        if t.startswith("'"):
            return ("const", t[1:-1].replace("\\'", "'").replace("\\n", "\n"))
        if re.fullmatch(r"[A-Za-z]\w*(\.[A-Za-z]\w*)?", t):
            return ("name", *t.split("."))
        raise ValueError(f"not allowed in a template: {t!r}")

    def total():
        left = atom()
        while tokens and tokens[0] == "+":
            tokens.pop(0)
            left = ("+", left, atom())
        return left
    left = total()
    if tokens and tokens[0] == "==":
        tokens.pop(0)
        left = ("==", left, total())
    if tokens:
        raise ValueError(f"not allowed in a template: {tokens[0]!r}")
    return left


def parse(template):
    parts, pos = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S), 0

    def block(ends):
        nonlocal pos
        out = []
        while pos < len(parts):
            p = parts[pos]
            pos += 1
            if p.startswith("{{"):
                out.append(("emit", parse_expression(p[2:-2])))
            elif p.startswith("{%"):
                w = p[2:-2].split(None, 1)
                if w[0] in ends:
                    return out, w[0]
                if w[0] == "for" and (m := re.fullmatch(r"(\w+) in (\w+)\s*", w[1])):
                    out.append(("for", m[1], m[2], block(("end",))[0]))
                elif w[0] == "if":
                    yes, end = block(("else", "end"))
                    out.append(("if", parse_expression(w[1]), yes, block(("end",))[0] if end == "else" else []))
                elif w[0] == "generation":
                    out.append(("generation", block(("end",))[0]))
                else:
                    raise ValueError(f"unknown tag {p!r}")
            elif p:
                out.append(("emit", ("const", p)))
        if ends:
            raise ValueError("a block isn't closed")
        return out, ""
    return block(())[0]


def fold(node):
    """Joins constant parts and decides constant tests."""
    if isinstance(node, list):
        out = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if out and y[0] == "emit" == out[-1][0] and y[1][0] == "const" == out[-1][1][0]:
                    out[-1] = ("emit", ("const", out[-1][1][1] + y[1][1]))
                else:
                    out.append(y)
        return out
    if node[0] in ("+", "=="):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == b[0] == "const":
            return ("const", a[1] + b[1] if node[0] == "+" else a[1] == b[1])
        return (node[0], a, b)
    if node[0] == "emit":
        return ("emit", fold(node[1]))
    if node[0] == "for":
        return (*node[:3], fold(node[3]))
    if node[0] == "generation":
        return ("generation", fold(node[1]))
    if node[0] == "if":
        test = fold(node[1])
        return fold(node[2] if test[1] else node[3]) if test[0] == "const" else ("if", test, fold(node[2]), fold(node[3]))
    return node


def value(node):
    if node[0] == "const":
        return lambda env: node[1]
    if node[0] == "name":
        return (lambda env: env[node[1]]) if len(node) == 2 else (lambda env: env[node[1]][node[2]])
    a, b = value(node[1]), value(node[2])
    return (lambda env: a(env) + b(env)) if node[0] == "+" else (lambda env: a(env) == b(env))


def closure(node):
    if isinstance(node, list):
        own = [closure(x) for x in node]

        def run(env, out):
            for f in own:
                f(env, out)
        return run
    if node[0] == "emit":
        get = value(node[1])
        return lambda env, out: out.add(get(env))
    if node[0] == "for":
        body = closure(node[3])

        def loop(env, out):
            for x in env[node[2]]:
                body(env | {node[1]: x}, out)
        return loop
    if node[0] == "if":
        test, yes, no = value(node[1]), closure(node[2]), closure(node[3])
        return lambda env, out: (yes if test(env) else no)(env, out)
    body = closure(node[1])

    def generation(env, out):
        start = out.size
        body(env, out)
        out.spans.append((start, out.size))
    return generation


class Output:
    def __init__(self):
        self.parts, self.spans, self.size = [], [], 0

    def add(self, text):
        self.parts.append(text)
        self.size += len(text)


def compile_template(template):
    run = closure(fold(parse(template)))

    def render(messages):
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans
    return render


def read_back(formatted):
    """(role, text) of each turn."""
    return [(unescape_role(r), unescape(t)) for r, t in TURN.findall(formatted)]


def format_conversations(rows, template=TEMPLATE, limit=PART):
    """Parts of formatted conversations: conv_id, part, formatted, loss_spans (within the part), n_turns. Parts in order make up a conversation.

    Rows are ranged by conversation and turn, so a very long conversation is spread over tasks and is never one value; a part ends
    at a turn's end and at about limit characters. The template has to be one loop over the messages, else a ValueError tells so.
    """
    tree = fold(parse(template))
    if [n[0] for n in tree] != ["for"]:
        raise ValueError("the template has to be one loop over the messages")

    def run(it):
        render, task = compile_template(template), TaskContext.get().partitionId()
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_turns", pa.int64())])
        open_, size, made, conv = [], 0, 0, None

        def closed():
            nonlocal open_, size, made
            text, spans = render(open_)
            out = {"conv_id": conv, "part": (task << 32) + made, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans], "n_turns": len(open_)}
            open_, size, made = [], 0, made + 1
            return out
        for batch in it:
            out = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if open_ and (c != conv or size > limit):
                    out.append(closed())
                conv = c
                open_.append({"role": escape_role(role), "text": escape(text)})
                size += len(text) + len(role)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if open_:
            yield pa.RecordBatch.from_pylist([closed()], schema=schema)
    # Hashes stand for texts in the order: ranges are drawn from a sample of keys on the driver.
    key = ["conv_id", "turn", F.xxhash64("role"), F.xxhash64("text")]
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def whole(parts, start, add, finish, schema):
    """A row for each conversation: finish(conv_id, state) after add(state, part) of its parts in order; only the state is held."""
    def run(it):
        conv, state = None, None
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in it:
            out = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        out.append(finish(conv, state))
                    conv, state = r["conv_id"], start()
                add(state, r)
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=_arrow(schema))
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, finish(conv, state)))], schema=_arrow(schema))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def _arrow(schema):
    return pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in schema.split(", ")])
