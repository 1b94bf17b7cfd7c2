"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constant parts are folded, and each node
becomes a Python closure.  The language is sandboxed: it has names, keys of
messages, literals, comparisons, ``+``, ``and``/``or``/``not``, a few filters, ``for``,
``if`` and ``generation``; there are no calls, no attributes of Python objects and
no loops but over the messages given.

    {{ expr }}    {% for m in messages %} ... {% endfor %}
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}

Output goes to a sink piece by piece, with marks where ``generation`` begins and
ends; messages may come from an iterator, so a conversation need not be in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import map_arrow, table

TURN, END = "<|turn|>", "<|end|>"
#: Strings with a meaning to this or common chat formats; texts never show them unescaped.
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
TEMPLATE = (
    "{% for m in messages %}{{ '" + TURN + "' }}{{ m.role | escape | line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '" + END + "' + '\\n' }}{% endfor %}")

_CONTROL = re.compile("|".join(rf"(?:{re.escape(c[0])}\\*{re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"(?:{re.escape(c[0])}\\+{re.escape(c[1:])})" for c in CONTROLS))


def escape(s: str) -> str:
    r"""Put one more backslash after the first character of each control string (``</s>`` to ``<\/s>``)."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    """Undo :func:`escape`, whatever the text was."""
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], s)


def line(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\n", "\\n")


def unline(s: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", s)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


_PIECE = re.compile(r"\{\{.*?\}\}|\{%.*?%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"
                    r"|(?P<op>==|!=|[|+.()\[\]]))")
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent: or, and, not, comparison, +, filters, keys, atoms.  Nodes are tuples."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def take(self, *values: str) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][0] != "str" and self.tokens[self.i][1] in values:
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take("==", "!="):
            node = (op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.keyed()
        while self.take("|"):
            kind, name = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.i += 1
            node = ("filter", name, node)
        return node

    def keyed(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            kind, value = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
            if (op, kind) not in ((".", "name"), ("[", "str")):
                raise TemplateError("a key must be a name or a string")
            self.i += 1
            if op == "[":
                value = _unquote(value)
                if not self.take("]"):
                    raise TemplateError("missing ]")
            node = ("key", node, value)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        kind, value = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
        self.i += 1
        if kind == "str":
            return ("const", _unquote(value))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name":
            return ("name", value)
        raise TemplateError("an expression is missing")


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), s[1:-1], flags=re.DOTALL)


def parse(source: str) -> tuple:
    """The syntax tree: ``("block", nodes)`` of text, out, for, if and generation nodes."""
    pieces, last = [], 0
    for m in _PIECE.finditer(source):
        pieces += [("text", source[last:m.start()]), ("out" if m[0][1] == "{" else "tag", m[0][2:-2].strip())]
        last = m.end()
    pieces.append(("text", source[last:]))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes = []
        while at < len(pieces):
            kind, value = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(("text", value))
            elif kind == "out":
                nodes.append(("out", _Expression(value).whole()))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in ends:
                    return ("block", nodes), value
                if word == "for":
                    m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", value)
                    if not m:
                        raise TemplateError(f"cannot read {value!r}")
                    body, _ = block("endfor")
                    nodes.append(("for", m[1], m[2], body))
                elif word == "if":
                    nodes.append(branch(value))
                elif value == "generation":
                    body, _ = block("endgeneration")
                    nodes.append(("generation", body))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return ("block", nodes), ""

    def branch(tag: str) -> tuple:
        test = _Expression(tag.split(None, 1)[1] if " " in tag else "").whole()
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", test, body, ("block", [branch(end)]))
        other = block("endif")[0] if end == "else" else ("block", [])
        return ("if", test, body, other)

    return block()[0]


def _apply(op: str, a: object, b: object) -> object:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two strings or two numbers")


def fold(node: tuple) -> tuple:
    """The same tree with constant parts worked out, texts joined and dead branches gone."""
    kind = node[0]
    if kind in ("==", "!=", "+"):
        a, b = fold(node[1]), fold(node[2])
        return ("const", _apply(kind, a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const":
            return (a if not a[1] else b) if kind == "and" else (a if a[1] else b)
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](_shown(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    if kind == "key":
        return ("key", fold(node[1]), node[2])
    if kind == "out":
        a = fold(node[1])
        return ("text", _shown(a[1])) if a[0] == "const" else ("out", a)
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind == "for":
        return ("for", node[1], node[2], fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "block":
        out: list[tuple] = []
        for n in map(fold, node[1]):
            for part in n[1] if n[0] == "block" else [n]:
                if part[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + part[1])
                elif part != ("text", ""):
                    out.append(part)
        return ("block", out)
    return node


def _shown(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


class Sink:
    """Collects output: ``text`` and the ``spans`` of code points inside ``generation``."""

    def __init__(self) -> None:
        self._parts: list[str] = []
        self.size, self.spans = 0, []

    def write(self, s: str) -> None:
        self._parts.append(s)
        self.size += len(s)

    def begin(self) -> None:
        self._began = self.size

    def end(self) -> None:
        self.spans.append((self._began, self.size))

    @property
    def text(self) -> str:
        return "".join(self._parts)


Value = Callable[[dict], object]
Render = Callable[[dict, Sink], None]


def _value(node: tuple) -> Value:
    kind = node[0]
    if kind == "const":
        return lambda ctx, v=node[1]: v
    if kind == "name":
        return lambda ctx, k=node[1]: ctx.get(k)
    if kind == "key":
        of, k = _value(node[1]), node[2]
        return lambda ctx: v.get(k) if isinstance(v := of(ctx), dict) else None
    if kind == "filter":
        f, of = FILTERS[node[1]], _value(node[2])
        return lambda ctx: f(_shown(of(ctx)))
    if kind == "not":
        of = _value(node[1])
        return lambda ctx: not of(ctx)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda ctx: a(ctx) and b(ctx)
    if kind == "or":
        return lambda ctx: a(ctx) or b(ctx)
    return lambda ctx: _apply(kind, a(ctx), b(ctx))


def _render(node: tuple) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda ctx, out, s=node[1]: out.write(s)
    if kind == "out":
        of = _value(node[1])
        return lambda ctx, out: out.write(_shown(of(ctx)))
    if kind == "if":
        test, yes, no = _value(node[1]), _render(node[2]), _render(node[3])
        return lambda ctx, out: yes(ctx, out) if test(ctx) else no(ctx, out)
    if kind == "generation":
        body = _render(node[1])

        def generation(ctx: dict, out: Sink) -> None:
            out.begin()
            body(ctx, out)
            out.end()
        return generation
    if kind == "for":
        name, items, body = node[1], node[2], _render(node[3])

        def loop(ctx: dict, out: Sink) -> None:
            inner, it = dict(ctx), iter(ctx.get(items) or ())
            item, i = next(it, None), 0
            while item is not None:
                after = next(it, None)
                inner[name] = item
                inner["loop"] = {"first": i == 0, "last": after is None, "index0": i}
                body(inner, out)
                item, i = after, i + 1
        return loop
    parts = [_render(n) for n in node[1]]

    def block(ctx: dict, out: Sink) -> None:
        for p in parts:
            p(ctx, out)
    return block


def compile_template(source: str) -> Callable[[Iterable[dict], Sink], None]:
    """A function that renders messages (dicts with ``role`` and ``text``) into a sink."""
    run = _render(fold(parse(source)))
    return lambda messages, out: run({"messages": messages}, out)


class Reader(Sink):
    """Reads the default template's output back as it is written: turns, and what the loss sees.

    Holds one turn at a time.  Control strings cannot occur inside a turn, so its
    end is the next end mark.
    """

    def __init__(self) -> None:
        self.size = self.n_turns = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self._open: list[str] = []
        self._began: int | None = None

    def write(self, s: str) -> None:
        self._open.append(s)
        self.size += len(s)
        if s.endswith(END + "\n"):
            self._turn("".join(self._open))
            self._open.clear()

    def begin(self) -> None:
        self._began = len(self._open)

    def end(self) -> None:
        text = unescape("".join(self._open[self._began:]))
        self.loss_chars += len(text)
        self.loss.update(text.encode())

    def _turn(self, written: str) -> None:
        head, _, body = written.removeprefix(TURN).removesuffix(END + "\n").partition("\n")
        self.n_turns += 1
        self.turns.update(f"{unescape(unline(head))}\n{unescape(body)}\n".encode())


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for b in batches:
        for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            yield c, {"role": role, "text": text}


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """``(conv_id, role, text)``: each conversation in one task, in order of turn, then role and text; null is empty."""
    return conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, **columns: str) -> DataFrame:
    """One row per conversation: ``conv_id, text, mask`` (spans of code points under the loss, ends exclusive).

    Null roles and texts count as empty, rows without an id are one conversation,
    equal turns go by role and text, repeated rows are turns of their own.
    An empty table gives an empty result; other columns are not read.
    """
    compile_template(template)                                  # a wrong template fails here, not in a task
    rows = ordered(conversations, **columns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for c, group in groupby(_messages(batches), key=lambda x: x[0]):
            out = Sink()
            render((m for _, m in group), out)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": c, "text": out.text, "mask": [{"start": a, "end": b} for a, b in out.spans]}],
                pa.schema([("conv_id", _ARROW.get(kind, pa.string())), ("text", pa.string()),
                           ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return map_arrow(rows, run, f"conv_id {kind}, text string, mask array<struct<start:bigint,end:bigint>>")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def digests(conversations: DataFrame, **columns: str) -> DataFrame:
    """What reading the formatted conversations back gives: turns, their digest, the loss text and its digest.

    Conversations are rendered and read turn by turn, so the largest one needs no more memory than its longest turn.
    """
    rows = ordered(conversations, **columns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, found = compile_template(TEMPLATE), []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*found))
            kinds = [_ARROW.get(kind, pa.string()), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for c, group in groupby(_messages(batches), key=lambda x: x[0]):
            out = Reader()
            render((m for _, m in group), out)
            found.append((c, out.n_turns, out.turns.hexdigest(), out.loss_chars, out.loss.hexdigest(), out.size))
            if len(found) == 1000:
                yield batch()
                found = []
        if found:
            yield batch()

    return map_arrow(rows, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                "loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts are control strings; the query formats it beside the table's.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


_CONTROL_SQL = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS)
#: One backslash for each control string is what escaping adds to a length; roles have none in the tables.
ORACLE_OP7 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(END) + 2} + length(role) + length(text)
           + len(regexp_extract_all(text, '{_CONTROL_SQL}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
