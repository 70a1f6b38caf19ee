"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are
folded and the tree becomes Python closures that render a conversation. The language
has ``{{ expression }}``, ``{% for name in expression %}``, ``{% if %}``/``{% elif %}``/
``{% else %}``, ``{% set name = expression %}`` and ``{% generation %}`` ...
``{% endgeneration %}``, whose output is under the loss mask. Expressions have strings,
integers, names, fields (``message.role`` or ``message['role']``), ``+``, ``==``, ``!=``,
``and``, ``or``, ``not``, conditionals (``a if c else b``), parentheses and filters
(``x | trim``). Names only reach the values handed in, fields only dictionary entries;
there are no calls, attributes or loops without an end.

Texts are escaped against the template's control strings, and a reader takes a
formatted conversation apart again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stream_arrow

# The language -------------------------------------------------------------

PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
LEXEME = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[-+.|()\[\]=]))""", re.S)
WORDS = {"and", "or", "not", "if", "else", "in", "true", "false", "none"}


class TemplateError(ValueError):
    """A template that cannot be parsed, or names what it may not reach."""


def lexemes(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


UNESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class Expression:
    """Recursive descent over the lexemes of one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.rest = [*lexemes(source), ("end", "")]

    def next(self, *signs: str) -> str | None:
        if self.rest[0][1] in signs and self.rest[0][0] != "string":
            return self.rest.pop(0)[1]
        return None

    def need(self, sign: str) -> None:
        if not self.next(sign):
            raise TemplateError(f"expected {sign!r}, found {self.rest[0][1]!r}")

    def whole(self) -> tuple:
        out = self.conditional()
        if self.rest[0][0] != "end":
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        return out

    def conditional(self) -> tuple:
        out = self.either()
        if self.next("if"):
            test = self.either()
            self.need("else")
            return ("if", test, out, self.conditional())
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.next("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.next("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.next("not") else self.compared()

    def compared(self) -> tuple:
        out = self.sum()
        if sign := self.next("==", "!="):
            return (sign, out, self.sum())
        return out

    def sum(self) -> tuple:
        out = self.filtered()
        while self.next("+"):
            out = ("+", out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.atom()
        while self.next("|"):
            kind, name = self.rest.pop(0)
            if kind != "name":
                raise TemplateError("a filter needs a name")
            out = ("filter", name, out)
        return out

    def atom(self) -> tuple:
        kind, value = self.rest.pop(0)
        if kind == "string":
            out = ("constant", re.sub(r"\\(.)", lambda m: UNESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            out = ("constant", int(value))
        elif value in ("true", "false", "none"):
            out = ("constant", {"true": True, "false": False, "none": None}[value])
        elif kind == "name" and value not in WORDS:
            out = ("name", value)
        elif value == "(":
            out = self.conditional()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.next("."):
                kind, value = self.rest.pop(0)
                if kind != "name":
                    raise TemplateError("a field needs a name")
                out = ("field", out, ("constant", value))
            elif self.next("["):
                out = ("field", out, self.conditional())
                self.need("]")
            else:
                return out


def parse(source: str) -> list[tuple]:
    """The syntax tree: text, print, set, for, if and generation nodes."""
    root: list[tuple] = []
    # open constructs: what ends them, the body being filled, and the node to add when they end
    stack: list[dict] = [{"ends": (), "body": root}]
    at = 0
    for m in [*PIECE.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if text:
            stack[-1]["body"].append(("text", text))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            stack[-1]["body"].append(("print", Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        top = stack[-1]
        if word == "for":
            head = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s(.*)", rest, re.S)
            if not head:
                raise TemplateError(f"bad for: {rest!r}")
            stack.append({"ends": ("endfor",), "body": [], "kind": "for", "head": (head[1], Expression(head[2]).whole())})
        elif word == "if":
            stack.append({"ends": ("endif", "elif", "else"), "body": [], "kind": "if", "cases": [], "test": Expression(rest).whole()})
        elif word == "generation":
            stack.append({"ends": ("endgeneration",), "body": [], "kind": "generation"})
        elif word == "set":
            head = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", rest, re.S)
            if not head:
                raise TemplateError(f"bad set: {rest!r}")
            top["body"].append(("set", head[1], Expression(head[2]).whole()))
        elif word in top["ends"]:
            if top["kind"] == "if":
                top["cases"].append((top["test"], top["body"]))
                if word != "endif":
                    top["body"], top["test"] = [], Expression(rest).whole() if word == "elif" else ("constant", True)
                    top["ends"] = ("endif",) if word == "else" else top["ends"]
                    continue
                node = ("if", top["cases"])
            elif top["kind"] == "for":
                node = ("for", *top["head"], top["body"])
            else:
                node = ("generation", top["body"])
            stack.pop()
            stack[-1]["body"].append(node)
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"not ended: {stack[-1]['kind']}")
    return root


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The expression with its constant parts computed."""
    kind = node[0]
    if kind in ("constant", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"no filter {node[1]!r}")
        inner = fold(node[2], filters)
        return ("constant", filters[node[1]](inner[1])) if inner[0] == "constant" else ("filter", node[1], inner)
    parts = [fold(x, filters) for x in node[1:]]
    if kind == "if" and parts[0][0] == "constant":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "constant":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind != "if" and all(x[0] == "constant" for x in parts):
        return ("constant", expression((kind, *parts), filters)({}))
    return (kind, *parts)


def fold_body(body: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    """The tree with constants folded, cases that cannot be dropped and neighbouring texts joined."""
    out: list[tuple] = []
    for node in body:
        kind = node[0]
        if kind == "print":
            e = fold(node[1], filters)
            new = [("text", as_text(e[1]))] if e[0] == "constant" else [("print", e)]
        elif kind == "set":
            new = [("set", node[1], fold(node[2], filters))]
        elif kind == "for":
            new = [("for", node[1], fold(node[2], filters), fold_body(node[3], filters))]
        elif kind == "generation":
            new = [("generation", fold_body(node[1], filters))]
        elif kind == "if":
            cases = []
            for test, part in node[1]:
                test = fold(test, filters)
                if test[0] == "constant" and not test[1]:
                    continue
                cases.append((test, fold_body(part, filters)))
                if test[0] == "constant":
                    break
            new = cases[0][1] if cases and cases[0][0][0] == "constant" else [("if", cases)] if cases else []
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _field(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    raise TemplateError("only dictionaries have fields")


def expression(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure that computes the expression from the names in scope."""
    kind = node[0]
    if kind == "constant":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "filter":
        apply, inner = filters[node[1]], expression(node[2], filters)
        return lambda scope: apply(inner(scope))
    a, *more = (expression(x, filters) for x in node[1:])
    if kind == "not":
        return lambda scope: not a(scope)
    b = more[0]
    if kind == "field":
        return lambda scope: _field(a(scope), b(scope))
    if kind == "+":
        return lambda scope: as_text(a(scope)) + as_text(b(scope))
    if kind == "==":
        return lambda scope: a(scope) == b(scope)
    if kind == "!=":
        return lambda scope: a(scope) != b(scope)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    c = more[1]
    return lambda scope: b(scope) if a(scope) else c(scope)


#: What a body yields: text, and whether it is under the loss mask.
Span = tuple[str, bool]


def closure(body: list[tuple], filters: dict[str, Callable], masked: bool = False) -> Callable[[dict], Iterator[Span]]:
    """A closure that yields the spans of a body."""
    steps = []
    for node in body:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, span=(node[1], masked): iter((span,)))
        elif kind == "print":
            steps.append(lambda scope, e=expression(node[1], filters): iter(((as_text(e(scope)), masked),)))
        elif kind == "set":

            def assign(scope, name=node[1], e=expression(node[2], filters)):
                scope[name] = e(scope)
                return iter(())

            steps.append(assign)
        elif kind == "generation":
            steps.append(closure(node[1], filters, True))
        elif kind == "if":

            def choose(scope, cases=[(expression(t, filters), closure(b, filters, masked)) for t, b in node[1]]):
                return next((b(scope) for t, b in cases if t(scope)), iter(()))

            steps.append(choose)
        else:

            def repeat(scope, name=node[1], e=expression(node[2], filters), inner=closure(node[3], filters, masked)):
                for k, item in enumerate(e(scope) or ()):
                    yield from inner({**scope, name: item, "loop": {"first": k == 0, "index": k + 1}})

            steps.append(repeat)

    def run(scope: dict) -> Iterator[Span]:
        for step in steps:
            yield from step(scope)

    return run


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Span]]:
    """Compile a template to a function of the names it may use, which yields ``(text, under the loss mask)``.

    Iterables handed in are read once, as the spans are taken, so a long conversation
    streams through.
    """
    filters = {"trim": lambda x: as_text(x).strip(), "lower": lambda x: as_text(x).lower(), "upper": lambda x: as_text(x).upper(), **(filters or {})}
    run = closure(fold_body(parse(source), filters), filters)
    return lambda **names: run(names)


# Escaping and reading back -------------------------------------------------

#: Control strings; texts never show them unescaped. None has another one's first character inside.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")

TEMPLATE = (
    "<s>{% for message in messages %}<|turn|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|end|>{% endfor %}</s>"
)
_TURN = re.compile(r"<\|turn\|>((?:(?!<\|text\|>).)*)<\|text\|>((?:(?!<\|end\|>).)*)<\|end\|>", re.S)


def escape(text: object) -> str:
    """Double backslashes and put one after the first character of each control string."""
    text = as_text(text).replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def read_back(spans: Iterable[Span]) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of each turn, from a formatted conversation that arrives in pieces."""
    held = ""
    for text, _ in spans:
        held += text
        if text.endswith("<|end|>") or "<|end|><" in text:
            at = 0
            for m in _TURN.finditer(held):
                yield unescape(m[1]), unescape(m[2])
                at = m.end()
            held = held[at:]


# The operator ---------------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = TEMPLATE, with_text: bool = True, reader: Callable[[Iterable[Span]], Iterator[tuple[str, str]]] = read_back, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its formatted text and what reads back from it.

    Columns: ``(conv, formatted, mask, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)``. ``formatted`` and ``mask`` (start and end of each span under the
    loss mask, in code points) are null unless ``with_text``. Rows are ordered by turn, null
    first; ties, and repeated rows, all stay, ordered by role and text. A null text or
    role is empty; a null conversation id is a conversation of its own; other columns
    are ignored, whatever their names. ``reader`` yields role and text of each turn from the
    spans; if it reads another number of turns than went in, as the default does where a
    template does not mark turns its way, that is an error.

    Conversations are dealt by id, sorted inside partitions and streamed through the
    template and the reader, so a task never holds a whole conversation unless it
    must return it.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    schema = f"conv {kind}, formatted string, mask array<struct<start: bigint, end: bigint>>, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        render = compile_template(template, {"escape": escape})
        stream = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(k).to_pylist() for k in range(3))))
        out: list[list] = []
        for conv, own in groupby(stream, key=lambda x: x[0]):
            loss, digest = hashlib.sha256(), hashlib.sha256()
            chars = loss_chars = n = 0
            text: list[str] = []
            mask: list[dict] = []

            def told(spans: Iterator[Span]) -> Iterator[Span]:
                nonlocal chars, loss_chars
                for span, masked in spans:
                    if masked:
                        plain = unescape(span)
                        loss.update(plain.encode())
                        loss_chars += len(plain)
                        if with_text:
                            mask.append({"start": chars, "end": chars + len(span)})
                    chars += len(span)
                    if with_text:
                        text.append(span)
                    yield span, masked

            n_in = count()
            for role, said in reader(told(render(messages=(m for (_, m), _ in zip(own, n_in))))):
                n += 1
                digest.update(f"{role}\n{said}\n".encode())
            if n != next(n_in) + sum(1 for _ in own):
                raise ValueError("the reader does not read this template's turns")
            out.append([conv, "".join(text) if with_text else None, mask if with_text else None, n, digest.hexdigest(), loss_chars, loss.hexdigest(), chars])
            if len(out) == 256:
                yield list(zip(*out))
                out = []
        if out:
            yield list(zip(*out))

    return stream_arrow(rows, each, schema).withColumnRenamed("conv", conv_col)
