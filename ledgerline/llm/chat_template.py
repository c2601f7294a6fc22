"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}`` with
``elif`` and ``else``, ``{% set x = expression %}`` and ``{% generation %}`` around what
a model has to produce. Expressions have strings, whole numbers, true, false, none,
names, fields (``message.role``, ``message['role']``), ``not and or``, comparisons,
``+ - * // %``, ``~`` (joins as text), ``x if c else y`` and filters (``x | trim``).
Templates are sandboxed: fields are keys of mappings, never attributes of objects, there
are no calls, and filters are those of ``FILTERS``.

A template is parsed to a syntax tree, its constant parts are folded, and the tree
becomes closures that yield pieces of text, each with a mark whether it is under
generation. A loop takes any iterable and looks one item ahead for ``loop.last``, so a
conversation is formatted while its rows stream by.

Defined results: rows are ordered by turn, then role, then text, null first; a null role
or text is empty; a conversation whose id is null is one of its own; repeated rows are
turns each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_DEPTH = 60

TURN_END = " </turn>\n"
TEMPLATE = (
    "{% for message in messages %}### {{ message.role | name }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ ' </turn>' ~ '\\n' }}{% endfor %}"
)

_CONTROL = re.compile(r"\\|<(?=/turn>)|#+(?<=###)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


def escape(text: str) -> str:
    """``text`` with a backslash before each backslash and each sign that could begin or
    continue a control string."""
    return _CONTROL.sub(lambda m: "".join("\\" + c for c in m.group()), text)


def escape_name(text: str) -> str:
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "name": lambda x: escape_name(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
}


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# --- syntax tree ------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    operator: str
    parts: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (test, body); the else branch tests a true constant


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<word>[A-Za-z_]\w*)"
    r"|(?P<sign>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in", "if", "else"}

OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _bounded(a, b),
    "//": lambda a, b: a // b, "%": lambda a, b: _number(a) % _number(b), "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def _number(value) -> int:
    if not isinstance(value, int):
        raise TemplateError("a whole number is needed")
    return value


def _bounded(a, b):
    return _number(a) * _number(b)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    LEVELS = [("or",), ("and",), None, ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%")]

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            token = _TOKEN.match(source, at)
            if not token:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((token.lastgroup, token.group(token.lastgroup)))
            at = token.end()
            if source[at:].isspace():
                break
        self.at, self.depth = 0, 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("sign", "word") else None

    def take(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        value = self.level(0)
        if self.take("if"):
            test = self.level(0)
            value = Choice(test, value, self.choice() if self.take("else") else Const(None))
        self.depth -= 1
        return value

    def level(self, n: int):
        if n == len(self.LEVELS):
            return self.filtered()
        signs = self.LEVELS[n]
        if signs is None:
            if self.take("not"):
                self.depth += 1
                if self.depth > MAX_DEPTH:
                    raise TemplateError("nested too deeply")
                return Apply("not", (self.level(n),))
            return self.level(n + 1)
        value = self.level(n + 1)
        while self.peek() in signs:
            sign = self.peek()
            self.at += 1
            value = Apply(sign, (value, self.level(n + 1)))
        return value

    def filtered(self):
        value = self.primary()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = Apply("|" + name, (value,))
        return value

    def primary(self):
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            tree = Const(int(value))
        elif kind == "string":
            tree = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m.group(1), m.group(1)), value[1:-1], flags=re.S))
        elif kind == "word" and value in _CONSTANTS:
            tree = Const(_CONSTANTS[value])
        elif kind == "word" and value not in _WORDS:
            tree = Name(value)
        elif value == "(":
            tree = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (".", "["):
            if self.take("["):
                tree = Field(tree, self.choice())
                self.need("]")
            else:
                self.at += 1
                kind, key = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
                if kind != "word":
                    raise TemplateError("a field name is missing")
                self.at += 1
                tree = Field(tree, Const(key))
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    parts = [p for p in _PARTS.split(source) if p]
    at = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[list, str]:
        nonlocal at
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        found = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{#") and part.endswith("#}"):
                continue
            if part.startswith("{{") and part.endswith("}}"):
                found.append(Emit(_Expression(part[2:-2]).whole()))
                continue
            if not (part.startswith("{%") and part.endswith("%}")):
                found.append(Emit(Const(part)))
                continue
            order = part[2:-2].strip().strip("-").strip()
            word, _, rest = order.partition(" ")
            if word in ends:
                return found, order
            if word == "for":
                match = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not match:
                    raise TemplateError(f"cannot read {order!r}")
                inner, _ = body(("endfor",), depth + 1)
                found.append(For(match.group(1), _Expression(match.group(2)).whole(), tuple(inner)))
            elif word == "if":
                branches, test = [], _Expression(rest).whole()
                while True:
                    inner, end = body(("elif", "else", "endif"), depth + 1)
                    branches.append((test, tuple(inner)))
                    word, _, rest = end.partition(" ")
                    if word == "endif":
                        break
                    test = Const(True) if word == "else" else _Expression(rest).whole()
                found.append(If(tuple(branches)))
            elif word == "set":
                name, equals, value = rest.partition("=")
                if not equals or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"cannot read {order!r}")
                found.append(Set(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                inner, _ = body(("endgeneration",), depth + 1)
                found.append(Generation(tuple(inner)))
            else:
                raise TemplateError(f"unexpected {order!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return found, ""

    return tuple(body((), 0)[0])


# --- constant folding -------------------------------------------------------------


def fold(tree):
    """The same tree with constant expressions worked out, branches that are never taken
    left out, and neighbouring texts joined."""
    if isinstance(tree, tuple):
        found = []
        for part in map(fold, tree):
            same = part if isinstance(part, tuple) else (part,)
            for node in same:
                if isinstance(node, Emit) and isinstance(node.value, Const):
                    text = _text(node.value.value)
                    if not text:
                        continue
                    if found and isinstance(found[-1], Emit) and isinstance(found[-1].value, Const):
                        text = found.pop().value.value + text
                    node = Emit(Const(text))
                found.append(node)
        return tuple(found)
    if isinstance(tree, Apply):
        parts = tuple(map(fold, tree.parts))
        if all(isinstance(p, Const) for p in parts):
            try:
                return Const(_operation(tree.operator)(*[p.value for p in parts]))
            except Exception:  # fails, if at all, when it is rendered
                return Apply(tree.operator, parts)
        return Apply(tree.operator, parts)
    if isinstance(tree, Field):
        return Field(fold(tree.of), fold(tree.key))
    if isinstance(tree, Choice):
        test, yes, no = fold(tree.test), fold(tree.yes), fold(tree.no)
        return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
    if isinstance(tree, Emit):
        return Emit(fold(tree.value))
    if isinstance(tree, Set):
        return Set(tree.name, fold(tree.value))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.items), fold(tree.body))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    if isinstance(tree, If):
        branches = []
        for test, inner in tree.branches:
            test, inner = fold(test), fold(inner)
            if isinstance(test, Const) and not test.value:
                continue
            branches.append((test, inner))
            if isinstance(test, Const):
                break
        if not branches:
            return ()
        return branches[0][1] if isinstance(branches[0][0], Const) else If(tuple(branches))
    return tree


# --- closures ---------------------------------------------------------------------

Value = Callable[[dict], object]
Pieces = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _operation(operator: str) -> Callable:
    return FILTERS[operator[1:]] if operator[0] == "|" else OPERATORS[operator]


def _field(of, key):
    if isinstance(of, Mapping) and isinstance(key, str):
        return of.get(key)
    raise TemplateError(f"no field {key!r}")


def _value(tree) -> Value:
    if isinstance(tree, Const):
        return lambda scope, value=tree.value: value
    if isinstance(tree, Name):
        return lambda scope, name=tree.name: scope.get(name)
    if isinstance(tree, Field):
        of, key = _value(tree.of), _value(tree.key)
        return lambda scope: _field(of(scope), key(scope))
    if isinstance(tree, Choice):
        test, yes, no = _value(tree.test), _value(tree.yes), _value(tree.no)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    parts = [_value(p) for p in tree.parts]
    if tree.operator == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if tree.operator == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    run = _operation(tree.operator)
    if len(parts) == 1:
        only = parts[0]
        return lambda scope: run(only(scope))
    left, right = parts
    return lambda scope: run(left(scope), right(scope))


def _ahead(items: Iterable) -> Iterator[tuple[int, object, bool]]:
    """Items with their number and whether they are the last."""
    items = iter(items)
    for now in items:
        number = 0
        for following in items:
            yield number, now, False
            number, now = number + 1, following
        yield number, now, True


def _pieces(tree) -> Pieces:
    if isinstance(tree, tuple):
        steps = [_pieces(t) for t in tree]
        if len(steps) == 1:
            return steps[0]

        def run_all(scope, marked):
            for step in steps:
                yield from step(scope, marked)
        return run_all
    if isinstance(tree, Emit):
        value = _value(tree.value)

        def emit(scope, marked):
            yield _text(value(scope)), marked
        return emit
    if isinstance(tree, Generation):
        inner = _pieces(tree.body)
        return lambda scope, marked: inner(scope, True)
    if isinstance(tree, Set):
        value = _value(tree.value)

        def assign(scope, marked):
            scope[tree.name] = value(scope)
            return iter(())
        return assign
    if isinstance(tree, If):
        branches = [(_value(test), _pieces(inner)) for test, inner in tree.branches]

        def choose(scope, marked):
            for test, inner in branches:
                if test(scope):
                    yield from inner(scope, marked)
                    return
        return choose
    items, inner = _value(tree.items), _pieces(tree.body)

    def loop(scope, marked):
        own = dict(scope)
        for number, item, last in _ahead(items(scope) or ()):
            own[tree.name] = item
            own["loop"] = {"index0": number, "index": number + 1, "first": number == 0, "last": last}
            yield from inner(own, marked)
    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _pieces(self.tree)

    def pieces(self, **context) -> Iterator[tuple[str, bool]]:
        return self._run(context, False)

    def render(self, **context) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans under generation."""
        texts, spans, at = [], [], 0
        for text, marked in self.pieces(**context):
            if marked and text:
                spans.append((at, at + len(text)))
            texts.append(text)
            at += len(text)
        return "".join(texts), spans


# --- reading back -----------------------------------------------------------------


def read_turns(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, list[str], int]]:
    """Turns read from formatted pieces: role, text, unescaped texts under the mask, and
    the length of the formatted turn. Holds one turn at a time."""
    held: list[str] = []
    losses: list[str] = []
    for text, marked in pieces:
        held.append(text)
        if marked:
            losses.append(unescape(text))
        if text.endswith(TURN_END):
            whole = "".join(held)
            head = _TURN.match(whole)
            if not head:
                raise TemplateError("a turn has no head")
            yield unescape(head.group(1)), unescape(whole[head.end():-len(TURN_END)]), losses, len(whole)
            held, losses = [], []
    if "".join(held):
        raise TemplateError("a turn has no end")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation side by side in order; a task sees them as a stream."""
    names = ["conv_id", "turn", "role", "text"]
    return conversations.select(*names).repartition("conv_id").sortWithinPartitions(*names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]
        yield from zip(*columns)


def _messages(rows: Iterable[tuple]) -> Iterator[dict]:
    for _, role, text in rows:
        yield {"role": role or "", "text": text or ""}


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, names, types)
            held = []
    yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(types)], names=names)


def formatted(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: each conversation as one text, and the spans
    of code points under generation."""
    def run(batches):
        template = Template(source)

        def rows():
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                text, spans = template.render(messages=_messages(turns))
                yield conv, text, [list(s) for s in spans]

        yield from _batched(rows(), ["conv_id", "formatted", "loss_spans"],
                            [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))], 200)

    return _ordered(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>")


def digests(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """What is read back from the formatted conversations: ``(conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    Turns are formatted and read back while they stream by, so a task holds one turn,
    however long a conversation is."""
    def run(batches):
        template = Template(source)

        def rows():
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                whole, loss, count, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text, losses, size in read_turns(template.pieces(messages=_messages(turns))):
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for part in losses:
                        loss.update(part.encode("utf-8", "surrogatepass"))
                        loss_chars += len(part)
                    count, chars = count + 1, chars + size
                yield conv, count, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield from _batched(rows(), names, kinds, 2000)

    return _ordered(conversations).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
