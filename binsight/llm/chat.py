"""Chat formatting: a small sandboxed template language compiled to Python closures.

``compile_template`` parses a template into a syntax tree, folds constants and
turns the tree into generators that yield (text, trained on?) pieces. Templates
see plain values only: names, ``.key`` lookups in mappings, literals, ``+``,
comparisons, ``and or not`` and the filters below; there is no call, attribute
or import. A loop over ``messages`` pulls them one by one, so a conversation is
rendered as a stream however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is ``[INST]role[:]text[/INST]`` or, for the assistant, ``[ASSISTANT]text</s>``;
#: ``guard`` keeps these strings out of roles and texts.
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'assistant' %}[ASSISTANT]{% generation %}{{ m.content | guard }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ m.role | guard }}[:]{{ m.content | guard }}[/INST]{% endif %}\n"
    "{% endfor %}")

PART_CHARS = 1 << 20  # a longer conversation comes in several rows


def guard(text: str) -> str:
    """Break control strings: a backslash after every ``<`` and ``[``, and every backslash doubled."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


_GUARDED = re.compile(r"([\\<\[])\\")


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "guard": lambda v: guard(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(), "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
}


class TemplateError(ValueError):
    """The template is not in the language."""


def _text(v: Any) -> str:
    if v is None:
        return ""
    return str(v).lower() if isinstance(v, bool) else str(v)


# ---- syntax ---------------------------------------------------------------

_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<do>.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>().|\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:].strip()!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression; trees are tuples."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *words: str) -> str | None:
        if self.peek() in words:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        while op := self.take("==", "!=", "<", ">", "<=", ">="):
            tree = (op, tree, self.added())
        return tree

    def added(self) -> tuple:
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.value()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def value(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            tree: tuple = ("const", int(word))
        elif kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            tree = ("const", fixed[word]) if word in fixed else ("name", word)
        elif word == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        else:
            raise TemplateError(f"unexpected {word!r}")
        while op := self.take(".", "["):
            if op == "[":
                tree = ("get", tree, self.either())
                if not self.take("]"):
                    raise TemplateError("missing ]")
            else:
                kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
                self.at += 1
                tree = ("get", tree, ("const", word))
        return tree


def parse(source: str) -> tuple:
    """Syntax tree of a template: ("block", nodes) of text, out, set, if, for and generation."""
    stack: list[tuple[str, Any, list]] = [("block", None, [])]
    at, trim = 0, False

    def close(word: str) -> tuple[str, Any, list]:
        if len(stack) < 2 or stack[-1][0] != word:
            raise TemplateError(f"unexpected end of {word}")
        return stack.pop()

    for m in [*_TAG.finditer(source), None]:
        text = source[at:m.start()] if m else source[at:]
        text = text.lstrip() if trim else text
        if m and source[m.start() + 2:m.start() + 3] == "-":
            text = text.rstrip()
        if text:
            stack[-1][2].append(("text", text))
        if not m:
            break
        at, trim = m.end(), source[m.end() - 3] == "-"
        if m["out"] is not None:
            stack[-1][2].append(("out", _Expression(m["out"]).whole()))
            continue
        if m["do"] is None:
            continue
        word, _, rest = m["do"].strip().partition(" ")
        if word == "if":
            stack.append(("if", [(_Expression(rest).whole(), [])], []))
            stack[-1] = ("if", stack[-1][1], stack[-1][1][-1][1])
        elif word in ("elif", "else"):
            kind, arms, _ = close("if")
            arms.append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            stack.append((kind, arms, arms[-1][1]))
        elif word == "for":
            name = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not name:
                raise TemplateError(f"cannot read for {rest!r}")
            stack.append(("for", (name[1], _Expression(name[2]).whole()), []))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == "set":
            name = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not name:
                raise TemplateError(f"cannot read set {rest!r}")
            stack[-1][2].append(("set", name[1], _Expression(name[2]).whole()))
        elif word in ("endif", "endfor", "endgeneration"):
            kind, head, body = close(word[3:])
            stack[-1][2].append((kind, head) if kind == "if" else (kind, head, body))
        else:
            raise TemplateError(f"no statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", stack[0][2])


# ---- constants ------------------------------------------------------------

_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "<": lambda a, b: _ordered(a, b) and a < b, ">": lambda a, b: _ordered(a, b) and a > b,
    "<=": lambda a, b: _ordered(a, b) and a <= b, ">=": lambda a, b: _ordered(a, b) and a >= b,
}


def _ordered(a: Any, b: Any) -> bool:
    return isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int)


def fold(tree: tuple) -> tuple:
    """The expression with everything computed that holds no name."""
    if tree[0] in ("const", "name"):
        return tree
    parts = [fold(x) if isinstance(x, tuple) else x for x in tree[1:]]
    if all(not isinstance(x, tuple) or x[0] == "const" for x in parts):
        return ("const", _expression((tree[0], *parts))({}))
    return (tree[0], *parts)


def fold_block(nodes: list) -> list:
    """Folded nodes: constant output joins the text around it, dead arms go."""
    out: list = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            e = fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2])))
        elif node[0] == "for":
            add(("for", (node[1][0], fold(node[1][1])), fold_block(node[2])))
        elif node[0] == "generation":
            add(("generation", None, fold_block(node[2])))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_block(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


# ---- closures -------------------------------------------------------------

def _expression(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "filter":
        f, inner = FILTERS[tree[1]], _expression(tree[2])
        return lambda env: f(inner(env))
    if kind == "not":
        inner = _expression(tree[1])
        return lambda env: not inner(env)
    a, b = _expression(tree[1]), _expression(tree[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "get":
        def get(env: dict) -> Any:
            v, k = a(env), b(env)
            if isinstance(v, dict):
                return v.get(k)
            return v[k] if isinstance(v, list) and isinstance(k, int) and k < len(v) else None
        return get
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


Pieces = Iterator[tuple[str, bool]]


def _uses_last(node: Any) -> bool:
    return node == ("get", ("name", "loop"), ("const", "last")) or (
        isinstance(node, (tuple, list)) and any(map(_uses_last, node)))


def _closure(nodes: list) -> Callable[[dict, bool], Pieces]:
    steps = [_node(n) for n in nodes]

    def run(env: dict, on: bool) -> Pieces:
        for step in steps:
            yield from step(env, on)
    return run


def _node(node: tuple) -> Callable[[dict, bool], Pieces]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, on: iter(((text, on),))
    if kind == "out":
        e = _expression(node[1])
        return lambda env, on: iter(((_text(e(env)), on),))
    if kind == "set":
        name, e = node[1], _expression(node[2])

        def put(env: dict, on: bool) -> Pieces:
            env[name] = e(env)
            return iter(())
        return put
    if kind == "generation":
        body = _closure(node[2])
        return lambda env, on: body(env, True)
    if kind == "if":
        arms = [(_expression(t), _closure(b)) for t, b in node[1]]

        def choose(env: dict, on: bool) -> Pieces:
            for test, body in arms:
                if test(env):
                    return body(env, on)
            return iter(())
        return choose
    name, items, body, ahead = node[1][0], _expression(node[1][1]), _closure(node[2]), _uses_last(node[2])

    def loop(env: dict, on: bool) -> Pieces:
        rows = items(env)
        rows = iter(rows) if rows is not None and not isinstance(rows, (str, int)) else iter(())
        end = object()
        now = next(rows, end)
        i = 0
        while now is not end:
            following = next(rows, end) if ahead else None
            inner = env | {name: now, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": following is end}}
            yield from body(inner, on)
            now = following if ahead else next(rows, end)
            i += 1
    return loop


def compile_template(source: str) -> Callable[..., Pieces]:
    """Function of the template's variables that yields (text, under a generation mark?)."""
    run = _closure(fold_block(parse(source)[1]))
    return lambda **variables: run(dict(variables), False)


# ---- conversations --------------------------------------------------------

def _by_conversation(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """(key, rows) of runs of equal first columns, without holding a run."""
    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)
        same = run()
        yield key, same
        for _ in same:
            pass


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, start, text, marks): the rendered conversations.

    A conversation's rows are rendered in the order of turn (nulls first), then
    role and text; repeated rows are turns of their own. Null roles and texts
    are empty; a null conversation id is a conversation. ``text`` is the part
    that begins at code point ``start``; ``marks`` are the (start, end) code
    points of the whole conversation that training takes loss on. Parts of a
    conversation are consecutive rows of one partition. No rows give no rows.
    """
    compile_template(template)  # an error shows here, not in a task
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        schema = _part_schema
        held: list[tuple] = []
        size = 0
        for key, group in _by_conversation(batches, ["conv_id", "role", "content"]):
            messages = ({"role": r, "content": c} for r, c in group)
            at = begin = part = 0
            texts: list[str] = []
            marks: list[list[int]] = []
            for text, on in render(messages=messages):
                if text:
                    texts.append(text)
                    if on:
                        if marks and marks[-1][1] == at:
                            marks[-1][1] = at + len(text)
                        else:
                            marks.append([at, at + len(text)])
                    at += len(text)
                if at - begin >= PART_CHARS:
                    held.append((key, part, begin, "".join(texts), marks))
                    yield _batch(held, batch_type, schema)
                    held, size = [], 0
                    begin, part, texts, marks = at, part + 1, [], []
            if texts or not part:
                held.append((key, part, begin, "".join(texts), marks))
                size += at - begin
            if size >= PART_CHARS:
                yield _batch(held, batch_type, schema)
                held, size = [], 0
        if held:
            yield _batch(held, batch_type, schema)

    batch_type = _arrow_type(kind)
    return rows.mapInArrow(run, f"conv_id {kind}, part int, start long, text string, marks array<struct<start:long,end:long>>")


_part_schema = ("conv_id", "part", "start", "text", "marks")


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _batch(rows: list[tuple], key_type: pa.DataType, names: tuple) -> pa.RecordBatch:
    mark = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = list(zip(*rows))
    columns[4] = [[{"start": a, "end": b} for a, b in m] for m in columns[4]]
    kinds = (key_type, pa.int32(), pa.int64(), pa.string(), mark)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


_TURN = re.compile(r"(?:<s>)?(?:\[INST\](?P<role>.*?)\[:\](?P<text>.*?)\[/INST\]|\[ASSISTANT\](?P<said>.*?)</s>)\n", re.S)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests read from ``format_conversations`` rows of the default template:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    key_type = _arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "start", "text", "marks"]
        out = []
        for key, group in _by_conversation(batches, names):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rest = ""
            for _, start, text, marks in group:
                chars += len(text)
                for m in marks:
                    said = unguard(text[m["start"] - start:m["end"] - start])
                    loss_chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
                rest += text
                end = 0
                for t in _TURN.finditer(rest):
                    role = "assistant" if t["said"] is not None else unguard(t["role"])
                    said = unguard(t["said"] if t["said"] is not None else t["text"])
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n, end = n + 1, t.end()
                rest = rest[end:]
            out.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")
