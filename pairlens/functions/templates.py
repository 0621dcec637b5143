"""Chat templates of models as column expressions.

A template is text with ``{{ value }}`` and ``{% for %}``, ``{% if %}`` and ``{% set %}`` between. What
stands in the braces is read as a Python expression, which it is but for ``~``, filters (read as
products, so that they bind more tightly than sums) and ``is defined``; what it says about the messages becomes an expression over the
array column, and what it says about settings is settled while compiling. Nothing runs in Python for a row.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let, strip

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)
_STRING = re.compile(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")""", re.S)


class TemplateError(ValueError):
    """What a template asks for is not known here."""


@dataclass(frozen=True)
class Loop:
    """``loop`` of the innermost for."""

    place: Column
    size: Column


@dataclass
class Block:
    """A statement with its branches: (condition or loop head, statements)."""

    kind: str
    head: str
    body: list


def _settled(value: object) -> bool:
    return not isinstance(value, (Column, Loop))


def _pieces(template: str) -> list[tuple[str, str]]:
    """(kind, content) of texts, values and statements; a dash in a tag takes the white space beside it, a statement takes the line end after it."""
    out: list[tuple[str, str]] = []
    eat = False
    for k, piece in enumerate(_TAG.split(template)):
        if k % 2 == 0:
            out.append(("text", piece.lstrip() if eat else piece))
            eat = False
            continue
        if piece[2] == "-" and out:
            out[-1] = ("text", out[-1][1].rstrip())
        eat = piece[-3] == "-"
        if piece[1] != "#":
            out.append(("value" if piece[1] == "{" else "statement", piece[2:-2].strip("-").strip()))
    return out


def _tree(pieces: list[tuple[str, str]]) -> list:
    """Statements nested as they are written."""
    top: list = []
    stack: list[tuple[Block | None, list]] = [(None, top)]
    for kind, said in pieces:
        if kind != "statement":
            if said:
                stack[-1][1].append((kind, said))
            continue
        word, _, rest = said.partition(" ")
        if word in ("for", "if"):
            block = Block(word, rest, [])
            branch: list = []
            block.body.append((rest, branch))
            stack[-1][1].append(block)
            stack.append((block, branch))
        elif word in ("elif", "else"):
            block, _ = stack.pop()
            if block is None or block.kind != "if":
                raise TemplateError(f"{word} without if")
            branch = []
            block.body.append((rest if word == "elif" else "", branch))
            stack.append((block, branch))
        elif word in ("endif", "endfor"):
            block, _ = stack.pop()
            if block is None or word != f"end{block.kind}":
                raise TemplateError(f"{word} closes nothing")
        elif word == "set":
            stack[-1][1].append(("set", rest))
        else:
            raise TemplateError(f"unknown statement: {said}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0].kind} is not closed")
    return top


def _parsed(text: str) -> ast.expr:
    parts = _STRING.split(text)
    tests = lambda p: re.sub(r"\bis (not )?defined\b", r"is \1DEFINED", p.replace("~", "+").replace("|", "@"))
    plain = [tests(p) if k % 2 == 0 else p.replace("\n", "\\n") for k, p in enumerate(parts)]
    return ast.parse("".join(plain).strip(), mode="eval").body


def _column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _maybe(value: object) -> Column:
    """A column of what one branch sets; what is settled as false or none is null, as the other branch may set a text."""
    return F.lit(None) if value is False or value is None else _column(value)


def _true(value: object) -> object:
    """Whether a value counts as true: settled, or a column; a text that is not empty does."""
    if _settled(value):
        return bool(value)
    return F.coalesce(value.cast("string") != "", F.lit(False)) & (F.coalesce(value.cast("string"), F.lit("")) != "false")


class Compiler:
    """Names of settings and columns, and the expressions over them."""

    def __init__(self, names: dict[str, object]):
        self.names = names

    def value(self, e: ast.expr) -> object:
        found = getattr(self, f"_{type(e).__name__.lower()}", None)
        if found is None:
            raise TemplateError(f"unknown expression: {ast.unparse(e)}")
        return found(e)

    def _constant(self, e):
        return e.value

    def _name(self, e):
        known = {"true": True, "false": False, "none": None}
        return known[e.id] if e.id in known else self.names.get(e.id)

    def _attribute(self, e):
        of = self.value(e.value)
        if isinstance(of, Loop):
            return {"index0": of.place, "index": of.place + 1, "first": of.place == 0, "last": of.place == of.size - 1, "length": of.size}[e.attr]
        return of[e.attr]

    def _subscript(self, e):
        of = self.value(e.value)
        if isinstance(e.slice, ast.Slice):
            if e.slice.upper or e.slice.step:
                raise TemplateError(f"unknown slice: {ast.unparse(e)}")
            start = self.value(e.slice.lower)
            return F.slice(of, start + 1, F.greatest(F.size(of) - start, F.lit(0)))
        at = self.value(e.slice)
        return F.try_element_at(of, F.lit(at + 1 if at >= 0 else at)) if isinstance(at, int) else of[at]

    def _binop(self, e):
        left = self.value(e.left)
        if isinstance(e.op, ast.MatMult):  # a filter
            name = e.right.func.id if isinstance(e.right, ast.Call) else e.right.id
            filters = {"trim": strip, "length": F.size, "upper": F.upper, "lower": F.lower, "string": lambda c: c.cast("string")}
            if name not in filters:
                raise TemplateError(f"unknown filter: {name}")
            return filters[name](_column(left))
        right = self.value(e.right)
        if isinstance(e.op, ast.Add):
            if _settled(left) and _settled(right):
                return left + right
            counts = any(isinstance(x, int) for x in (left, right))
            return _column(left) + _column(right) if counts else F.concat(_column(left), _column(right))
        if isinstance(e.op, ast.Mod):
            return left % right
        raise TemplateError(f"unknown operation: {ast.unparse(e)}")

    def _compare(self, e):
        if len(e.ops) > 1:
            raise TemplateError(f"unknown comparison: {ast.unparse(e)}")
        op, right = e.ops[0], e.comparators[0]
        if isinstance(right, ast.Name) and right.id == "DEFINED":
            known = isinstance(e.left, ast.Name) and e.left.id in self.names
            if not isinstance(e.left, ast.Name):
                known = self.value(e.left).isNotNull()
            return known if isinstance(op, ast.Is) else ~known if isinstance(known, Column) else not known
        a, b = self.value(e.left), self.value(right)
        if isinstance(op, (ast.Is, ast.IsNot)):
            same = (a is b) if _settled(a) and _settled(b) else (a.isNull() if b is None else b.isNull())
            return same if isinstance(op, ast.Is) else ~same if isinstance(same, Column) else not same
        if isinstance(op, (ast.In, ast.NotIn)):
            inside = (a in b) if _settled(a) and _settled(b) else F.coalesce(F.contains(_column(b), _column(a)), F.lit(False))
            return inside if isinstance(op, ast.In) else ~inside if isinstance(inside, Column) else not inside
        for one, other in ((a, b), (b, a)):
            if isinstance(one, Column) and (other is None or isinstance(other, bool)):  # a text or null against a settled truth
                same = F.coalesce(one.cast("string"), F.lit("false")) == ("true" if other else "false")
                return same if isinstance(op, ast.Eq) else ~same
        if isinstance(op, ast.Eq):
            return a == b if _settled(a) and _settled(b) else _column(a).eqNullSafe(_column(b))
        if isinstance(op, ast.NotEq):
            return a != b if _settled(a) and _settled(b) else ~_column(a).eqNullSafe(_column(b))
        order = {ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y, ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y}
        return order[type(op)](a, b)

    def _boolop(self, e):
        both = isinstance(e.op, ast.And)
        values = []
        for part in e.values:  # a settled part decides before the others are looked at
            value = _true(self.value(part))
            if _settled(value):
                if value != both:
                    return not both
                continue
            values.append(value)
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), values) if values else both

    def _unaryop(self, e):
        if isinstance(e.op, ast.USub):
            return -self.value(e.operand)
        value = _true(self.value(e.operand))
        return ~value if isinstance(value, Column) else not value

    def _ifexp(self, e):
        test = _true(self.value(e.test))
        if _settled(test):
            return self.value(e.body if test else e.orelse)
        return F.when(test, _column(self.value(e.body))).otherwise(_column(self.value(e.orelse)))

    def _call(self, e):
        if isinstance(e.func, ast.Name) and e.func.id == "raise_exception":
            return F.raise_error(_column(self.value(e.args[0]))).cast("string")
        if isinstance(e.func, ast.Attribute) and e.func.attr in ("strip", "startswith", "endswith"):
            of = _column(self.value(e.func.value))
            return strip(of) if e.func.attr == "strip" else getattr(of, e.func.attr)(self.value(e.args[0]))
        raise TemplateError(f"unknown call: {ast.unparse(e)}")

    def render(self, statements: list) -> Column:
        """The text of statements, one after the other; names that they set stay set."""
        out: list[Column] = []
        for statement in statements:
            if isinstance(statement, Block):
                out.append(self._for(statement) if statement.kind == "for" else self._if(statement.body))
                continue
            kind, said = statement
            if kind == "text":
                out.append(F.lit(said))
            elif kind == "value":
                value = self.value(_parsed(said))
                out.append(F.lit("" if value is None else str(value)) if _settled(value) else F.coalesce(value.cast("string"), F.lit("")))
            else:
                name, _, rest = said.partition("=")
                self.names[name.strip()] = self.value(_parsed(rest))
        return F.concat(*out) if out else F.lit("")

    def _for(self, block: Block) -> Column:
        name, _, rest = block.head.partition(" in ")
        over = self.value(_parsed(rest))

        def loop(held: Column) -> Column:
            def each(item: Column, place: Column) -> Column:
                inner = Compiler(self.names | {name.strip(): item, "loop": Loop(place, F.size(held))})  # what a loop sets ends with it
                return inner.render(block.body[0][1])

            return F.array_join(F.transform(held, each), "")

        return let(over, loop)

    def _if(self, branches: list[tuple[str, list]]) -> Column:
        if not branches:
            return F.lit("")
        (head, body), rest = branches[0], branches[1:]
        test = _true(self.value(_parsed(head))) if head else True
        if _settled(test):
            return self.render(body) if test else self._if(rest)
        yes, no = Compiler(dict(self.names)), Compiler(dict(self.names))
        text = F.when(test, yes.render(body)).otherwise(no._if(rest))
        for name in yes.names.keys() | no.names.keys():
            a, b = yes.names.get(name), no.names.get(name)
            self.names[name] = a if a is b else F.when(test, _maybe(a)).otherwise(_maybe(b))
        return text


def rendered_by(template: str, messages: Column, **settings: object) -> Column:
    """The text that a chat template makes of an array of messages (structs with role and content).

    ``settings`` are what else it names: add_generation_prompt, bos_token, enable_thinking and so
    on; a name that is not given counts as undefined. raise_exception fails the query where a row
    comes to it. Null messages give null. A statement or expression that is not known raises TemplateError here and now.
    """
    text = Compiler({**settings, "messages": messages}).render(_tree(_pieces(template)))
    return F.when(messages.isNotNull(), text)
