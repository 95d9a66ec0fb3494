"""Text templates compiled, once on the driver, into a string expression.

Supported inside ``{{ }}``: the functions ``counter``, ``hash`` and
``faker "provider"``; the row fields ``.PrimaryKeyValue .OriginalValue
.TableName .ColumnName .Locale .Attempt``; literals; ``if / else if / else /
end``; ``eq ne lt le gt ge and or not len printf``; parentheses; comments and
``{{-``/``-}}`` trimming.  Loops, pipelines, variables and nested templates are
rejected, and so are ``.Salt`` and ``.Seed``, which would print the secret.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .seed import render

if TYPE_CHECKING:
    from .generators import GenContext


class TemplateError(ValueError):
    """The template is malformed or uses something unsupported."""


NO_VALUE = "<no value>"
_ACTION = re.compile(r"\{\{(-\s)?\s*(.*?)\s*(\s-)?\}\}", re.S)
_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|`([^`]*)`|(-?\d+)|(\.?[A-Za-z_]\w*)|([()]))')
_VERB = re.compile(r"%([-+# 0]*\d*)(?:\.(\d*))?([a-zA-Z%])")
_ESCAPE = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}
_COMPARE = {"lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}
_PRINTF_KINDS = {"s": ("str",), "d": ("int",), "x": ("int",), "X": ("int",), "t": ("bool",),
                 "v": ("str", "int", "bool")}


@dataclass(frozen=True)
class _Value:
    """``kind`` is str, int, bool, opaque (prints only) or mixed (tests only)."""

    kind: str
    col: Column
    text: str | None = None  # set for string literals

    def printed(self) -> Column:
        if self.kind == "mixed":
            raise TemplateError("and/or over different types can only be used in a condition")
        return F.coalesce(self.col.cast("string"), F.lit(NO_VALUE))

    def truth(self) -> Column:
        test = {
            "str": lambda: F.octet_length(self.col) > 0,
            "int": lambda: self.col != 0,
            "bool": lambda: self.col,
            "mixed": lambda: self.col,
            "opaque": lambda: self.col.isNotNull(),
        }[self.kind]()
        return F.coalesce(test, F.lit(False))


def _field(name: str, ctx: GenContext) -> _Value:
    if name in (".Salt", ".Seed"):
        raise TemplateError(f"{name} would reveal the secret behind the masks")
    if name == ".OriginalValue":
        return _typed(ctx.original, ctx.original_type)
    if name == ".PrimaryKeyValue":
        if len(ctx.pk) == 1:
            return _typed(*ctx.pk[0])
        return _Value("str", F.concat_ws(":", *[render(c, t) for c, t in ctx.pk]))
    if name == ".Attempt":
        return _Value("int", ctx.attempt)
    fixed = {".TableName": ctx.table, ".ColumnName": ctx.column, ".Locale": ctx.locale}
    if name not in fixed:
        raise TemplateError(f"unknown field {name}; counter, hash and faker are functions and take no dot")
    return _Value("str", F.lit(fixed[name]))


def _typed(col: Column, dtype: T.DataType) -> _Value:
    if isinstance(dtype, T.IntegralType):
        return _Value("int", col)
    if isinstance(dtype, T.BooleanType):
        return _Value("bool", col)
    if isinstance(dtype, T.StringType):
        return _Value("str", col)
    return _Value("opaque", render(col, dtype))


class _Expression:
    """One action, read left to right: an operand, or a function and its operands."""

    def __init__(self, text: str, ctx: GenContext):
        self.ctx = ctx
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise TemplateError(f"unexpected {text[at:].strip()[:10]!r}")
            at = m.end()
            kind = ("quoted", "raw", "number", "word", "paren")[m.lastindex - 1]
            self.tokens.append((kind, m.group(m.lastindex)))
        self.tokens.reverse()

    def compile(self) -> _Value:
        value = self._call()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[-1][1]!r}")
        return value

    def _call(self) -> _Value:
        if not self.tokens:
            raise TemplateError("missing value for command")
        kind, text = self.tokens[-1]
        if kind != "word" or text.startswith(".") or text in ("true", "false"):
            return self._operand()
        self.tokens.pop()
        args = []
        while self.tokens and self.tokens[-1] != ("paren", ")"):
            args.append(self._operand())
        return self._apply(text, args)

    def _operand(self) -> _Value:
        kind, text = self.tokens.pop()
        if kind == "quoted":
            plain = re.sub(r"\\(.)", lambda m: _ESCAPE.get(m.group(1), m.group(0)), text[1:-1])
            return _Value("str", F.lit(plain), plain)
        if kind == "raw":
            return _Value("str", F.lit(text), text)
        if kind == "number":
            return _Value("int", F.lit(int(text)))
        if text == "(":
            value = self._call()
            if not self.tokens or self.tokens.pop() != ("paren", ")"):
                raise TemplateError("unclosed left paren")
            return value
        if text.startswith("."):
            return _field(text, self.ctx)
        if text in ("true", "false"):
            return _Value("bool", F.lit(text == "true"))
        return self._apply(text, [])

    def _apply(self, name: str, args: list[_Value]) -> _Value:
        rule = getattr(self, f"_fn_{name}", None)
        if name in _COMPARE:
            return self._order(name, args)
        if rule is None:
            raise TemplateError(f"function {name!r} not defined")
        return rule(args)

    @staticmethod
    def _need(name: str, args: list[_Value], low: int, high: int | None = None) -> None:
        if len(args) < low or (high is not None and len(args) > high):
            raise TemplateError(f"wrong number of args for {name}: got {len(args)}")

    def _fn_counter(self, args: list[_Value]) -> _Value:
        self._need("counter", args, 0, 0)
        return _Value("str", self.ctx.generate("counter").cast("string"))

    def _fn_hash(self, args: list[_Value]) -> _Value:
        self._need("hash", args, 0, 0)
        return _Value("str", self.ctx.generate("hash"))

    def _fn_faker(self, args: list[_Value]) -> _Value:
        self._need("faker", args, 1, 1)
        if args[0].text is None:
            raise TemplateError("faker takes the provider name as a string literal")
        return _Value("str", self.ctx.generate("faker", provider=args[0].text).cast("string"))

    def _fn_len(self, args: list[_Value]) -> _Value:
        self._need("len", args, 1, 1)
        if args[0].kind != "str":
            raise TemplateError("len needs text")
        return _Value("int", F.coalesce(F.octet_length(args[0].col), F.lit(0)))

    def _fn_not(self, args: list[_Value]) -> _Value:
        self._need("not", args, 1, 1)
        return _Value("bool", ~args[0].truth())

    def _fn_and(self, args: list[_Value]) -> _Value:
        return self._shortcut("and", args)

    def _fn_or(self, args: list[_Value]) -> _Value:
        return self._shortcut("or", args)

    def _shortcut(self, name: str, args: list[_Value]) -> _Value:
        """The first argument that decides the outcome, else the last one."""
        self._need(name, args, 1)
        result = args[-1]
        for value in reversed(args[:-1]):
            decides = ~value.truth() if name == "and" else value.truth()
            if value.kind == result.kind:
                result = _Value(value.kind, F.when(decides, value.col).otherwise(result.col))
            else:
                result = _Value("mixed", F.when(decides, value.truth()).otherwise(result.truth()))
        return result

    def _fn_eq(self, args: list[_Value]) -> _Value:
        self._need("eq", args, 2)
        self._comparable(args)
        test = F.lit(False)
        for other in args[1:]:
            test = test | args[0].col.eqNullSafe(other.col)
        return _Value("bool", test)

    def _fn_ne(self, args: list[_Value]) -> _Value:
        self._need("ne", args, 2, 2)
        return _Value("bool", ~self._fn_eq(args).col)

    def _order(self, name: str, args: list[_Value]) -> _Value:
        self._need(name, args, 2, 2)
        self._comparable(args, ("str", "int"))
        return _Value("bool", F.coalesce(_COMPARE[name](args[0].col, args[1].col), F.lit(False)))

    @staticmethod
    def _comparable(args: list[_Value], kinds: tuple[str, ...] = ("str", "int", "bool")) -> None:
        found = {a.kind for a in args}
        if len(found) != 1 or not found <= set(kinds):
            raise TemplateError(f"incompatible types for comparison: {sorted(found)}")

    def _fn_printf(self, args: list[_Value]) -> _Value:
        self._need("printf", args, 1)
        if args[0].text is None:
            raise TemplateError("printf takes its format as a string literal")
        rest = iter(args[1:])
        cols: list[Column] = []

        def verb(m: re.Match[str]) -> str:
            flags, precision, letter = m.groups()
            if letter == "%":
                return "%%"
            value = next(rest, None)
            if value is None or value.kind not in _PRINTF_KINDS.get(letter, ()):
                raise TemplateError(f"printf: %{flags}{letter} does not fit its argument")
            text = value.kind == "str"
            if precision is not None and not text:
                raise TemplateError(f"printf: {m.group(0)} gives a precision, which only text takes")
            col = F.coalesce(value.col, F.lit("<nil>")) if text else value.col
            cols.append(F.substring(col, 1, int(precision or 0)) if precision is not None else col)
            return f"%{flags}" + ({"str": "s", "int": "d", "bool": "b"}[value.kind] if letter in "vt" else letter)

        pattern = _VERB.sub(verb, args[0].text)
        if next(rest, None) is not None:
            raise TemplateError("printf: too many arguments")
        return _Value("str", F.format_string(pattern, *cols) if cols else F.lit(pattern.replace("%%", "%")))


def _pieces(text: str) -> list[tuple[str, str]]:
    """Alternating ``("text", ...)`` and ``("action", ...)`` pieces in reverse order."""
    out, at, trim = [], 0, False
    for m in _ACTION.finditer(text):
        literal = text[at:m.start()]
        literal = literal.lstrip() if trim else literal
        literal = literal.rstrip() if m.group(1) else literal
        if "{{" in literal:
            raise TemplateError("unclosed action")
        out += [("text", literal), ("action", m.group(2))]
        at, trim = m.end(), bool(m.group(3))
    tail = text[at:].lstrip() if trim else text[at:]
    if "{{" in tail:
        raise TemplateError("unclosed action")
    out.append(("text", tail))
    return out[::-1]


def _block(pieces: list[tuple[str, str]], ctx: GenContext, nested: bool) -> tuple[Column, str]:
    """Concatenate pieces up to the end of the block; returns what closed it."""
    parts: list[Column] = []
    while pieces:
        kind, text = pieces.pop()
        head = text.split(None, 1)[0] if text.split() else ""
        if kind == "text":
            if text:
                parts.append(F.lit(text))
        elif text.startswith("/*") and text.endswith("*/"):
            continue
        elif head in ("else", "end"):
            if not nested:
                raise TemplateError(f"unexpected {{{{{head}}}}}")
            return _joined(parts), text
        elif head == "if":
            parts.append(_condition(text[2:], pieces, ctx))
        elif head in ("range", "define", "block", "with", "template", "break", "continue"):
            raise TemplateError(f"{head!r} is not supported")
        else:
            parts.append(_Expression(text, ctx).compile().printed())
    if nested:
        raise TemplateError("unexpected end of template, missing {{end}}")
    return _joined(parts), ""


def _condition(test: str, pieces: list[tuple[str, str]], ctx: GenContext) -> Column:
    truth = _Expression(test, ctx).compile().truth()
    then, closer = _block(pieces, ctx, nested=True)
    otherwise: Column = F.lit("")
    words = closer.split(None, 1)
    if words[0] == "else" and len(words) == 1:
        otherwise, closer = _block(pieces, ctx, nested=True)
        if closer != "end":
            raise TemplateError("expected {{end}} after {{else}}")
    elif words[0] == "else":
        if not words[1].startswith("if"):
            raise TemplateError(f"unexpected {words[1]!r} after else")
        otherwise = _condition(words[1][2:], pieces, ctx)
    return F.when(truth, then).otherwise(otherwise)


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


def compile_template(text: str, ctx: GenContext) -> Column:
    """The template as one string expression over the row of ``ctx``."""
    column, _ = _block(_pieces(text), ctx, nested=False)
    return column
