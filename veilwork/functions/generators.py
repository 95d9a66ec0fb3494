"""Column generators: a rule and a row context become one expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import GenSpec
from .providers import UnknownProvider, find_provider
from .seed import SeedScope
from .template import TemplateError, compile_template


class UnknownGenerator(ValueError):
    pass


@dataclass(frozen=True)
class GenContext:
    """What a generator may look at: the rule, the row and its seed."""

    scope: SeedScope
    gen: GenSpec
    table: str
    column: str
    locale: str
    pk: Sequence[tuple[Column, T.DataType]]
    original: Column
    original_type: T.DataType
    attempt: Column = field(default_factory=lambda: F.lit(0))

    @property
    def seed(self) -> Column:
        return self.scope.seed

    def generate(self, kind: str, **params: Any) -> Column:
        """Another generator over the same row and seed."""
        return build_generator(replace(self, gen=GenSpec(kind, **params)))


@dataclass(frozen=True)
class Generator:
    """``produces`` is string, int64, bool, null or any.

    ``check(gen, dtype)`` returns a problem as text, or None.  ``domain(gen,
    locale)`` bounds the number of different values.
    """

    build: Callable[[GenContext], Column]
    produces: str = "string"
    check: Callable[[GenSpec, T.DataType | None], str | None] | None = None
    domain: Callable[[GenSpec, str], int | None] = lambda gen, locale: None


_registry: dict[str, Generator] = {}


def register_generator(name: str, build: Callable[[GenContext], Column], produces: str = "string",
                       check: Callable[[GenSpec, T.DataType | None], str | None] | None = None,
                       domain: Callable[[GenSpec, str], int | None] | None = None) -> None:
    """Add a generator type; a name can be taken only once."""
    if name in _registry:
        raise ValueError(f"another generator is called {name!r}")
    _registry[name] = Generator(build, produces, check, domain or (lambda gen, locale: None))


def find_generator(name: str) -> Generator:
    try:
        return _registry[name]
    except KeyError:
        raise UnknownGenerator(f"no generator is called {name!r}") from None


def build_generator(ctx: GenContext) -> Column:
    return find_generator(ctx.gen.type).build(ctx)


def domain_size(gen: GenSpec, locale: str) -> int | None:
    return find_generator(gen.type).domain(gen, locale)


def _counter(ctx: GenContext) -> Column:
    """Absolute value of the leading 64 seed bits; the one value without a
    positive counterpart stays negative."""
    signed = F.conv(F.substring(ctx.seed, 1, 16), 16, -10).cast("long")
    return F.when(signed == F.lit(-2 ** 63), signed).otherwise(F.abs(signed))


def _faker(ctx: GenContext) -> Column:
    if not ctx.gen.provider:
        raise UnknownProvider("a faker rule has to name its provider")
    return find_provider(ctx.gen.provider, ctx.locale).build(ctx.scope)


def _faker_domain(gen: GenSpec, locale: str) -> int | None:
    return find_provider(gen.provider, locale).domain


def _template(ctx: GenContext) -> Column:
    if not ctx.gen.template:
        raise TemplateError("a template rule has to give its text")
    return compile_template(ctx.gen.template, ctx)


register_generator("faker", _faker, domain=_faker_domain)
register_generator("template", _template)
register_generator("constant", lambda ctx: F.lit(ctx.gen.value), domain=lambda gen, locale: 1)
register_generator("null", lambda ctx: F.lit(None), produces="null")
register_generator("hash", lambda ctx: ctx.seed)
register_generator("counter", _counter, produces="int64")
