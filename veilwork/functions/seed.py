"""Seeds and draws: how a row turns into reproducible pseudo-random numbers.

``seed = md5(salt ':' identifier ':' attempt)`` where the identifier is
``table ':' pk`` or, for value seeding, the original value.  Draw ``k`` is 24
bits of ``sha2(seed)``.  Nothing depends on partitioning, row order or a random
generator, so a recomputed task gives the same masks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "<nil>"
MAX_DRAWS = 10
_DIGITS_PER_WORD = 12  # two 24-bit draws are parsed from the digest at a time


class KeyTypeError(TypeError):
    """A column of this type cannot be used as seed input."""


def is_seedable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.ByteType, T.ShortType, T.IntegerType,
                              T.LongType, T.BooleanType, T.DecimalType, T.DateType, T.TimestampType,
                              T.TimestampNTZType))


def render(col: Column, dtype: T.DataType) -> Column:
    """Text of a value inside a seed, independent of the session time zone."""
    if not is_seedable(dtype):
        raise KeyTypeError(f"{dtype.simpleString()} has no stable text form; cast the column first")
    if isinstance(dtype, T.DateType):
        return F.concat(col.cast("string"), F.lit(" 00:00:00 +0000 UTC"))
    if isinstance(dtype, T.TimestampNTZType):
        return F.concat(col.cast("string"), F.lit(" +0000 UTC"))
    if isinstance(dtype, T.TimestampType):
        seconds = F.unix_micros(col).cast("decimal(20,0)") / F.lit(1_000_000)
        utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
        return F.concat(utc.cast("string"), F.lit(" +0000 UTC"))
    return col.cast("string")


def render_or_nil(col: Column, dtype: T.DataType) -> Column:
    return F.coalesce(render(col, dtype), F.lit(NULL_TEXT))


def pk_identifier(table: str, pk: Sequence[tuple[Column, T.DataType]]) -> Column:
    """``table:pk``; the parts of a composite key are joined with colons."""
    parts = [F.lit(table)]
    for col, dtype in pk:
        parts += [F.lit(":"), render_or_nil(col, dtype)]
    return F.concat(*parts)


def seed_column(salt: str, identifier: Column, attempt: Column) -> Column:
    """32 hex characters; the column name is deliberately not part of the seed."""
    return F.md5(F.concat(F.lit(f"{salt}:"), identifier, F.lit(":"), attempt.cast("string")))


class SeedScope:
    """A seed of the row and the draws taken from it.

    Generators are expressions over columns named here.  The scope remembers
    which draws were used and :func:`materialise_seeds` adds just those, each in
    its own projection, so a digest is computed once per row.
    """

    def __init__(self, prefix: str, expression: Column):
        self.prefix = prefix
        self.expression = expression
        self._words: set[int] = set()

    @property
    def seed(self) -> Column:
        return F.col(f"{self.prefix}seed")

    def draw(self, k: int) -> Column:
        """24-bit integer number ``k`` of this row."""
        if not 0 <= k < MAX_DRAWS:
            raise ValueError(f"a seed holds draws 0..{MAX_DRAWS - 1}")
        self._words.add(k // 2)
        word = F.col(f"{self.prefix}word{k // 2}")
        return F.shiftright(word, 24) if k % 2 == 0 else word.bitwiseAND(F.lit(0xFFFFFF))

    def pick(self, k: int, n: int) -> Column:
        """Draw ``k`` reduced to ``0..n-1``."""
        return (self.draw(k) % F.lit(n)).cast("int")

    def choose(self, k: int, values: Sequence[str]) -> Column:
        """One of the literal ``values``, picked by draw ``k``."""
        return F.get(F.array(*[F.lit(v) for v in values]), self.pick(k, len(values)))


def materialise_seeds(df: DataFrame, scopes: Sequence[SeedScope]) -> DataFrame:
    """Add seed, digest and draw columns for everything the scopes handed out."""
    df = df.withColumns({f"{s.prefix}seed": s.expression for s in scopes})
    drawn = [s for s in scopes if s._words]
    if not drawn:
        return df
    df = df.withColumns({f"{s.prefix}digest": F.sha2(s.seed, 256) for s in drawn})
    words = {}
    for s in drawn:
        for j in sorted(s._words):
            digits = F.substring(F.col(f"{s.prefix}digest"), _DIGITS_PER_WORD * j + 1, _DIGITS_PER_WORD)
            words[f"{s.prefix}word{j}"] = F.conv(digits, 16, 10).cast("long")
    return df.withColumns(words)
