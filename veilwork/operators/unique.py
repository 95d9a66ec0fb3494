"""Distinct masks: give every row the first try whose value nobody ahead holds.

The result equals a serial pass in key order in which each row takes its first
value not taken yet.  It is computed in parallel by claims: a value is held by
the smallest key that ever claimed it, and a row claims its first try that no
smaller key holds.  Holders only get smaller, so a try held by a smaller key is
lost for good, and the holders alone are the state: they are the one table that
a round writes, and a round without a change is the last.

The first round is one aggregation with map-side combining over all rows.  Rows
that lose there take part in the rounds, and so do holders of a value that a
smaller row taking part has in any of its tries, until there are no more of them;
everybody else keeps the first try.  Of the tries of those taking part only the
ones that no smaller key holds after the first round are written, once: where few
values meet many rows they are about as many as the values, not the rows, and a
row without any is done.  A later round asks only rows that have a try whose value changed holder
in the round before: nobody else's first open try can have become another one.
It writes the values whose holder it changed, and a round without any is the
last.  Written tables hold keys, tries and masks, never original values, and go
when the outcome, a table of the rows that differ from the common case, is
written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..storage import Workspace

FORCE_UNIQUE_TRIES = 10
UNIQUE_COLUMN_TRIES = 11  # the first value and ten retries


class KeyProblem(ValueError):
    """Rows without a key, or several rows with one."""


@dataclass(frozen=True)
class Attempts:
    """Which try each row ends with.

    ``table`` has the key columns and ``attempt`` (NULL: no free value was
    found) for the rows listed; all other rows end with the first try.
    ``table`` is None when every row does.  ``asked`` counts the rows that each
    round asked, as far as that was counted.
    """

    table: DataFrame | None
    exhausted: int
    rounds: int
    asked: tuple[int, ...] = ()


def check_keys(rows: DataFrame, pk: Sequence[str]) -> None:
    """Raise unless every row has a key of its own, on which the order of rows rests."""
    missing = F.lit(False)
    for c in pk:
        missing = missing | F.col(c).isNull()
    found = rows.groupBy(*pk).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(~missing, F.col("n") - 1)), F.lit(0)).alias("repeats")).first()
    if found["nulls"] or found["repeats"]:
        raise KeyProblem(f"{found['nulls']} rows have no key, {found['repeats']} repeat another row's key")


def resolve_attempts(
    rows: DataFrame,
    pk: Sequence[str],
    carry: Sequence[str],
    with_value: Callable[[DataFrame], DataFrame],
    tries: int,
    taken: DataFrame | None = None,
    alike: bool = False,
    keys_checked: bool = False,
    count_asked: bool = False,
) -> Attempts:
    """Find the try of each row.

    ``rows`` has the key ``pk`` (checked here unless ``keys_checked``) and the
    columns ``carry`` that values depend on.  ``with_value`` adds ``value`` for
    the column ``attempt``.  ``taken`` (column ``value``) lists values nobody may
    use.  ``alike`` says that values depend on ``carry`` only, not on the key.
    """
    pk, ident = list(pk), [*pk, *carry]
    if not keys_checked:
        check_keys(rows, pk)
    ws = Workspace(rows.sparkSession, "attempts")
    key = key_of(pk)

    first = with_value(rows.select(*ident).withColumn("attempt", F.lit(0)))
    holders = ws.save(_first_round(first, key, taken), "holders")
    contested = holders.where((F.col("n") > 1) | (F.col("taken") & (F.col("n") > 0))).where(F.col("value").isNotNull())
    if contested.isEmpty():
        ws.drop()
        return Attempts(None, 0, 1)

    lost = first.join(contested, "value").where(F.col("taken") | (key > F.col("holder"))).select(*ident)
    listed = ws.save(lost.select(*pk), "listed-0")
    if alike:
        # Rows with the same tries get at most one value per try, smallest keys first, so all others are done.  The
        # filter works within each map task before the shuffle, which keeps large groups small.
        rank = F.row_number().over(Window.partitionBy(*carry).orderBy(*pk))
        lost = lost.withColumn("rank", rank).where(F.col("rank") <= tries).drop("rank")

    def tries_of(some: DataFrame) -> DataFrame:
        every = some.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        return _open(with_value(every).select(*pk, "attempt", "value"), holders, key).select(*pk, "attempt", "value")

    names = ["tries-0"]
    asked = added = ws.save(tries_of(lost), names[0])
    while True:  # holders of what the rows just added want, and come after
        wanted = added.groupBy("value").agg(F.min(key).alias("by"))
        threatened = holders.join(wanted, "value").where(~F.col("taken") & (F.col("by") < F.col("holder"))).select(
            F.col("holder").alias("key")).distinct().select(*unpack(pk)).join(asked.select(*pk), pk, "left_anti")
        names.append(f"tries-{len(names)}")
        added = ws.save(tries_of(rows.select(*ident).join(threatened, pk)), names[-1])
        if added.isEmpty():
            break
        asked = ws.read(asked, *names)
    if len(names) > 2:
        asked = ws.save(asked, "tries")
    # All changes of holders there were, and at the start the holders after the first round.
    wanted = asked.select("value").where(F.col("value").isNotNull())
    log = ws.save(holders.join(wanted, "value", "left_semi").select("value", "holder", "taken"), "held-0")
    names, asking = ["held-0"], [asked.select(*pk).distinct().count() if count_asked else -1]
    affected = asked
    while True:
        seen = Observation(f"round-{len(names)}")
        changed = ws.save(_changed(affected, log, pk, key).observe(seen, F.count(F.lit(1)).alias("n")), f"held-{len(names)}")
        names.append(f"held-{len(names)}")
        if not seen.get["n"]:
            break
        log = ws.read(log, *names)
        again = asked.join(changed.select("value"), "value", "left_semi").select(*pk)
        affected = asked.join(again, pk, "left_semi")
        asking.append(again.distinct().count() if count_asked else -1)
    final = _open(asked, _held(log), key).groupBy(*pk).agg(F.min("attempt").alias("attempt"))
    ends = listed.unionByName(asked.select(*pk)).distinct().join(final, pk, "left").where(
        F.col("attempt").isNull() | (F.col("attempt") > 0)).select(*pk, "attempt")
    outcome = Workspace(rows.sparkSession, "outcome")
    table = outcome.save(ends, "attempts")
    ws.drop()
    return Attempts(table, table.where(F.col("attempt").isNull()).count(), len(names), tuple(asking))


def _first_round(first: DataFrame, key: Column, taken: DataFrame | None) -> DataFrame:
    """Per value: smallest key, number of offers, and whether it is taken."""
    offers = first.select("value", key.alias("key"), F.lit(False).alias("taken"))
    if taken is not None:
        nobody = F.lit(None).cast(offers.schema["key"].dataType)
        offers = offers.unionByName(taken.select("value", nobody.alias("key"), F.lit(True).alias("taken")))
    return offers.groupBy("value").agg(
        F.min("key").alias("holder"), F.count("key").alias("n"), F.bool_or("taken").alias("taken"))


def _held(log: DataFrame) -> DataFrame:
    """Who holds each value now."""
    return log.groupBy("value").agg(F.min("holder").alias("holder"), F.bool_or("taken").alias("taken"))


def _open(asked: DataFrame, held: DataFrame, key: Column) -> DataFrame:
    """Tries that no smaller key holds.  NULL is nobody's value."""
    return asked.join(held, "value", "left").where(
        F.coalesce(~F.col("taken") & (F.col("holder").isNull() | (key <= F.col("holder"))), F.lit(True)))


def _changed(asked: DataFrame, log: DataFrame, pk: list[str], key: Column) -> DataFrame:
    """Values that get a smaller holder as every row asked claims its first open try."""
    first = _open(asked, _held(log), key).groupBy(*pk).agg(
        F.min(F.struct("attempt", "value", F.col("holder").alias("before"))).alias("claim"))
    return first.where(F.col("claim.value").isNotNull() & (F.col("claim.before").isNull() | (key < F.col("claim.before")))).groupBy(
        F.col("claim.value").alias("value")).agg(F.min(key).alias("holder"), F.lit(False).alias("taken"))


def key_of(pk: list[str]) -> Column:
    """The key as one value, by which rows are ordered."""
    return F.col(pk[0]) if len(pk) == 1 else F.struct(*pk)


def unpack(pk: list[str]) -> list[Column]:
    """The key's columns from such a value, called ``key``."""
    if len(pk) == 1:
        return [F.col("key").alias(pk[0])]
    return [F.col("key").getField(name).alias(name) for name in pk]
