"""Distinct masks in several columns at once: a row's try counts only if all its values are free.

The result equals a serial pass in key order in which each row takes its first
try whose values nobody before it has taken, in any of the columns, and takes
all of them together.  A row that loses one value gives the others back, so a
holder is not simply displaced as with one column.  Instead rows are settled in
rounds: a row is settled with its first open try when no smaller unsettled row
still has one of its values in any open try, for then nobody ahead can come to
want it.  The smallest unsettled row always can be settled; rows that do not
want each other's values are settled together.

Few rows take part.  Those that lose a value with their first try do, and so do
holders of a value that a smaller row taking part has in any of its tries, until
there are no more of them; everybody else keeps the first try.  Of their tries,
those with a value that an outsider holds are closed from the start.  Each round
writes the tries still open, which get fewer.  Written tables hold keys, tries
and masks, never originals, and are dropped but for the outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .unique import Attempts, check_keys, key_of, unpack

_VALUE = ["column", "value"]


def resolve_joint(
    rows: DataFrame,
    pk: Sequence[str],
    carry: Sequence[str],
    with_values: Callable[[DataFrame], DataFrame],
    tries: int,
    taken: DataFrame | None = None,
    keys_checked: bool = False,
) -> Attempts:
    """Find the try of each row.

    ``rows`` has the key ``pk`` (checked here unless ``keys_checked``) and the columns ``carry`` that values
    depend on.  ``with_values`` adds ``values`` for the column ``attempt``: an
    array of ``column`` (a number) and ``value`` (text; NULL is nobody's).
    ``taken`` (``column, value``) lists what nobody may use.
    """
    pk, ident = list(pk), [*pk, *carry]
    if not keys_checked:
        check_keys(rows, pk)
    work, key = Workspace(rows.sparkSession, "joint"), key_of(pk)

    def offers(some: DataFrame) -> DataFrame:
        return with_values(some).select(*some.columns, F.explode("values").alias("v")).select(*some.columns, "v.column", "v.value")

    def tries_of(some: DataFrame) -> DataFrame:
        every = some.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        return offers(every).select(*pk, "attempt", *_VALUE)

    first = offers(rows.select(*ident).withColumn("attempt", F.lit(0))).where(F.col("value").isNotNull())
    claims = first.select(*_VALUE, key.alias("key"), F.lit(False).alias("taken"))
    if taken is not None:
        nobody = F.lit(None).cast(claims.schema["key"].dataType)
        claims = claims.unionByName(taken.select(*_VALUE, nobody.alias("key"), F.lit(True).alias("taken")))
    holders = work.save(claims.groupBy(*_VALUE).agg(
        F.min("key").alias("holder"), F.count("key").alias("n"), F.bool_or("taken").alias("taken")), "holders")
    contested = holders.where((F.col("n") > 1) | (F.col("taken") & (F.col("n") > 0)))
    if contested.isEmpty():
        work.drop()
        return Attempts(None, 0, 1)

    lost = first.join(contested, _VALUE).where(F.col("taken") | (key > F.col("holder"))).select(*ident).distinct()
    names = ["tries-0"]
    asked = added = work.save(tries_of(lost), names[0])
    while True:  # holders of what the rows just added want, and come after
        wanted = added.groupBy(*_VALUE).agg(F.min(key).alias("by"))
        threatened = holders.join(wanted, _VALUE).where(~F.col("taken") & (F.col("by") < F.col("holder"))).select(
            F.col("holder").alias("key")).distinct().select(*unpack(pk)).join(asked.select(*pk).distinct(), pk, "left_anti")
        names.append(f"tries-{len(names)}")
        added = work.save(tries_of(rows.select(*ident).join(threatened, pk)), names[-1])
        if added.isEmpty():
            break
        asked = work.read(asked, *names)

    members = asked.select(key.alias("holder")).distinct()
    outside = holders.join(asked.select(*_VALUE).distinct(), _VALUE, "left_semi").join(
        members.withColumn("inside", F.lit(True)), "holder", "left").where(F.col("taken") | F.col("inside").isNull())
    open_ = work.save(_without(asked, outside.select(*_VALUE), pk), "open-0")
    rounds, settled = 0, []
    while not open_.isEmpty():
        rounds += 1
        least = open_.groupBy(*_VALUE).agg(F.min(key).alias("least"))
        now = open_.join(open_.groupBy(*pk).agg(F.min("attempt").alias("attempt")), [*pk, "attempt"])
        free = F.col("value").isNull() | F.coalesce(F.col("least") == key, F.lit(False))
        settled.append(f"settled-{rounds}")
        done = work.save(now.join(least, _VALUE, "left").groupBy(*pk, "attempt").agg(F.bool_and(free).alias("free")).where(
            "free").select(*pk, "attempt"), settled[-1])
        claimed = now.join(done, [*pk, "attempt"], "left_semi").where(F.col("value").isNotNull()).select(*_VALUE)
        open_ = work.save(_without(open_.join(done, pk, "left_anti"), claimed, pk), f"open-{rounds}")
    found = asked.select(*pk).distinct()
    if settled:
        found = found.join(work.read(done, *settled), pk, "left")
    else:
        found = found.withColumn("attempt", F.lit(None).cast("int"))
    outcome = Workspace(rows.sparkSession, "outcome")
    table = outcome.save(found.where(F.col("attempt").isNull() | (F.col("attempt") > 0)).select(*pk, "attempt"), "attempts")
    work.drop()
    return Attempts(table, table.where(F.col("attempt").isNull()).count(), rounds + 1)


def _without(asked: DataFrame, values: DataFrame, pk: list[str]) -> DataFrame:
    """Tries none of whose values is among ``values``."""
    closed = asked.join(values, _VALUE, "left_semi").select(*pk, "attempt").distinct()
    return asked.join(closed, [*pk, "attempt"], "left_anti")
