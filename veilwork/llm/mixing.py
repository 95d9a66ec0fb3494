"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (NULL last) weigh 5, 2, 1, repeating, and
share all words by weight; no target exceeds three times its source's size, the
excess goes to the others by weight until none is above.  The water level is
found in closed form from one row per source.

Sampling: inside a source documents are ordered by size, then id and text.  Each
is expected ``target / source size`` times, so the prefix sum of expected copies
at rank ``k`` is ``k`` times that rate; with one random offset per source a
document is emitted once for every integer boundary its interval crosses.
Because the order is by size, every stretch of sizes is taken at the same rate
and the words taken come near the target.

Ranks come from a range partitioning by (source, size, id, text), which splits a
hot source over many tasks; only one row per partition and source is gathered.
The offset is a hash of the source, so reruns agree.

Defined results: NULL and empty texts have size 0 and are mixed like others,
adding no words; a source without words has target 0 and nothing is taken of
it; repeated rows are separate documents; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, read

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"

_OFFSET_BITS = 20


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    With sources sorted by ``size / weight``, those at their limit come first.
    For each possible number of them the level of the others follows; the first
    that fits is the water level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("limit", max_repeats * F.col("source_size"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("limit") * F.col("shares"))
        .withColumn("at", F.row_number().over(by_limit))
        .withColumn("level_at", F.min(F.when(F.col("fits"), F.col("at"))).over(everything))
        .withColumn("rest", F.max(F.when(F.col("at") == F.col("level_at"), F.col("left"))).over(everything))
        .withColumn("shared", F.max(F.when(F.col("at") == F.col("level_at"), F.col("shares"))).over(everything))
    )
    level = (F.col("rest") * F.col("weight")).cast("double") / F.col("shared").cast("double")
    return filled.select("source", "source_size",
                         F.when(F.col("at") < F.col("level_at"), F.col("limit").cast("double")).otherwise(level)
                         .alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) per source, a multiple of 2^-20 so that adding it to whole numbers is exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, _OFFSET_BITS // 4), 16, 10).cast("double") / (1 << _OFFSET_BITS)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED,
        carry: list[str] | None = None) -> DataFrame:
    """``row`` (the document as a struct), ``size``, ``source_size``, ``target`` and ``copies``, a row per document.

    ``carry`` names the columns of the struct, all by default.
    """
    work = Workspace(docs.sparkSession, "mix")
    order = [F.col("source").asc_nulls_last(), "size", F.col("key").asc_nulls_last(), "digest"]
    ordered = (
        docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col(source).alias("source"), F.col(key).alias("key"),
                    n_words(F.col(text)).alias("size"),
                    F.coalesce(F.md5(F.col(text)), F.lit("")).alias("digest"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .drop("key", "digest")
    )
    ordered = work.save(ordered, "ordered").withColumn("part", F.shiftright("place", 33))
    parts = work.save(ordered.groupBy("part", "source").agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.min("place").alias("start")), "parts")
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "source", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    starts = starts.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source")).select(
        "part", "s.source", "start", "earlier", "source_size", "target", "rate",
        _offset(F.col("s.source"), seed).alias("offset"))
    rank = F.col("earlier") + F.col("place") - F.col("start")
    crossed = F.floor((rank + 1) * F.col("rate") + F.col("offset")) - F.floor(rank * F.col("rate") + F.col("offset"))
    return ordered.alias("o").join(
        starts.alias("t"), F.expr("o.part = t.part AND o.source <=> t.source")).select(
        "row", "size", "source_size", "target", F.least(crossed, F.lit(max_repeats).cast("long")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target",
                            (F.col("copies") * F.col("size")).alias("taken"))


def mix_sql(docs: str = "documents") -> str:
    """The same in SQL: ``copies`` and the digest columns for each row of ``docs``."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
    sized AS (
        SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               list_value({weights})[(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1)
                                     % {len(WEIGHTS)} + 1]::BIGINT AS weight
        FROM sized GROUP BY source),
    filled AS (
        SELECT *, {MAX_REPEATS} * source_size AS limit_,
               row_number() OVER w AS at_,
               sum(source_size) OVER () - coalesce(sum({MAX_REPEATS} * source_size) OVER (w
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
               sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
        FROM sources WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
    level_ AS (
        SELECT at_ AS level_at, left_ AS rest, shares AS shared FROM filled
        WHERE left_ * weight <= limit_ * shares ORDER BY at_ LIMIT 1),
    plan AS (
        SELECT source, source_size,
               CASE WHEN at_ < level_at THEN limit_::DOUBLE
                    ELSE (rest * weight)::DOUBLE / shared::DOUBLE END AS target
        FROM filled, level_),
    ranked AS (
        SELECT s.*, source_size, target,
               CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
               ('0x' || left(md5('{SEED}:' || coalesce('=' || s.source, 'null')), {_OFFSET_BITS // 4}))::BIGINT::DOUBLE
                   / {1 << _OFFSET_BITS} AS offset_,
               row_number() OVER (PARTITION BY s.source
                   ORDER BY size, doc_id NULLS LAST, coalesce(md5(text), '')) - 1 AS rank_
        FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
    mixed AS (
        SELECT *, least(floor((rank_ + 1) * rate + offset_) - floor(rank_ * rate + offset_), {MAX_REPEATS})::BIGINT
                  AS copies
        FROM ranked)"""


QUERIES = {"op10_systematic_mix": op10_systematic_mix}
ORACLES = {"op10_systematic_mix":
           f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"}
