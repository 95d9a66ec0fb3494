"""Running a spec: checks, writing to a fresh place, and publishing all or nothing.

Masked tables are written below a folder named after the run.  The run log, an
append-only table, decides which run is visible: its ``COMPLETED`` record is
one small write that comes after every table was written and verified.  The
input is never overwritten.

A table keeps its partitions.  Where a run selects rows of a partitioned table,
only partitions with a selected row are written; the others stay where they are,
and the run's manifest says so.  With a watermark a run writes the rows that came
since the last one, and a reader gets of each key the row of the latest run.

The report is counted by the job that writes, so nothing is masked twice.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.diff import counters, source_estimate
from ..operators.digests import SCHEMA as DIGESTS
from ..operators.digests import difference_rows, differing_ranges, digest_tree, fit_ranges, totals
from ..operators.mask import MaskedTable
from ..operators.verify import checksum, same_schema, uniqueness
from ..sources.backends import TableLookup
from ..sources.layout import exists, in_partitions, partitioning, partitions_of, roots
from .claim import Claim
from .preflight import check_target, preflight, require_clean
from .spec import MaskSpec, SourceSpec, TableSpec

STARTED, COMPLETED, FAILED, ACKNOWLEDGED, NONE = "STARTED", "COMPLETED", "FAILED", "ACKNOWLEDGED", "NONE"
_LOG = "run_id string, seq int, status string, updated_at timestamp, message string"
_MANIFEST = ("schema string, pk array<string>, partitioned_by array<string>, partitions array<string>, "
             "kept_in array<string>, watermark string, mark string, adds_to_earlier boolean")
REPORT = ("table_name string, columns string, types string, source string, estimate long, estimated_from string, "
          "selected long, updated long, retried long, failed long, duplicates_kept long, unmatched long, "
          "partitions_written int, started_at timestamp, ended_at timestamp, duration_ms long")


class VerificationFailed(RuntimeError):
    """A written table does not match its input."""


class DirtyState(RuntimeError):
    """The previous run did not complete."""


def _log_path(out: str) -> str:
    return f"{out.rstrip('/')}/_run_log"


def log_state(spark: SparkSession, out: str, run_id: str, seq: int, status: str, message: str = "") -> None:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = spark.createDataFrame([(run_id, seq, status, message)], "run_id string, seq int, status string, message string")
    row = row.withColumn("updated_at", F.lit(now.isoformat(sep=" ") + "Z").cast("timestamp"))
    row.select("run_id", "seq", "status", "updated_at", "message").write.mode("append").json(_log_path(out))


def run_log(spark: SparkSession, out: str) -> DataFrame:
    """Every state change recorded at a place; empty if nothing ever ran there."""
    if not exists(spark, _log_path(out)):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).json(_log_path(out))


def latest_state(log: DataFrame) -> DataFrame:
    """One row: the last recorded status, or NONE."""
    return log.agg(F.coalesce(F.max_by("status", F.struct("updated_at", "seq")), F.lit(NONE)).alias("status"))


def acknowledge(spark: SparkSession, out: str, message: str = "") -> None:
    """Record that somebody looked at an unfinished run, so the next may start."""
    log_state(spark, out, uuid.uuid4().hex, 0, ACKNOWLEDGED, message)


def _completed(spark: SparkSession, out: str) -> list[str]:
    """Runs that completed, in order; as many as there were runs."""
    log = run_log(spark, out).where(F.col("status") == COMPLETED).orderBy("updated_at", "seq")
    return [r["run_id"] for r in log.collect()]


def _manifest(spark: SparkSession, out: str, run: str, table: str) -> T.Row | None:
    """What one run says of how it wrote a table; None if it did not write it."""
    path = f"{out.rstrip('/')}/{run}/_manifest/{table}"
    return spark.read.schema(_MANIFEST).json(path).first() if exists(spark, path) else None


def _segment(spark: SparkSession, out: str, run: str, table: str) -> tuple[DataFrame, T.Row] | None:
    """What one run published of a table, and its manifest; None if the run had nothing to do with it."""
    folder = f"{out.rstrip('/')}/{run}"
    manifest = _manifest(spark, out, run, table)
    if manifest is None:
        return None
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    rows = spark.read.schema(schema).parquet(f"{folder}/{table}").select(*schema.names)
    if manifest["kept_in"]:
        kept = spark.read.schema(schema).parquet(*manifest["kept_in"])
        kept = kept.where(~in_partitions(manifest["partitioned_by"], manifest["partitions"]))
        rows = rows.unionByName(kept.select(*schema.names))
    return rows, manifest


def published(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table as of the last completed run."""
    runs = _completed(spark, out)
    segments: list[DataFrame] = []
    for run in reversed(runs):
        found = _segment(spark, out, run, table)
        if found is None:
            continue
        segments.append(found[0])
        if not found[1]["adds_to_earlier"]:
            break
    if not segments:
        raise LookupError(f"nothing published of {table!r} at {out}")
    if len(segments) == 1:
        return segments[0]
    pk = found[1]["pk"]
    every = reduce(DataFrame.unionByName, [s.withColumn("__run", F.lit(-n)) for n, s in enumerate(segments)])
    latest = every.groupBy(*pk).agg(F.max("__run").alias("__run"))
    return every.join(latest, [*pk, "__run"], "left_semi").select(*segments[0].columns)


def _verify(table: TableSpec, expected: DataFrame, written: DataFrame, tree: DataFrame) -> None:
    """Raise unless the written table, whose digests are given, has the rows, the unmasked columns and the constraints
    it must have."""
    kept = [c for c in expected.columns if c not in table.masked]
    found = totals(tree)
    sums = (found["n_rows"] or 0, found["kept_first"], found["kept_second"])
    if not same_schema(expected, written) or tuple(checksum(expected, kept).first()) != sums:
        raise VerificationFailed(f"table {table.name!r}: rows or unmasked columns changed")
    for rule in table.columns:
        if rule.unique and (n := uniqueness(written, [rule.name]).first()["n_duplicates"]):
            raise VerificationFailed(f"table {table.name!r}: {n} rows repeat a value of the UNIQUE column {rule.name!r}")
    for column in table.not_null:
        if not written.where(F.col(column).isNull()).isEmpty():
            raise VerificationFailed(f"table {table.name!r}: NULL in {column!r}, which is declared NOT NULL")


def digests_of(spark: SparkSession, out: str, run: str, table: str) -> DataFrame:
    """The digests of the rows that a run wrote of a table."""
    return spark.read.schema(f"{DIGESTS}, starts array<string>").json(f"{out.rstrip('/')}/{run}/_digests/{table}")


def _last_starts(spark: SparkSession, out: str, table: TableSpec) -> list[str]:
    for run in reversed(_completed(spark, out)):
        if exists(spark, f"{out.rstrip('/')}/{run}/_digests/{table.name}"):
            first = digests_of(spark, out, run, table.name).select("starts").first()
            return list(first["starts"]) if first else []
    return []


def compare_runs(spark: SparkSession, out: str, table: TableSpec, before: str, after: str) -> DataFrame:
    """Keys of the rows that two runs published differently: missing, added or changed.

    Only key ranges whose stored digests differ are read.  Runs without the same
    ranges, or that did not write the whole table, are read in full.
    """
    trees = [digests_of(spark, out, run, table.name) for run in (before, after)]
    starts = [list(r["starts"]) if (r := tree.select("starts").first()) else None for tree in trees]
    segments = [_segment(spark, out, run, table.name) for run in (before, after)]
    if None in segments:
        raise LookupError(f"one of the runs did not write {table.name!r}")
    (old, m), (new, n) = segments
    whole = not (m["kept_in"] or n["kept_in"] or m["watermark"] or n["watermark"])
    same = whole and starts[0] is not None and starts[0] == starts[1]
    ranges = differing_ranges(*trees) if same else [(None, None)]
    return difference_rows(old, new, table.pk, old.columns, ranges)


def last_mark(spark: SparkSession, out: str, table: TableSpec) -> str | None:
    """The largest value of the watermark column that completed runs have seen, as text."""
    for run in reversed(_completed(spark, out)):
        manifest = _manifest(spark, out, run, table.name)
        if manifest is not None and manifest["watermark"] == table.source.watermark:
            return manifest["mark"]
    return None


def _since(spark: SparkSession, out: str, table: TableSpec, base: DataFrame) -> tuple[TableSpec, str | None, bool]:
    """The rule for the rows since the last run, the new mark, and whether there was a run before.

    The range goes from the last mark up to the largest value now, ends
    included: rows as large as the last mark may have come after that run, and
    masking the others again gives the same.  Rows without a value are taken by
    every run, as nothing tells when they came.
    """
    column = table.source.watermark
    kind = base.schema[column].dataType.simpleString()
    low = last_mark(spark, out, table)
    high = base.agg(F.max(column).cast("string").alias("high")).first()["high"]
    name = f"`{column.replace('`', '``')}`"
    bounds = [f"{name} {sign} CAST('{value}' AS {kind})" for sign, value in ((">=", low), ("<=", high)) if value is not None]
    rows = " AND ".join(bounds) if bounds else "true"
    filter_ = f"({rows} OR {name} IS NULL)" + (f" AND ({table.source.filter})" if table.source.filter else "")
    return dataclasses.replace(table, source=SourceSpec(filter=filter_)), high or low, low is not None


def _publish(spark: SparkSession, spec: MaskSpec, lookup: TableLookup, out: str, folder: str, t: TableSpec,
             keys_checked: bool) -> None:
    """Write one table, what is needed to read it, and its report."""
    started = datetime.now(timezone.utc)
    base, by, mark, adds = lookup(t.name), [], None, False
    rule = t
    if t.source.watermark:
        rule, mark, adds = _since(spark, out, t, base)
    masked = MaskedTable(base, rule, spec, lookup)
    masked.keys_checked = keys_checked
    by = [] if set(partitioning(base)) & set(t.masked) else partitioning(base)
    only_selected = bool(t.source.watermark)
    rows, expected, names, kept_in = masked.output(flags=True, only_selected=only_selected), base, [], []
    if only_selected:
        expected = masked.selected.select(*base.columns)
    elif by and not masked.rewrites_everything:
        names, kept_in = partitions_of(masked.selected, by), roots(base)
        rows, expected = rows.where(in_partitions(by, names)), base.where(in_partitions(by, names))
    seen = Observation(f"published-{t.name}")
    # Counted after the rows are dealt out by partition: in the tasks that write, each of which counts once.
    rows = (rows.hint("rebalance", *by) if by else rows).observe(seen, *counters(masked)).drop(*masked.flags)
    rows.write.partitionBy(*by).parquet(f"{folder}/{t.name}")
    manifest = {"schema": base.schema.json(), "pk": list(t.pk), "partitioned_by": by, "partitions": names,
                "kept_in": kept_in, "watermark": t.source.watermark, "mark": mark, "adds_to_earlier": adds}
    spark.createDataFrame([manifest], _MANIFEST).coalesce(1).write.json(f"{folder}/_manifest/{t.name}")
    written = spark.read.schema(base.schema).parquet(f"{folder}/{t.name}").select(*base.columns)
    # The ranges of the last run are kept, so that the two can be compared by their digests.
    starts = _last_starts(spark, out, t) or fit_ranges(base, t.pk[0])
    tree = digest_tree(written, t.pk, t.masked, starts)
    stored = tree.withColumn("starts", F.array(*[F.lit(x) for x in starts]).cast("array<string>"))
    stored.coalesce(1).write.json(f"{folder}/_digests/{t.name}")
    _verify(t, expected, written, digests_of(spark, out, folder.rsplit("/", 1)[1], t.name))
    estimate, known_from = source_estimate(t, lookup)
    counts = {k: int(v) for k, v in seen.get.items()}
    counts["unmatched"] = masked.unmatched().count() if t.source.type != "table" else 0
    ended = datetime.now(timezone.utc)
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    row = {"table_name": t.name, "columns": ",".join(t.masked), "types": ",".join(types[c] for c in t.masked),
           "source": t.source.type, "estimate": estimate, "estimated_from": known_from, **counts,
           "partitions_written": len(names) if kept_in else None, "started_at": started, "ended_at": ended,
           "duration_ms": int((ended - started).total_seconds() * 1000)}
    spark.createDataFrame([row], REPORT).coalesce(1).write.parquet(f"{folder}/_report/{t.name}")


def _usable_state(spark: SparkSession, out: str, over_unfinished: bool) -> str:
    state = latest_state(run_log(spark, out)).first()["status"]
    if state in (STARTED, FAILED) and not over_unfinished:
        raise DirtyState(f"the previous run is {state}; acknowledge it first")
    return state


def apply_spec(spark: SparkSession, spec: MaskSpec, lookup: TableLookup, out: str, target: str = "",
               force: bool = False, strict: bool = False, check_data: bool = True, over_unfinished: bool = False) -> DataFrame:
    """Mask every table of the spec below ``out`` and publish them together.

    ``force`` accepts a target outside the allowlist, ``over_unfinished`` starts
    although the previous run did not complete.  Only one run writes at a place;
    of two that start, the second raises.  Returns the report, read from where
    it was written.
    """
    check_target(spec, target, force)
    require_clean(preflight(spark, spec, lookup, target, strict, check_data))
    run_id = uuid.uuid4().hex
    folder = f"{out.rstrip('/')}/{run_id}"
    claim = Claim(spark, out, run_id)
    state = _usable_state(spark, out, over_unfinished)
    claim.take(over_unfinished or state == ACKNOWLEDGED)
    try:
        _usable_state(spark, out, over_unfinished)  # another run may have come and gone in between
        log_state(spark, out, run_id, 0, STARTED)
        try:
            for t in spec.tables:
                _publish(spark, spec, lookup, out, folder, t, check_data)
            claim.check()
        except Exception as e:
            log_state(spark, out, run_id, 1, FAILED, type(e).__name__)
            raise
        log_state(spark, out, run_id, 1, COMPLETED)
    finally:
        claim.release()
    return spark.read.parquet(*[f"{folder}/_report/{t.name}" for t in spec.tables])
