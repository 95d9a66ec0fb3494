"""Deterministic data masking as Spark DataFrame jobs."""

from .functions.generators import GenContext, register_generator
from .functions.providers import register_provider
from .functions.seed import SeedScope
from .operators.diff import diff, dry_run, preview, report, row_estimates, run_report
from .operators.mask import MaskedTable, mask_all, mask_table, update_join
from .operators.writeback import update_partitions
from .plans.preflight import check_target, preflight, require_clean
from .plans.publish import apply_spec, latest_state, published, run_log
from .plans.spec import ColumnSpec, GenSpec, MaskSpec, SourceSpec, TableSpec
from .sources.backends import open_tables, register_backend, register_source
from .streaming.stream import mask_stream, publish_stream, published_batches, write_stream

__all__ = [
    "ColumnSpec", "GenContext", "GenSpec", "MaskSpec", "MaskedTable", "SeedScope", "SourceSpec", "TableSpec",
    "apply_spec", "check_target", "diff", "dry_run", "latest_state", "mask_all", "mask_stream", "mask_table",
    "open_tables", "preflight", "preview", "publish_stream", "published", "published_batches", "register_backend", "register_generator",
    "register_provider", "register_source", "report", "require_clean", "row_estimates", "run_log", "run_report",
    "update_join", "update_partitions", "write_stream",
]
