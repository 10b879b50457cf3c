from .reads import (
    only_models,
    read_predictions,
    read_runs,
    read_signatures,
    read_summaries,
    read_with_rejects,
    with_ingest_order,
)
from .schemas import SCHEMAS
from .sinks import append_runs, report_table, write_csv, write_jsonl, write_summary

__all__ = [
    "SCHEMAS",
    "append_runs",
    "only_models",
    "read_predictions",
    "read_runs",
    "read_signatures",
    "read_summaries",
    "read_with_rejects",
    "report_table",
    "with_ingest_order",
    "write_csv",
    "write_jsonl",
    "write_summary",
]
