from .runs import error_reports, generate_runs, label_errors
from .scoring import (
    PASS_RATES,
    execution_records,
    model_report,
    prepare_answers,
    prepare_sql,
    score_answers,
    score_expected,
    score_matched,
    score_references,
    score_semantics,
)

__all__ = [
    "PASS_RATES",
    "error_reports",
    "execution_records",
    "generate_runs",
    "label_errors",
    "model_report",
    "prepare_answers",
    "prepare_sql",
    "score_answers",
    "score_expected",
    "score_matched",
    "score_references",
    "score_semantics",
]
