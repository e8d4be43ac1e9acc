"""All registered queries; importing this package fills the registry."""

from . import boards_and_research, context_windows, decisions, quality_checks, selection, span_metrics, tokens_and_labels, transcripts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
