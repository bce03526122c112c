"""Structured Streaming: stateless scoring, rejection and alerts."""

from ebbline.streaming.records import (
    alert_stream,
    model_stream,
    quarantine_stream,
    read_records,
    reject_invalid,
    score_records,
    score_stream,
)

__all__ = [
    "alert_stream",
    "model_stream",
    "quarantine_stream",
    "read_records",
    "reject_invalid",
    "score_records",
    "score_stream",
]
