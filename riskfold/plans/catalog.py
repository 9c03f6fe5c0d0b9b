"""All registered queries, in the order of the operator inventory."""
from __future__ import annotations

from . import q_rows, q_profile, q_prepare, q_eval, q_score, q_sampling, q_select, q_models, q_stream, q_explain  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
