"""Sequence analytics as Spark DataFrame and Column operations."""

from strandloom.plans.session import build_session, checkpointed
from strandloom.functions.sql import register

__all__ = ["build_session", "checkpointed", "register"]
