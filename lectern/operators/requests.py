"""Checks of what a caller asks for, before any job starts."""

from __future__ import annotations

# The ranges that requests must keep to.
MAX_TOP_K, MAX_TITLE, MAX_ROWS = 20, 200, 500


def check_request(question: str | None = None, top_k: int | None = None, title: str | None = None, limit: int | None = None) -> None:
    """Raises for a blank question, top_k beyond 1 to 20, a title beyond 1 to 200 characters or a limit beyond 1 to 500; None is not checked."""
    if question is not None and not question.strip():
        raise ValueError("the question is empty")
    for name, value, most in (("top_k", top_k, MAX_TOP_K), ("title's length", None if title is None else len(title), MAX_TITLE), ("limit", limit, MAX_ROWS)):
        if value is not None and not 1 <= value <= most:
            raise ValueError(f"{name} must be from 1 to {most}")
