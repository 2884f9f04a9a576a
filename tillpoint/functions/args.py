"""Argument checks made before any job starts (raise ValueError)."""

from __future__ import annotations

import datetime as dt

from tillpoint.schema import ORDER_STATUSES

# The messages are fixed texts: callers show them as they are.
__all__ = ["check_limit", "check_page", "check_period", "normalize_status_arg"]


def check_limit(limit: int, hi: int, name: str = "limit") -> int:
    if not isinstance(limit, int) or limit < 1 or limit > hi:
        raise ValueError(f"{name.capitalize()} must be between 1 and {hi}.")
    return limit


def check_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1.")
    if size < 1 or size > 100:
        raise ValueError("pageSize must be between 1 and 100.")


def check_period(start: dt.datetime, end: dt.datetime) -> None:
    if start > end:
        raise ValueError("startDate must be before endDate.")
    if (end - start).total_seconds() / 86400.0 > 365:
        raise ValueError("Date range cannot exceed 365 days.")


def normalize_status_arg(status: str | None) -> str | None:
    """Case-insensitive match to a known status; None means no filter."""
    if status is None:
        return None
    s = status.lower()
    if s not in ORDER_STATUSES:
        raise ValueError("Invalid status. Valid values: " + ", ".join(ORDER_STATUSES))
    return s
