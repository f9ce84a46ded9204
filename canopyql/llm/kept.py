"""The one large table that a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """This process's table of that name, made once. Workers outlive the query that made a table, so another one takes its place."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drops the table, for work that needs the memory and no table."""
    _KEPT.clear()
