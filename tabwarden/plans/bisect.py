"""Jobs over many parts of which a few may fail."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

Part = TypeVar("Part")
Result = TypeVar("Result")


def bisected(parts: Sequence[Part], run: Callable[[Sequence[Part]], Result]
             ) -> tuple[list[tuple[Sequence[Part], Result]], list[tuple[Part, Exception]]]:
    """run(parts) as one job; if it fails, of halves, until the parts that fail stand alone.

    Returns what ran, with the parts each result is of, and the parts that failed with
    their errors. k failing parts of n take some k log n jobs more; halves that ran
    are not run again.
    """
    if not parts:
        return [], []
    try:
        return [(parts, run(parts))], []
    except Exception as e:
        if len(parts) == 1:
            return [], [(parts[0], e)]
    half = len(parts) // 2
    done, failed = bisected(parts[:half], run)
    more, worse = bisected(parts[half:], run)
    return done + more, failed + worse


def first_line(error: Exception) -> str:
    """The error in one line: what Spark raised in a task, where it did, else the error's own first line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    if not lines:
        return type(error).__name__
    return next((x for x in lines if x.startswith("[") and "FAILED_READ_FILE" not in x), lines[0])
