"""Steps on single rows that no input can end: a value, or an error with its class.

A step says what is at fault by the error that it raises. Whatever else it raises, memory included, is a `panic` of its
row alone; only what ends the process itself, or stops the task from outside, passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

#: Classes of errors: the page is at fault, or its template, or the step itself failed.
QUALITY, TEMPLATE, PANIC = "quality", "template", "panic"


class RowError(ValueError):
    kind = PANIC


class PageError(RowError):
    """A page that can't be read well enough."""

    kind = QUALITY


class TemplateError(RowError):
    """A template that no page could be read by."""

    kind = TEMPLATE


@dataclass(frozen=True)
class Outcome:
    value: Any = None
    error: str | None = None
    error_class: str | None = None


def guarded(step: Callable[..., Any], *args: Any) -> Outcome:
    """What a step gives, or what it raised."""
    try:
        return Outcome(step(*args))
    except RowError as e:
        return Outcome(None, str(e), e.kind)
    except Exception as e:  # the row's, whatever it is
        return Outcome(None, f"{type(e).__name__}: {e}", PANIC)
