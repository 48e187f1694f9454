"""Time windows, closed at both ends."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.functions.time import nanos


@dataclass(frozen=True)
class TimeWindow:
    """[t - length, t], or [t, t + length] if future."""

    length: int
    future: bool = False
    label: str = ""

    @property
    def name(self) -> str:
        return f"window_{'future' if self.future else 'past'}_{self.label}"


def _window(length, future: bool) -> TimeWindow:
    if nanos(length) < 0:
        raise ValueError("a window's length can't be negative")
    return TimeWindow(nanos(length), future, str(length).replace(" ", ""))


def past_absolute_time(length) -> TimeWindow:
    return _window(length, False)


def future_absolute_time(length) -> TimeWindow:
    return _window(length, True)
