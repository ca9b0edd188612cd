"""What a Python worker keeps between tasks: one object at a time, whichever operator made it.

Workers are used again by later stages; what an earlier one kept would only take their memory.
"""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict = {}


def held(key, make: Callable):
    """The object under ``key``, made now if another one (or none) was kept."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    _HELD.clear()
